"""Language-model scores: a word unigram as the base, and a causal self-attention model over subword ids.

The model is trained here, in numpy. Words (A-Z lower-cased, white space between them) are encoded by byte-level BPE with
a space before each; a document ends with END. Ids are sorted by their count in training text into classes: frequent ids
have their own, the others share by rank. Each output class's logit is the sum of a table, what it was counted after the
last input class, and of what attention reads from the classes before; within a class an id has its share of counts. So
a text's score is the log10 of a proper probability of its ids.

Positions are cut into blocks of BLOCK. A block's positions attend to themselves, to those before them in the block and
to the whole block before it: windows of 2 * BLOCK that overlap by half, in which each token is scored once. All blocks
of many documents go through one batched, masked attention.

Everything is learned from all training documents. Words, ids and pairs of classes are counted exactly. For the attention
documents are dealt by a hash of their id into shards of about SHARD tokens; each shard trains from common parameters on
its documents in the order of that hash, in batches of BATCH blocks, and the results are averaged by their tokens, in whole
numbers. Neither the number of partitions nor their order plays a part in that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import bpe
from .shared import Run, scope, staged, tidy

BLOCK, DIM = 16, 16
INPUTS, OUTPUTS = 512, 64
START = INPUTS - 1
#: Blocks of a training step, tokens of a shard, and tokens that are counted or scored together.
BATCH, SHARD, GROUP = 256, 2_000_000, 200_000
#: Bytes of text whose words are counted and encoded together: their words and pieces are Python objects for a while.
TEXTS = 2_000_000
#: Counts that the unigram of classes adds to each input class's successors.
PRIOR = 20.0
#: Parameters are averaged in multiples of 1 / FINE.
FINE = 2**28
#: Words whose counts go to every task; the others are joined.
HOT = 2**18
#: Input and output class of a position as one number, input * OUTPUTS + output, which fits into 16 bits.
PAIR = {"in": (np.arange(INPUTS * OUTPUTS) // OUTPUTS).astype(np.int16), "out": (np.arange(INPUTS * OUTPUTS) % OUTPUTS).astype(np.int16)}
_SHAPES = {"emb": (INPUTS, DIM), "qkv": (DIM, 3 * DIM), "rel": (2 * BLOCK,), "out": (DIM, OUTPUTS), "bias": (OUTPUTS,)}
_AGE = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]  # how far back a key lies
_PAST = (_AGE >= 0).astype(np.float32)
_AGE = np.maximum(_AGE, 0)


def split_words(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six ASCII white-space characters, bytes.lower() changes A-Z alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def initial(seed: int = 5) -> np.ndarray:
    """Attention adds nothing at first."""
    rng = np.random.default_rng(seed)
    scale = {"emb": 0.5, "qkv": 0.25, "rel": 0, "out": 0, "bias": 0}
    return np.concatenate([(rng.standard_normal(s) * scale[k]).ravel() for k, s in _SHAPES.items()]).astype(np.float32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def classes(counts: np.ndarray) -> dict[str, np.ndarray]:
    """By id: input class, output class and log10 of its share of its output class; half a count more for each id."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    mass = counts + 0.5

    def cut(n_classes: int, own: int) -> np.ndarray:
        out = np.empty(len(counts), np.int64)
        own = min(own, len(counts) - 1)
        out[order[:own]] = np.arange(own)
        rest = order[own:]
        part = np.cumsum(mass[rest]) / mass[rest].sum()
        out[rest] = own + np.minimum((part * (n_classes - own)).astype(np.int64), n_classes - own - 1)
        return out

    inputs, outputs = cut(INPUTS - 1, 7 * INPUTS // 8), cut(OUTPUTS, 5 * OUTPUTS // 8)
    return {"in": inputs.astype(np.int16), "out": outputs.astype(np.int16), "share": np.log10(mass / np.bincount(outputs, mass, OUTPUTS)[outputs])}


def blocks(docs: list[np.ndarray], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input classes and output classes (-1 where a block is filled up) in rows of BLOCK; first blocks; owners."""
    sizes = np.array([len(d) for d in docs])
    rows = -(-sizes // BLOCK)
    starts = np.concatenate([[0], np.cumsum(rows)[:-1]]).astype(np.int64)
    flat = np.concatenate(docs)
    place = np.repeat(starts * BLOCK - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(flat))
    x = np.full(int(rows.sum()) * BLOCK, START, np.int16)
    y = np.full(len(x), -1, np.int16)
    y[place] = known["out"][flat]
    inner = place[:-1] + 1
    x[inner] = known["in"][flat[:-1]]
    x[starts * BLOCK] = START
    first = np.zeros(int(rows.sum()), bool)
    first[starts] = True
    return x.reshape(-1, BLOCK), y.reshape(-1, BLOCK), first, np.repeat(np.arange(len(docs)), rows)


def successors(pairs: np.ndarray, known: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Log probability of each output class after each input class, from their counts; a class without ids has next to none."""
    mass = np.bincount(known["out"], counts + 0.5, OUTPUTS)
    prior = np.where(mass > 0, mass, 1e-30) / mass.sum()
    return np.log((pairs + PRIOR * prior) / (pairs.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)


class Room:
    """Arrays for steps over up to ``n`` blocks with one successor table, used again and again."""

    def __init__(self, n: int, table: np.ndarray) -> None:
        t, kind = n * BLOCK, table.dtype
        self.high = max(table.max(), -table.max(axis=1).min())
        new = lambda *s: np.empty(s, kind)
        self.qkv, self.kv, self.e, self.o, self.z, self.z2 = new(t, 3 * DIM), new(n, 2 * BLOCK, 2 * DIM + 1), new(n, BLOCK, 2 * BLOCK), new(n, BLOCK, DIM + 1), new(t, OUTPUTS), new(t, OUTPUTS)
        self.ds, self.back, self.d, self.emb = new(n, BLOCK, 2 * BLOCK), new(n, 2 * BLOCK, DIM), new(n, BLOCK, 3 * DIM), new(t, DIM)
        self.rows, self.ones = np.arange(t) * OUTPUTS, np.ones(OUTPUTS, kind)
        self.cells = np.arange(DIM)


def _reach(rows: np.ndarray) -> float:
    """The greatest length of a row: products of two rows are at most the product of two such."""
    return float(np.sqrt((rows * rows).sum(axis=1).max()))


def gradient(p: dict[str, np.ndarray], table: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood (natural) of the output classes, and its gradient.

    Weights stay unnormalised, and what comes back to them is divided by their sum instead. The largest exponent is taken
    out only where the tables allow one that is too large, or a whole row that vanishes.
    """
    n, t, room = len(x), x.size, room or Room(len(x), table)
    qkv, kv, e, o17, z, z2 = room.qkv[:t], room.kv[:n], room.e[:n], room.o[:n], room.z[:t], room.z2[:t]
    tab = p["emb"] @ p["qkv"]
    tab[:, :DIM] *= np.float32(DIM**-0.5)
    flat, first = x.ravel().astype(np.int64), first.copy()
    first[:1] = True
    np.take(tab, flat, axis=0, out=qkv, mode="clip")
    each = qkv.reshape(n, BLOCK, 3 * DIM)
    kv[:, BLOCK:, : 2 * DIM] = each[:, :, DIM:]
    kv[1:, :BLOCK, : 2 * DIM] = each[:-1, :, DIM:]
    kv[:, :, 2 * DIM] = 1
    kv[first, :BLOCK] = 0  # neither weight nor value
    q, k, v = each[:, :, :DIM], kv[:, :, :DIM], kv[:, :, DIM : 2 * DIM]
    np.matmul(q, k.transpose(0, 2, 1), out=e)
    e += p["rel"][_AGE]
    if _reach(tab[:, :DIM]) * _reach(tab[:, DIM : 2 * DIM]) + np.abs(p["rel"]).max() > 60:
        e[:, _PAST == 0] = -1e9
        e[first, :, :BLOCK] = -1e9
        e -= e.max(axis=2, keepdims=True)
    np.exp(e, out=e)
    e *= _PAST
    e[first, :, :BLOCK] = 0
    np.matmul(e, kv[:, :, DIM:], out=o17)
    total = o17[:, :, DIM:].copy()
    o17 /= total  # and so the last column is 1, which takes the bias
    o, read = o17[:, :, :DIM], o17.reshape(t, DIM + 1)
    np.take(table, flat, axis=0, out=z, mode="clip")
    z += np.matmul(read, np.concatenate([p["out"], p["bias"][None]]), out=z2)
    if _reach(tab[:, 2 * DIM :]) * _reach(p["out"].T) + np.abs(p["bias"]).max() + room.high > 60:
        z -= z.max(axis=1, keepdims=True)
    told = y.ravel().astype(np.int64)
    real = told >= 0
    m = max(int(real.sum()), 1)
    place = room.rows[:t] + np.maximum(told, 0)
    picked = z.ravel().take(place)
    np.exp(z, out=z)
    sums = z @ room.ones
    loss = -float((picked - np.log(sums))[real].sum(dtype=np.float64)) / m
    z *= (real / (sums * m))[:, None].astype(z.dtype)
    z.ravel()[place[real]] -= z.dtype.type(1 / m)
    both = read.T @ z
    g = {"out": both[:DIM], "bias": both[DIM]}
    do = (z @ p["out"].T).reshape(n, BLOCK, DIM)
    do /= total
    ds = np.matmul(do, v.transpose(0, 2, 1), out=room.ds[:n])
    ds -= np.einsum("nbd,nbd->nb", do, o)[:, :, None]
    ds *= e
    g["rel"] = np.bincount(_AGE.ravel(), ds.sum(axis=0).ravel(), 2 * BLOCK)
    d, back = room.d[:n], room.back[:n]
    np.matmul(ds, k, out=d[:, :, :DIM])
    d[:, :, :DIM] *= np.float32(DIM**-0.5)
    for i, (weights, values) in enumerate(((ds, q), (e, do)), 1):
        np.matmul(weights.transpose(0, 2, 1), values, out=back)
        d[:, :, i * DIM : (i + 1) * DIM] = back[:, BLOCK:]
        # A first block's weights on the block before are 0, and so is what comes back to it.
        d[:-1, :, i * DIM : (i + 1) * DIM] += back[1:, :BLOCK]
    d = d.reshape(t, 3 * DIM)
    g["qkv"] = np.take(p["emb"], flat, axis=0, out=room.emb[:t], mode="clip").T @ d
    g["emb"] = np.bincount((flat[:, None] * DIM + room.cells).ravel(), (d @ p["qkv"].T).ravel(), INPUTS * DIM).reshape(INPUTS, DIM)
    return loss, g


class Adam:
    def __init__(self, flat: np.ndarray, table: np.ndarray, rate: float = 0.01) -> None:
        self.flat, self.table, self.rate = flat.astype(np.float32).copy(), table, rate
        self.m, self.v, self.t, self.room = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, Room(BATCH, table)

    def step(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> float:
        loss, g = gradient(unpack(self.flat), self.table, x, y, first, self.room)
        g = np.concatenate([g[k].ravel() for k in _SHAPES]).astype(np.float32)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.99 * self.v + 0.01 * g * g
        rate = self.rate / (1 + self.t / 200)
        self.flat -= np.float32(rate) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + np.float32(1e-6))
        return loss

    def fit(self, docs: list[np.ndarray], known: dict[str, np.ndarray]) -> None:
        x, y, first, _ = blocks(docs, known)
        for a in range(0, len(x), BATCH):
            self.step(x[a : a + BATCH], y[a : a + BATCH], np.concatenate([[True], first[a + 1 : a + BATCH]]))


class Scorer:
    """Natural log probability of blocks' output classes: the model in buffers that are used again and again.

    Queries, keys and values depend on an input's class alone, so they are a table; a column of ones sums the weights
    within the product. The largest exponent is taken out only where the tables allow one that is too large.
    """

    def __init__(self, p: dict[str, np.ndarray], table: np.ndarray, size: int = 256) -> None:
        n, t = size + 1, (size + 1) * BLOCK
        self.size, self.bias = size, p["rel"][_AGE]
        self.tab = p["emb"] @ p["qkv"]
        self.tab[:, :DIM] *= np.float32(DIM**-0.5)
        self.out, self.own = p["out"], table + p["bias"]
        q, k, v = (self.tab[:, i * DIM : (i + 1) * DIM] for i in range(3))
        self.high_s, self.high_z = (q @ k.T).max() + p["rel"].max() > 60, self.own.max() + (v @ self.out).max() > 60
        new = lambda *s: np.zeros(s, np.float32)
        self.qkv, self.kv, self.s, self.o, self.z, self.z2 = new(t, 3 * DIM), new(n, 2 * BLOCK, 2 * DIM + 1), new(n, BLOCK, 2 * BLOCK), new(n, BLOCK, DIM + 1), new(t, OUTPUTS), new(t, OUTPUTS)
        self.rows, self.ones = np.arange(t) * OUTPUTS, np.ones(OUTPUTS, np.float32)

    def __call__(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        n, t = len(x), x.size
        qkv, kv, s, o, z, z2 = self.qkv[:t], self.kv[:n], self.s[:n], self.o[:n], self.z[:t], self.z2[:t]
        np.take(self.tab, x.ravel(), axis=0, out=qkv, mode="clip")
        each = qkv.reshape(n, BLOCK, 3 * DIM)
        kv[:, BLOCK:, : 2 * DIM] = each[:, :, DIM:]
        kv[1:, :BLOCK, : 2 * DIM] = each[:-1, :, DIM:]
        kv[:, :, 2 * DIM] = 1
        kv[0, :BLOCK] = 0
        kv[first, :BLOCK] = 0  # neither weight nor value
        np.matmul(each[:, :, :DIM], kv[:, :, :DIM].transpose(0, 2, 1), out=s)
        s += self.bias
        if self.high_s:
            s[:, _PAST == 0] = -1e9
            s[first, :, :BLOCK] = -1e9
            s[0, :, :BLOCK] = -1e9
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s *= _PAST
        np.matmul(s, kv[:, :, DIM:], out=o)
        flat = o.reshape(t, DIM + 1)
        flat[:, :DIM] /= flat[:, DIM:]
        np.matmul(flat[:, :DIM], self.out, out=z2)
        np.take(self.own, x.ravel(), axis=0, out=z, mode="clip")
        z += z2
        if self.high_z:
            z -= z.max(axis=1, keepdims=True)
        told = y.ravel()
        pick = z.ravel().take(self.rows[:t] + np.maximum(told, 0))
        np.exp(z, out=z)
        lp = pick - np.log(z @ self.ones)
        lp[told < 0] = 0
        return lp.reshape(-1, BLOCK).sum(axis=1, dtype=np.float64)


def log10_probability(docs: list[np.ndarray], run: Scorer, known: dict[str, np.ndarray]) -> np.ndarray:
    """Of each sequence of ids, which ends with END."""
    x, y, first, owner = blocks(docs, known)
    got, step = np.empty(len(x)), run.size
    for a in range(0, len(x), step):
        # One block more in front, so that the first has its context; it isn't scored again.
        b = max(a - 1, 0)
        got[a : a + step] = run(x[b : a + step], y[b : a + step], first[b : a + step])[a - b :]
    sizes = np.array([len(d) for d in docs])
    share = np.add.reduceat(known["share"][np.concatenate(docs)], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return np.bincount(owner, got, len(docs)) / np.log(10) + share


def held_out(ident: Column) -> Column:
    """crc32 of the id as text is 0 modulo 10; false for a null id, which isn't learned from either."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


CODED = {"doc_id": pa.int64(), "learned": pa.bool_(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "words": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}


def _code(path: str, pattern: str):
    """Of rows (doc_id, learned, text): each document's number of words and one, its ids with END, its distinct words and
    how often it has them; and for each group of documents one row without ``learned``, with the words of its training
    documents and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        end = len(coder.table)
        for part in (p for big in batches for p in bpe.slices(big, TEXTS)):
            said = [split_words(t) for t in part.column(2).to_pylist()]
            n = len(said)
            sizes = np.array([len(w) for w in said], np.int64)
            coded = pa.array([x for w in said for x in w], pa.large_binary()).dictionary_encode()
            del said
            distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin, lens = coder.units(distinct.cast(pa.large_string()), pa.array([], pa.large_string()))
            # END after each document's words, as a unit of its own.
            flat, begin, lens = np.append(flat, np.int32(end)), np.append(begin, len(flat)), np.append(lens, 1)
            ends = np.cumsum(sizes + 1) - 1
            order = np.full(len(codes) + n, len(lens) - 1)
            inner = np.ones(len(order), bool)
            inner[ends] = False
            order[inner] = codes
            each = lens[order]
            ids = bpe.gathered(flat, begin[order], each)
            counts = np.add.reduceat(each, ends - sizes)
            owner = np.repeat(np.arange(n), sizes)
            pairs, times = np.unique(owner * max(len(distinct), 1) + codes, return_counts=True)
            own = np.bincount(pairs // max(len(distinct), 1), minlength=n)
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32()), distinct.take(pa.array(pairs % max(len(distinct), 1))).cast(pa.binary()))
            learned = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes + 1), _lists(ids, counts, pa.int32()), words, _lists(times, own, pa.int32())], list(CODED))
            total = np.bincount(codes[learned[owner]], minlength=len(distinct))
            seen = np.flatnonzero(total)
            group = pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), distinct.take(pa.array(seen)).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.bool_()), pa.array([int(learned.sum())]), pa.array([None], CODED["ids"]), group, _lists(total[seen], np.array([len(seen)]), pa.int32())], list(CODED))

    return run


def _ids(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    column = batch.column(at)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _grouped(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists in column ``at`` hold about GROUP ids; a longer list makes a part of its own."""
    lengths = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - 1) // GROUP
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _counted(size: int, keys):
    """Sums of np.bincount of the keys that ``keys`` gives for a list of documents, for some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.load.cache_clear()  # texts are coded by now, and a worker keeps its coder
        total = np.zeros(size, np.int64)
        for part in (p for batch in batches for p in _grouped(batch, 0)):
            total += np.bincount(keys(_ids(part, 0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    return run


def _sums(rows: DataFrame, size: int, keys) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(tidy(_counted(size, keys)), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


DEALT = {"shard": pa.int64(), "h": pa.int64(), "tie": pa.int64(), "codes": pa.list_(pa.int16())}


def _dealt(known: dict[str, np.ndarray]):
    """Rows (shard, h, tie, ids) with the classes of each id, as in ``PAIR``, in place of the id: half the bytes to shuffle."""
    codes = (known["in"].astype(np.int64) * OUTPUTS + known["out"]).astype(np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.load.cache_clear()
        for part in (p for batch in batches for p in _grouped(batch, 3)):
            ids = part.column(3)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], _lists(codes[ids.flatten().to_numpy(zero_copy_only=False)], ids.value_lengths().to_numpy(), pa.int16())], list(DEALT))

    return run


def _train(start: np.ndarray, table: np.ndarray):
    """Rows (shard, codes) come sorted by shard; each shard gives its parameters times its tokens, in multiples of 1 / FINE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.load.cache_clear()
        shard, opt, held, size, seen = None, Adam(start, table), [], 0, 0

        def done() -> pa.RecordBatch:
            if held:
                opt.fit(held, PAIR)
            whole = np.rint(opt.flat.astype(np.float64) * FINE).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.list_(pa.int64())), pa.array([seen], pa.int64())], ["params", "seen"])

        for batch in batches:
            for s, codes in zip(batch.column(0).to_pylist(), _ids(batch, 1), strict=True):
                if s != shard and shard is not None:
                    yield done()
                    opt, held, size, seen = Adam(start, table), [], 0, 0
                shard = s
                held.append(codes.copy())
                size += len(codes)
                seen += len(codes)
                if size >= 8 * BATCH * BLOCK:
                    opt.fit(held, PAIR)
                    held, size = [], 0
        if shard is not None:
            yield done()

    return run


def _score(flat: np.ndarray, table: np.ndarray, known: dict[str, np.ndarray], hot: pa.Array, logs: np.ndarray, end: float, end_known: int):
    """Rows (doc_id, n_tokens, ids, words, times): scores, and the words of each document whose counts are still to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.load.cache_clear()
        model = Scorer(unpack(flat), table)
        uid = TaskContext.get().partitionId() << 36
        for big in batches:
            # The table of hot words is built anew by every call: once for a batch, not for each of its groups.
            places, upto = pc.fill_null(pc.index_in(big.column(3).flatten(), hot), -1).to_numpy(zero_copy_only=False), 0
            for batch in _grouped(big, 2):
                n = batch.num_rows
                score = log10_probability(_ids(batch, 2), model, known)
                words, times = batch.column(3).flatten(), batch.column(4).flatten()
                own = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, k = np.repeat(np.arange(n), own), times.to_numpy(zero_copy_only=False)
                at, upto = places[upto : upto + len(words)], upto + len(words)
                found = at >= 0
                base = end + np.bincount(owner[found], k[found] * logs[at[found]], n)
                n_known = end_known + np.bincount(owner[found], k[found], n).astype(np.int64)
                rest = np.bincount(owner[~found], minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
                rare = pa.ListArray.from_arrays(offsets, words.filter(pa.array(~found)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(1), pa.array(n_known), pa.array(base), rare, pa.ListArray.from_arrays(offsets, pa.array(k[~found], pa.int32())), pa.array(score)],
                    ["uid", "doc_id", "n_tokens", "n_known", "base", "rare", "times", "score"],
                )
                uid += n

    return run


def learn(coded: DataFrame, ids: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Parameters, successor table and classes from the training rows of ``coded`` (doc_id, ids), of a vocabulary of ``ids`` and END."""
    counts = _sums(coded, ids + 1, np.concatenate)
    known = classes(counts)
    pairs = _sums(coded, INPUTS * OUTPUTS, lambda docs: _pairs(docs, known)).reshape(INPUTS, OUTPUTS)
    table, flat = successors(pairs, known, counts), initial()
    n = max(1, -(-int(counts.sum()) // shard))
    # Of equal ids the smaller hash of the text goes first.
    dealt = coded.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "ids").select(F.pmod("h", F.lit(n)).alias("shard"), "h", F.xxhash64("ids").alias("tie"), "ids")
    dealt = dealt.mapInArrow(tidy(_dealt(known)), "shard bigint, h bigint, tie bigint, codes array<smallint>")
    spread = min(n, 8 * int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.repartition(spread, "shard").sortWithinPartitions("shard", "h", "tie").select("shard", "codes")
    found = rows.mapInArrow(tidy(_train(flat, table)), "params array<bigint>, seen bigint")
    weighed = F.sum(F.col("v").cast("decimal(38,0)") * F.col("seen"))
    mean = found.select(F.posexplode("params").alias("i", "v"), "seen").groupBy("i").agg(weighed.alias("v"), F.sum("seen").alias("n")).collect()
    if mean:
        flat = np.zeros_like(flat)
        for r in mean:
            flat[r[0]] = float(r[1]) / r[2] / FINE
    return flat, table, known


def _pairs(docs: list[np.ndarray], known: dict[str, np.ndarray]) -> np.ndarray:
    x, y, _, _ = blocks(docs, known)
    real = y >= 0
    return x[real].astype(np.int64) * OUTPUTS + y[real]


def score(docs: DataFrame, path: str, pattern: str, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    A null or blank text is the end token alone. Without training documents all counts are 0 and attention adds nothing.
    Repeated rows are scored alike, texts of any length as a whole, other columns are not read, and an empty table gives
    an empty result.
    """
    with scope() as mine:
        return _scored(docs, path, pattern, shard, mine)


def _scored(docs: DataFrame, path: str, pattern: str, shard: int, mine: Run) -> DataFrame:
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ask = base.select("doc_id", (F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).alias("learned"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, learned boolean, n_tokens bigint, ids array<int>, words array<binary>, times array<int>"
    coded = staged(ask.mapInArrow(tidy(_code(path, pattern)), schema), "coded")
    groups = coded.where("learned IS NULL")
    n_docs = groups.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    counts = groups.select(F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.times").alias("c"))
    counts = staged(counts, "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_docs, distinct + int(n_docs > 0)  # the end of a document is a token
    # The smallest power of two that no more than HOT words reach.
    level = F.floor(F.log2("c"))
    hist = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, n = 0, 0
    for at, k in hist:
        if n + k > HOT:
            least = 2 ** (at + 1)
            break
        n += k
    hot = counts.where(F.col("c") >= least).toArrow()
    bottom = total + 0.1 * (distinct + 1)
    logs = np.log10((hot.column("c").to_numpy() + 0.1) / bottom)
    flat, table, known = learn(coded.where("learned").select("doc_id", "ids"), len(bpe.load(path, pattern).table), shard)
    words = hot.column("word").combine_chunks()
    ends = (float(np.log10((n_docs + 0.1) / bottom)), int(n_docs > 0))
    rows = coded.where("learned IS NOT NULL").select("doc_id", "n_tokens", "ids", "words", "times")
    raw = staged(rows.mapInArrow(tidy(_score(flat, table, known, words, logs, *ends)), "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, rare array<binary>, times array<int>, score double"), "scores")
    mine.clean(docs.sparkSession, ("/words-", "/scores-"))  # ids and words of the documents are used up
    rare = raw.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    c = F.coalesce("c", F.lit(0))
    joined = rare.join(counts, "word", "left").groupBy("uid").agg(F.sum(F.col("k") * F.log10((c + 0.1) / bottom)).alias("more"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known"))
    out = raw.drop("rare", "times").join(joined, "uid", "left")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
