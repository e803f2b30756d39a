"""Fill-in-middle: texts are cut at two unit boundaries and their pieces put in another order.

A unit is a run of ASCII white space with the run of other characters after it, or white space at the end alone. One
table-driven automaton reads UTF-8 bytes: its state says whether the last character was white space and how much of a
sentinel has been read; each transition emits counts, of code points begun (continuation bytes begin none), of units begun
and of sentinels completed. Texts are cut into blocks; the first scan runs all blocks side by side from every state at once,
since a block's first state is only known when those before it are done. The blocks' maps are then chained for each text,
and the chained state picks each block's emitted counts. The second pass looks for cuts only in the blocks in which, by
these counts, a cut's unit begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .shared import fresh, tidy

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LENGTH = 256
#: Bytes that are scanned together.
SCAN = 1 << 20
PAD = 256
#: States: nothing read yet; last read white space, another character, "<", or "<" and a sentinel's letter.
START, SPACE, OTHER, OPEN, LETTER = range(5)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next states (states x 257 bytes) and emissions: 1 for a code point, + 2 for a unit, + 4 for a sentinel.

    Byte 256 stands for nothing: it leaves the state and emits nothing.
    """
    step, emit = np.empty((5, 257), np.uint8), np.zeros((5, 257), np.uint8)
    letters = [ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]
    for s in range(5):
        for b in range(256):
            white = b == 0x20 or 9 <= b <= 13
            step[s, b] = SPACE if white else OPEN if b == ord("<") else LETTER if s == OPEN and b in letters else OTHER
            begins = s == START or (white and s != SPACE)  # white space after anything else begins a unit
            emit[s, b] = (b & 0xC0 != 0x80) + 2 * begins + 4 * (s == LETTER and b == ord(">"))
        step[s, PAD] = s
    return step, emit


STEP, EMIT = automaton()


def _laid(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Blocks of bytes as columns (LENGTH x blocks), filled up with PAD."""
    at = begin[None, :] + np.arange(LENGTH)[:, None]
    out = buffer[np.minimum(at, len(buffer) - 1)].astype(np.uint16)
    out[at >= end[None, :]] = PAD
    return out


class Scan:
    """Blocks of some texts (bytes), with the state before each block and what was emitted in it."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.buffer = texts, np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start, blocks = np.cumsum(size) - size, -(-size // LENGTH)
        self.first = np.r_[0, np.cumsum(blocks)]  # a text's first block
        owner = np.repeat(np.arange(len(texts)), blocks)
        self.begin = start[owner] + LENGTH * (np.arange(len(owner)) - self.first[owner])
        self.end = np.minimum(self.begin + LENGTH, (start + size)[owner])
        self.before, self.points, self.units, self.marks = (np.zeros(len(owner), np.int64) for _ in range(4))
        ends, counts = [], []
        for a in range(0, len(owner), SCAN // LENGTH):
            e, c = self._all_states(_laid(self.buffer, self.begin[a : a + SCAN // LENGTH], self.end[a : a + SCAN // LENGTH]))
            ends.append(e)
            counts.append(c)
        if not ends:
            return
        maps, counts = np.concatenate(ends, axis=1), np.concatenate(counts, axis=1)
        chain = maps.T.tolist()
        for i in range(len(texts)):  # one look-up a block
            s = START
            for b in range(self.first[i], self.first[i + 1]):
                self.before[b] = s
                s = chain[b][s]
        picked = counts[self.before, np.arange(len(owner))]
        self.points, self.units, self.marks = picked & 0xFFFF, (picked >> 16) & 0xFFFF, picked >> 32

    @staticmethod
    def _all_states(laid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every first state (rows) and block: the last state, and packed counts of what was emitted."""
        n = laid.shape[1]
        state = np.repeat(np.arange(5, dtype=np.intp)[:, None], n, axis=1)
        packed = np.array([(e & 1) + ((e >> 1 & 1) << 16) + ((e >> 2) << 32) for e in range(8)], np.int64)[EMIT].ravel()
        flat, total = STEP.ravel().astype(np.intp) * 257, np.zeros((5, n), np.int64)
        state *= 257
        for row in laid:
            at = state + row
            total += packed[at]
            state = flat[at]
        return state // 257, total

    def cut(self, text: int, units: int) -> tuple[int, int]:
        """Bytes and code points before the unit after the first ``units`` ones; the whole text if there is none."""
        a, b = self.first[text], self.first[text + 1]
        begun = np.cumsum(self.units[a:b])
        k = int(np.searchsorted(begun, units + 1))  # the block in which that unit begins
        if k == b - a:
            return len(self.texts[text]), int(self.points[a:b].sum())
        block, state = int(a) + k, int(self.before[a + k])
        left = units + 1 - (int(begun[k - 1]) if k else 0)
        points = int(self.points[a : a + k].sum())
        bytes_ = self.buffer[self.begin[block] : self.end[block]].tolist()
        for i, x in enumerate(bytes_):  # the second pass: one block
            e = int(EMIT[state, x])
            left -= e >> 1 & 1
            if not left:
                return k * LENGTH + i, points
            points += e & 1
            state = int(STEP[state, x])
        raise AssertionError("a counted unit is missing")


def draws(ident: object) -> list[int]:
    """Four numbers below 2^32 from a hash of ``42:`` and the id; a null id is hashed as ``null``."""
    h = hashlib.sha256(f"42:{'null' if ident is None else ident}".encode()).digest()
    return [int.from_bytes(h[4 * i : 4 * i + 4], "big") for i in range(4)]


def _transform(rate: int, spm: int):
    def some(idents: list, texts: list[bytes]) -> Iterator[tuple]:
        scan = Scan(texts)
        for i, (ident, text) in enumerate(zip(idents, texts, strict=True)):
            a, b = scan.first[i], scan.first[i + 1]
            n, marks = int(scan.units[a:b].sum()), int(scan.marks[a:b].sum())
            h = draws(ident)
            if not text or marks or h[2] % 100 >= rate:
                yield n, "plain", text, None, None
                continue
            low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            (x, px), (y, py) = scan.cut(i, low), scan.cut(i, high)
            prefix, middle, suffix = text[:x], text[x:y], text[y:]
            p, s, m = PREFIX.encode() + prefix, SUFFIX.encode() + suffix, MIDDLE.encode() + middle
            yield (n, "spm", s + p + m, px, py - px) if h[3] % 100 < spm else (n, "psm", p + s + m, px, py - px)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            at = 0
            while at < big.num_rows:  # some texts at a time, by their size
                texts, held = [], 0
                for x in big.column(1).slice(at):
                    raw = x.as_buffer()
                    texts.append(raw.to_pybytes() if raw is not None else b"")
                    held += len(texts[-1])
                    if held >= SCAN or len(texts) >= 2000:
                        break
                part = big.slice(at, len(texts))
                at += len(texts)
                got = list(zip(*some(part.column(0).to_pylist(), texts), strict=True))
                kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                cols = [pa.array(list(g), k) for g, k in zip(got, kinds, strict=True)]
                cols[2] = cols[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *cols], [*part.schema.names[2:], "n", "form", "output", "prefix_chars", "middle_chars"])

    return run


OUTPUTS = {"n": T.LongType(), "form": T.StringType(), "output": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}


def transform(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: list[str] | None = None, rate: int = 50, spm: int = 80) -> DataFrame:
    """``keep`` columns (the id by default), n (units), form, output, prefix_chars and middle_chars of every row.

    Of 100 texts ``rate`` are transformed, of those ``spm`` with the suffix first; both are drawn from a hash of the id, so
    reruns agree and rows that share an id and a text come out alike. A null text is empty; an empty text, and one that
    contains a sentinel, stays plain, with null counts of characters. Texts of any length are cut as a whole. An empty
    table gives an empty result. A kept column that is named like a result gets underscores in front.
    """
    ship(docs.sparkSession)
    names = keep if keep is not None else [ident]
    own = [f"_{i}" for i in range(len(names))]
    base = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(o) for c, o in zip(names, own, strict=True)])
    schema = T.StructType([*base.schema.fields[2:], *[T.StructField(n, k) for n, k in OUTPUTS.items()]])
    out = base.mapInArrow(tidy(_transform(rate, spm)), schema)
    clash = docs.sparkSession.createDataFrame([], ", ".join(f"{n} {k.simpleString()}" for n, k in OUTPUTS.items()))
    return out.select(*[F.col(o).alias(c if c.lower() not in OUTPUTS else fresh(clash, c)) for o, c in zip(own, names, strict=True)], *OUTPUTS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone: a transformed one has each sentinel once."""
    tail = lambda s: F.substring_index(output, s, -1)
    head = lambda x, s: F.substring_index(x, s, 1)
    middle = tail(MIDDLE)
    psm = F.concat(head(tail(PREFIX), SUFFIX), middle, head(tail(SUFFIX), MIDDLE))
    spm = F.concat(head(tail(PREFIX), MIDDLE), middle, head(tail(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hex sha256 of the output and of the text restored from it."""
    rows = transform(docs)
    hexed = lambda c: F.sha2(c.cast("binary"), 256)
    back = hexed(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hexed(F.col("output")).alias("output_sha256"), back)
