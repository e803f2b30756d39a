"""Near-duplicate groups by HyperMinHash.

A document's set is its distinct word shingles, as 64-bit hashes. Its sketch has M registers: each holds the smallest
hash that falls in its bucket, compressed to the round in which it fell there, its count of leading zeros and a few bits
of mantissa. (Small sets don't fill M buckets, so their elements are thrown again, round by round, until no bucket is
empty; then every register agrees with the probability of the Jaccard similarity J.) Bands of ROWS compressed registers
are bucket keys: two documents with J = 0.8 miss each other in all bands with probability below 1e-7.

Equal sets are one class. In each bucket the smallest class is a centre, every member is paired with it, pairs are first
judged by the similarity that the registers estimate, corrected for collisions of compressed registers, and then by the
full sets. Connected components follow. The documents of buckets that still hold more than one component take their
rarest shingles for keys (see ``_rare_keys``): under those, members become centres in turn, about 64 times as many in each
round, and are paired with members of other components, until every key has one component or all its members have been
centres. So no pair in a bucket is lost, yet a group of near copies costs a few pairs a member. Nothing is capped, and no
list of documents, links or components comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..ship import ship
from .shared import staged, tidy

M, ROWS = 512, 7
BANDS = M // ROWS
ROUNDS = 24
MANTISSA = 7
#: A bucket is large if so many ids of a 64th of them are in it; how many large ones are told apart.
HOT, HOT_KEYS = 8, 10_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Words(dict):
    """64-bit hashes of words, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()
ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles, A-Z lower-cased; fewer words are one shingle, none are none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, _U)
    x = np.fromiter(map(WORDS.__getitem__, w), _U, len(w))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, _U)
    for i in range(k):
        h += mix(x[i : i + n] + ODD[(i + 1) % 8]) * ODD[i % 8]
    # A short text differs from any shingle of full length.
    return np.unique(mix(h + _U(k if k < size else 0)))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Compressed registers (uint16) of non-empty sets, one row each."""
    none = _U(0xFFFFFFFFFFFFFFFF)
    regs = np.full((len(sets), M), none, _U)
    todo = np.arange(len(sets))
    for t in range(ROUNDS):
        if not len(todo):
            break
        flat = np.concatenate([sets[i] for i in todo])
        at = np.repeat(todo, [len(sets[i]) for i in todo])
        v = mix(flat + _U((t * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        np.minimum.at(regs.reshape(-1), at * M + (v & _U(M - 1)).astype(np.int64), (_U(t) << _U(55)) | (v >> _U(9)))
        todo = todo[(regs[todo] == none).any(axis=1)]
    for i in todo:  # what is still empty takes the smallest of all elements, hashed with the register
        empty = np.flatnonzero(regs[i] == none)
        for a in range(0, len(sets[i]), 4096):
            v = mix(sets[i][a : a + 4096, None] ^ mix(empty.astype(_U)[None, :] + _U(77)))
            regs[i, empty] = np.minimum(regs[i, empty], (_U(31) << _U(55)) | (v >> _U(9)).min(axis=0))
    low = regs & _U((1 << 55) - 1)
    top = np.frexp((low | _U(1)).astype(np.float64))[1].astype(np.int64)  # bits in use
    zeros = np.minimum(55 - top, 15)
    shift = np.maximum(54 - zeros - MANTISSA, 0).astype(_U)
    mantissa = (low >> shift) & _U((1 << MANTISSA) - 1)
    return (((regs >> _U(55)) << _U(11)) | (zeros.astype(_U) << _U(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    part = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * ODD[3], (len(regs), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * ODD[0] + part[:, :, i] + _U(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard from two sketches. Unequal minima share a register by chance with the probability that rounds and leading
    zeros agree, taken from the two sketches, times 2^-MANTISSA; that share is taken out."""
    ca, cb = np.bincount(a >> MANTISSA, minlength=512), np.bincount(b >> MANTISSA, minlength=512)
    chance = float(ca @ cb) / (M * M) / (1 << MANTISSA)
    return (float(np.count_nonzero(a == b)) / M - chance) / (1 - chance)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                sets = [shingles(t.as_py(), size) for t in batch.column(1)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(sketch(full)))
                out = {"id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()), "same": pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string())}
                out["bands"] = pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _verify(size: int, threshold: float):
    """Keeps pairs whose sets are alike; rows are (a, b, text of a, text of b)."""
    top, bottom = round(threshold * 100), 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (big.slice(a, 500) for big in batches for a in range(0, big.num_rows, 500)):
            said = [batch.column(i).to_pylist() for i in (2, 3)]
            new = [t for t in dict.fromkeys([*said[0], *said[1]]) if t not in held]
            sets = [shingles(t, size) for t in new]
            if sets:
                held.update(zip(new, zip(sets, sketch(sets), strict=True), strict=True))
            good = []
            for a, b in zip(*said, strict=True):
                (x, rx), (y, ry) = held[a], held[b]
                if bottom * min(len(x), len(y)) < top * max(len(x), len(y)) or estimate(rx, ry) < threshold - 6 * (threshold * (1 - threshold) / M) ** 0.5:
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bottom * both >= top * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], ["a", "b"])
            if len(held) > 2000:
                held.clear()

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id of undirected ``edges`` (a, b).

    Labels spread to neighbours and then jump to the label of the label, until nothing changes; every round is written
    to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), name)
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid_id"), F.col("component").alias("far"))
        new = staged(step.join(jump, step.mid == jump.mid_id, "left").select("id", "old", F.least("mid", "far").alias("component")), name)
        labels = new.select("id", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return labels


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                sets = [shingles(t.as_py(), size).view(np.int64) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "h"])

    return run


def _rare_keys(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(key, rep, n, at): of each set of n shingles the n - ceil(threshold * n) + 1 that are in the fewest of these texts.

    Two sets that are alike share one of those, whatever else is common to many: the rest of either set is too small to
    hold all that they must share. Shingles of one text alone are left out.
    ``at`` is a key's place among the set's shingles, from the rarest.
    """
    each = staged(texts.mapInArrow(tidy(_sets(size), WORDS.clear), "rep bigint, n bigint, h array<bigint>").select("rep", "n", F.explode("h").alias("h")).distinct(), "shingles")
    spread = each.groupBy("h").agg(F.count("*").alias("df"))
    ranked = each.join(spread, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    must = F.floor((F.col("n") * round(threshold * 100) + 99) / 100)  # rounded up
    first = F.slice("all", F.lit(1), (F.size("all") - must + 1).cast("int"))
    return ranked.select("rep", "n", F.posexplode(first).alias("at", "x")).where("x.df > 1").select(F.col("x.h").alias("key"), "rep", "n", "at")


def _hinted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """To be broadcast if it has at most ``most`` rows, so that the other side needn't be dealt by its keys; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _hot_keys(rows: DataFrame) -> DataFrame:
    """(key, members, centre) of large buckets, at most HOT_KEYS, found in a sample of the ids but counted in full. It decides
    how rows are dealt, not what is found."""
    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "rep"), F.lit(64)) == 0).groupBy("key").agg(F.count("*").alias("seen")).where(F.col("seen") >= HOT)
    keys = staged(some.orderBy(F.desc("seen"), "key").limit(HOT_KEYS).select("key"), "hot")
    return staged(rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("centre")), "hot")


def groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A null or blank text has no shingles and is linked with nothing; a row with a null doc_id keeps a null component.
    Rows of one doc_id are one document: their links are joined. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text"))
    marked = staged(base.mapInArrow(tidy(_sketches(size), WORDS.clear), "id bigint, n bigint, same string, bands array<bigint>"), "sketches")
    known = marked.where("same IS NOT NULL AND id IS NOT NULL")
    # One class for equal sets; its smallest id stands for it from here on.
    classes = staged(known.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = known.join(classes, (known.same == classes.same) & (known.id == classes.rep)).select("rep", "n", "bands", known.same).dropDuplicates(["rep", "same"])
    # One shuffle by key; a bucket's rows are ids, and sets that are equal have been made one. Large buckets are told apart
    # first, and counted by partial sums instead.
    rows = reps.select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    hot = _hot_keys(rows)
    known_hot = F.broadcast(hot.select("key", "members", "centre"))
    large = rows.join(known_hot, "key").select("key", "rep", "n", "members", "centre")
    bucket = Window.partitionBy("key")
    small = rows.join(F.broadcast(hot.select("key")), "key", "left_anti")
    small = small.select("key", "rep", "n", F.count("*").over(bucket).alias("members"), F.min("rep").over(bucket).alias("centre"))
    members = staged(small.unionByName(large).where("members > 1"), "buckets")
    texts = staged(base.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        return two.select("a", "b", "ta", "tb").mapInArrow(tidy(_verify(size, threshold), WORDS.clear), "a bigint, b bigint").distinct()

    # Rows that share an id but not a set are linked through their id.
    many = known.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi").select("id")
    through = known.join(many, "id").join(classes, "same").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    stars = staged(members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    edges = staged(verified(stars).union(through), "links")
    labels = components(edges)
    tried, first, last, top = stars, 0, 1, round(threshold * 100)
    open_ = None
    while True:
        rows = members.select("key", "rep", "n", F.lit(0).alias("at")) if open_ is None else open_
        now = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.min("rep").alias("top")).where(f"lo <> hi AND members > {first}").select("key", "members", "top")
        mixed = _hinted(staged(mixed, "mixed"))
        # The smallest member is first in its bucket; the others have places from a hash, about one member each.
        u = F.pmod(F.xxhash64(F.lit("place"), "rep"), F.lit(1 << 40)) / float(1 << 40)
        now = now.join(mixed, "key").withColumn("place", F.when(F.col("rep") == F.col("top"), 0.0).otherwise(1 + u * (F.col("members") - 1)))
        if open_ is None:
            # Documents of unsettled buckets go on with their rarest shingles for keys: purer, and exact.
            open_ = staged(_rare_keys(texts.join(now.where("members > 2").select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), size, threshold), "rare")
            continue
        now = staged(now.select("key", "rep", "n", "at", "place", "component"), "open")
        if now.limit(1).count() == 0:
            break
        c, m = _hinted(now.where((F.col("place") >= first) & (F.col("place") < last))).alias("c"), now.alias("m")
        # What two sets can share from here on, were this their first common key; a pair that is alike passes there.
        ahead = F.least(F.col("c.n") - F.col("c.at"), F.col("m.n") - F.col("m.at"))
        alike = (100 * F.least("c.n", "m.n") >= top * F.greatest("c.n", "m.n")) & ((100 + top) * ahead >= top * (F.col("c.n") + F.col("m.n")))
        pairs = c.join(m, (F.col("c.key") == F.col("m.key")) & (F.col("c.component") != F.col("m.component")) & alike).select(F.least("c.rep", "m.rep").alias("a"), F.greatest("c.rep", "m.rep").alias("b")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        found = staged(verified(pairs), "links")
        if found.limit(1).count():
            edges = staged(edges.union(found), "links")
            labels = components(edges)
        open_, first, last = now.drop("component", "place"), last, last * 64
    out = marked.join(classes.select("same", "rep"), "same", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
