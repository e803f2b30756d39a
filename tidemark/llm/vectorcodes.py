"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found by VA-file filtering.

Components become integers, floor(256 * x). A vector is cut into equal parts, each part position has its own codebook. The
entries' coordinates are quantised to a few bits: in each dimension the entries in order are dealt evenly to cells, and a
cell keeps its smallest and largest coordinate. For a block of queries a table a dimension holds, for each cell, the least
and the largest squared difference; looked up by the entries' cells and added over the dimensions they give a lower and an
upper bound of every distance. Entries whose lower bound is above the smallest upper bound can't be nearest; integer
distances are computed for the others alone, and ties go to the lower index, so codes are exact.

Codebooks are refined in rounds. A task adds the parts of its rows up by entry and emits one row for each component of an
entry, so what is shuffled does not grow with the vectors; the driver sees codebooks, whose size is fixed by the parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .shared import fresh, staged, tidy

#: Integer components beyond this are cut to it, so that 64-bit sums of squares can't overflow.
MOST = 1 << 24
BLOCK = 2048
#: Labels whose totals are broadcast; beyond that they are joined under salted keys.
FEW_LABELS = 50_000
SALTS = 64


class Cells:
    """A codebook (entries x width, integers) and the cells of its coordinates."""

    def __init__(self, book: np.ndarray, bits: int):
        self.book, (n, width), k = book, book.shape, 1 << bits
        rank = np.argsort(np.argsort(book, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = np.ascontiguousarray((rank * k // max(n, 1)).T)  # width x entries
        self.low, self.high = np.full((width, k), MOST * 2, np.int64), np.full((width, k), -MOST * 2, np.int64)
        for d in range(width):
            np.minimum.at(self.low[d], self.cell[d], book[:, d])
            np.maximum.at(self.high[d], self.cell[d], book[:, d])
        used = self.low <= self.high
        self.low, self.high = np.where(used, self.low, 0), np.where(used, self.high, 0)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (entries x queries) of the squared distances of ``q`` (queries x width)."""
        lower = upper = None
        for d, cell in enumerate(self.cell):
            x, lo, hi = q[:, d], self.low[d].astype(q.dtype)[:, None], self.high[d].astype(q.dtype)[:, None]
            below, above = lo - x, x - hi
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(above + (hi - lo), below + (hi - lo))
            a, b = (near * near)[cell], (far * far)[cell]
            lower, upper = (a, b) if lower is None else (np.add(lower, a, out=lower), np.add(upper, b, out=upper))
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equally near ones, and its squared distance."""
        reach = int(max(np.abs(q).max(initial=0), np.abs(self.book).max(initial=0)))
        small = q.astype(np.int32) if q.shape[1] * (2 * reach) ** 2 < 2**31 else q
        lower, upper = self.bounds(small)
        row, entry = np.nonzero((lower <= upper.min(axis=0)).T)
        gap = q[row] - self.book[entry]
        dist = np.einsum("ij,ij->i", gap, gap)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(dist, first)
        hit = np.flatnonzero(dist == np.repeat(best, np.diff(np.r_[first, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        return entry[hit], best


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and those vectors as integers, filled up with zeros to ``dims`` components."""
    sizes = np.diff(column.offsets.to_numpy())
    at = np.repeat(np.arange(len(sizes)), sizes)
    flat = column.flatten() if not column.null_count else None
    if flat is None:  # a null row may hide values
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at, flat = np.repeat(np.arange(len(sizes)), sizes), column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    good = sizes > 0
    good[at[~np.isfinite(x)]] = False
    pick = good[at]
    out = np.zeros((len(sizes), dims), np.int64)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at[pick], place[pick]] = np.clip(np.floor(256 * x[pick]), -MOST, MOST).astype(np.int64)
    return good, out[good]


def usable(vector: str = "embedding"):
    """The vector isn't null or empty and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with usable vectors, some at a time; the vector is the last column and left out."""
    for big in batches:
        for a in range(0, big.num_rows, BLOCK):
            part = big.slice(a, BLOCK)
            good, v = integers(part.column(part.num_columns - 1), dims)
            if len(v):
                yield part.select(range(part.num_columns - 1)).filter(pa.array(good)), v


def _sums(books: np.ndarray, bits: int):
    """(part, entry, place, n, total): the task's parts added up by their nearest entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b, bits) for b in books]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, v in _blocks(batches, parts * width):
            for p, c in enumerate(cells):
                q = np.ascontiguousarray(v[:, p * width : (p + 1) * width])
                e, _ = c.nearest(q)
                n[p] += np.bincount(e, minlength=entries)
                for d in range(width):  # sums of a block are far below 2^53
                    total[p, :, d] += np.bincount(e, q[:, d], entries).astype(np.int64)
        p, e = np.nonzero(n)
        cols = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), np.repeat(n[p, e], width), total[p, e].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["part", "entry", "place", "n", "total"])

    return run


def _codes(books: np.ndarray, bits: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b, bits) for b in books]
        for rows, v in _blocks(batches, parts * width):
            found = [c.nearest(np.ascontiguousarray(v[:, p * width : (p + 1) * width])) for p, c in enumerate(cells)]
            code = np.stack([e for e, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            text = [code[i].tobytes().hex() for i in range(len(code))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.string()), pa.array(error, pa.int64())], [*rows.schema.names, "code", "error"])

    return run


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers (parts x entries x width), 256 to a unit."""

    entries: np.ndarray
    bits: int

    def digest(self) -> str:
        """Hex sha256 of all components in decimal by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def learn(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, bits: int = 4) -> Codebooks | None:
    """Codebooks that start as the parts of the usable vectors with the smallest ids and are refined in rounds.

    Of rows with one id the smaller vector is first; null ids come last. Vectors are filled up with zeros to the longest
    one's length and to a multiple of ``parts``. An entry without parts stays as it is. None if no vector is usable. At
    most 256 entries, so that an index has two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    ship(rows.sparkSession)
    base = rows.select(F.col(ident).alias("id"), F.col(vector).alias("v"))
    kept = base.where(usable("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    firsts = pa.array([r.v for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], pa.list_(pa.float64()))
    books = np.ascontiguousarray(integers(firsts, parts * width)[1].reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        schema = "part bigint, entry bigint, place bigint, n bigint, total bigint"
        sums = base.select("v").mapInArrow(tidy(_sums(books, bits)), schema).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = books.copy()
        for r in sums.collect():  # parts x entries x width at most
            books[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(books, bits)


def encode(rows: DataFrame, books: Codebooks | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all but the vector by default), code and error of every usable vector; others have no row.

    A kept column that is named like a result gets underscores in front. Vectors longer than those that the codebooks were
    learned from are an error.
    """
    ship(rows.sparkSession)
    names = [c for c in (keep if keep is not None else rows.columns) if c != vector]
    own = [f"_{i}" for i in range(len(names))]
    base = rows.select(*[F.col(c).alias(o) for c, o in zip(names, own, strict=True)], F.col(vector).alias("v"))
    kinds = T.StructType([*base.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = rows.sparkSession.createDataFrame([], kinds) if books is None else base.mapInArrow(tidy(_codes(books.entries, books.bits)), kinds)
    clash = rows.sparkSession.createDataFrame([], "code string, error bigint")
    return coded.select(*[F.col(o).alias(c if c.lower() not in {"code", "error"} else fresh(clash, c)) for o, c in zip(own, names, strict=True)], "code", "error")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", name: str = "vector") -> DataFrame:
    """Adds the vector that a code stands for, in the unit of the vectors; a null code has a null vector."""
    flat = F.array(*[F.array(*[F.lit(float(x) / 256) for x in part.ravel()]) for part in books.entries])
    parts, _, width = books.entries.shape
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    pieces = [F.slice(F.get(flat, F.lit(p)), at(p) * width + 1, F.lit(width)) for p in range(parts)]
    return codes.withColumn(name, F.when(F.col(code).isNotNull(), F.concat(*pieces)))


def with_label_error(coded: DataFrame, label: str = "label", name: str = "label_error", few: int = FEW_LABELS) -> DataFrame:
    """Adds the error summed over rows of the same label, null labels together.

    Totals are summed before they are joined: broadcast where there are at most ``few`` labels, else under keys with a
    salt, so that a label with very many rows is spread over tasks.
    """
    key, salt = fresh(coded, "_label"), fresh(coded, "_salt")
    totals = staged(coded.groupBy(F.col(label).alias(key)).agg(F.sum("error").alias(name)), "labels")
    same = F.col(label).eqNullSafe(F.col(key))
    if totals.limit(few + 1).count() <= few:
        return coded.join(F.broadcast(totals), same).drop(key)
    spread = totals.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn(f"{salt}_", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col(f"{salt}_") == F.col(salt))).drop(key, salt, f"{salt}_")


def compress(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, bits: int = 4) -> DataFrame:
    """``ident``, code, error, label_error and codebooks_sha256 of every usable vector.

    Null and empty vectors and those with a null or non-finite component have no row; an empty table gives an empty
    result. Repeated rows are coded alike, each with its own row, and count each. Other columns may have any name.
    Components are cut to +-65,536.
    """
    base = rows.select(F.col(ident).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    books = learn(base, "id", "v", parts, entries, rounds, bits)
    coded = staged(encode(base, books, "v"), "codes")
    out = with_label_error(coded)
    return out.select(F.col("id").alias(ident), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
