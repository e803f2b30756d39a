"""Token ids packed into fixed-length rows and written as binary files.

Documents longer than a row are split without loss into full rows and a rest. All pieces are placed by best-fit
decreasing: the longest first, each into the open row with the least room that still suffices, found by walking a
segment tree over capacities. A pack of bounded size is written as
  <name>.ids    rows x length token ids, uint16 or uint32, little endian, padded
  <name>.cu     int32: per row the number of segments, then their cumulative lengths from 0
  <name>.pos    one bit a slot, set where positions restart at 0: at every segment and where the padding begins
  <name>.arrow  one row a piece: doc, doc_id, part, row, start, length
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import bpe
from .shared import new_folder, staged, tidy

#: Tokens in a pack at most, but for its last document.
PACK = 2_000_000


class Room:
    """Open rows by free capacity: a segment tree whose nodes count the rows below them."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, free: int, by: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of at least ``need``, as (capacity, row), removed from the tree."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down to its leftmost row
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._add(free, -1)
        return free, self.rows[free].pop()


def place(sizes: list[int], length: int) -> tuple[list[tuple[int, int]], int]:
    """(row, start) of every piece, and how many rows there are; sizes are from 1 to ``length``."""
    room, n_rows, out = Room(length), 0, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[i])
        if found is None:
            found, n_rows = (length, n_rows), n_rows + 1
        free, row = found
        out[i] = (row, length - free)
        if free > sizes[i]:
            room.put(free - sizes[i], row)
    return out, n_rows


def pack(docs: list[np.ndarray], length: int, pad: int, dtype: str) -> dict:
    """The arrays of one pack; ``pieces`` has (doc, part, row, start, size) by row and start."""
    pieces = [(d, p, a, min(length, len(ids) - a)) for d, ids in enumerate(docs) for p, a in enumerate(range(0, len(ids), length))]
    where, n_rows = place([x[3] for x in pieces], length)
    ids, fresh = np.full((n_rows, length), pad, dtype), np.zeros((n_rows, length), bool)
    cu: list[list[int]] = [[0] for _ in range(n_rows)]
    table = []
    for (row, start), (d, p, a, n) in sorted(zip(where, pieces, strict=True)):
        ids[row, start : start + n] = docs[d][a : a + n]
        fresh[row, start] = True
        if start + n < length:
            fresh[row, start + n] = True
        cu[row].append(start + n)
        table.append((d, p, row, start, n))
    flat = np.array([x for c in cu for x in (len(c) - 1, *c)], "<i4")
    return {"ids": ids, "cu": flat, "pos": np.packbits(fresh), "pieces": table, "rows": n_rows}


def positions(bits: bytes, rows: int, length: int) -> np.ndarray:
    """Position ids, counted from the last restart in each row."""
    fresh = np.unpackbits(np.frombuffer(bits, np.uint8))[: rows * length].reshape(rows, length)
    at = np.arange(length, dtype=np.int32)
    return at - np.maximum.accumulate(np.where(fresh, at, np.int32(0)), axis=1)


def _writer(path: str, pattern: str, folder: str, length: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        store, base = fs.FileSystem.from_uri(folder)
        dtype = "<u2" if max(pad, len(coder.table)) < 2**16 else "<u4"
        docs: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            made = pack(docs, length, pad, dtype)
            for kind in ("ids", "cu", "pos"):
                with store.open_output_stream(f"{base}/{name}.{kind}") as f:
                    f.write(made[kind].tobytes())
            # A document without tokens has one line with no place, so none is lost.
            lines = sorted([(d, p, r, a, n) for d, p, r, a, n in made["pieces"]] + [(d, 0, -1, 0, 0) for d, ids in enumerate(docs) if not len(ids)])
            cols = list(zip(*lines, strict=True))
            table = pa.table({"doc": pa.array(cols[0], pa.int32()), "doc_id": pa.array([names[d] for d in cols[0]], pa.int64())} | {k: pa.array(c, pa.int32()) for k, c in zip(("part", "row", "start", "length"), cols[1:], strict=True)})
            with store.open_output_stream(f"{base}/{name}.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
                w.write_table(table)
            about = json.dumps({"length": length, "rows": made["rows"], "dtype": dtype, "pad": pad})
            out = pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "about": [about], "n_docs": [len(docs)], "n_tokens": [held]})
            docs.clear()
            names.clear()
            return out

        for batch in (part for big in batches for part in bpe.slices(big)):
            flat, sizes = coder.encode_many(batch.column(1))
            flat = flat.astype(dtype)
            for ident, ids in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                docs.append(ids)
                names.append(ident)
                held += len(ids)
                if held >= PACK or len(docs) >= PACK // 10:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return run


def write_packed(docs: DataFrame, path: str, pattern: str, length: int = 2048, pad: int = 50256) -> DataFrame:
    """Writes every whole text; one row a pack: file (without suffix), about (JSON), n_docs, n_tokens.

    Reads doc_id (null stays null) and text (null counts as empty, texts of any length are split without loss). Packs
    are made within input partitions, without a shuffle; a task that is run again writes files of other names, and only
    those of the attempt that counted are listed. Every row is a document of its own, also rows that repeat; an empty
    table gives no packs.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    folder = new_folder(spark, "packed")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(_writer(path, pattern, folder, length, pad)), "file string, about string, n_docs bigint, n_tokens bigint")
    return staged(rows, "packs")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, about in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, base = fs.FileSystem.from_uri(file)
            a = json.loads(about)
            raw = {}
            for kind in ("ids", "cu", "pos", "arrow"):
                with store.open_input_stream(f"{base}.{kind}") as f:
                    raw[kind] = f.read()
            ids = np.frombuffer(raw["ids"], a["dtype"]).reshape(-1, a["length"])
            at = positions(raw["pos"], len(ids), a["length"])
            cu, row_starts, i = np.frombuffer(raw["cu"], "<i4"), [], 0
            while i < len(cu):
                row_starts.append(set(cu[i + 1 : i + 2 + cu[i]].tolist()))
                i += 2 + cu[i]
            t = pa.ipc.open_file(pa.BufferReader(raw["arrow"])).read_all().to_pydict()
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_parts", "file", "first_row", "first_start", "ids_sha256", "sound")}
            k, n = 0, len(t["doc"])
            while k < n:
                j, parts, sound = k, [], True
                while j < n and t["doc"][j] == t["doc"][k]:
                    r, s, m = t["row"][j], t["start"][j], t["length"][j]
                    if m:
                        parts.append(ids[r, s : s + m])
                        sound &= s in row_starts[r] and s + m in row_starts[r] and at[r, s] == 0 and at[r, s + m - 1] == m - 1
                    j += 1
                whole = np.concatenate(parts).astype("<u4") if parts else np.empty(0, "<u4")
                for key, v in zip(out, (t["doc_id"][k], len(whole), len(parts), file, t["row"][k], t["start"][k], hashlib.sha256(whole.tobytes()).hexdigest(), bool(sound)), strict=True):
                    out[key].append(v)
                k = j
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["n_parts"], pa.int32()), pa.array(out["file"], pa.string()), pa.array(out["first_row"], pa.int32()), pa.array(out["first_start"], pa.int32()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["sound"], pa.bool_())], list(out))


def read_packed(packs: DataFrame) -> DataFrame:
    """One row a document, read back from the files: doc_id, n_tokens, n_parts, file, first_row and first_start (-1 and 0
    without tokens), ids_sha256 (of the ids as little-endian uint32), and sound: its segments lie at cumulative lengths and their positions restart."""
    ship(packs.sparkSession)
    n = max(1, packs.count())
    return packs.select("file", "about").repartition(n).mapInArrow(tidy(_reader), "doc_id bigint, n_tokens bigint, n_parts int, file string, first_row int, first_start int, ids_sha256 string, sound boolean")
