"""WARC archives with a two-level capture index.

Pages become WARC/1.1 records, each a gzip member of its own, in one archive a task. Payloads of at least ``least`` bytes
that are equal are stored once: the page with the largest id is a response, the others are revisits that name it. The
index has two levels: lines sorted by reversed-host URL key and page in compressed blocks of ``BLOCK`` lines, and a sparse
directory with the first and last key and the place of each block. Each shard of the index has its part of the directory
in a file beside it; the shards' own ends, one pair a shard, go to the tasks. A look-up searches the shards and then one
shard's directory by bisection, reads one block's range and, for each line that fits, one record's range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import new_folder, staged, tidy
from .urlrules import host_of

#: Lines in a block of the index.
BLOCK = 300
DATE = "2024-01-01T00:00:00Z"
LEAST = 1000
#: Payloads that occur more than once which are sent to all tasks; more are joined by digest.
FEW = 200_000


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, ``)``, then path and query without the fragment, ASCII lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host_of(url), r"\.")), ","), F.lit(")"), rest)
    return F.translate(key, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A null id is written as an empty field, a null URL as ``urn:none``."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    # A target may hold what header lines can't; the JSON form keeps it whole.
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", "urn:none" if url is None else json.dumps(url)[1:-1]), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head) + b"\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 5, mtime=0)


@dataclass
class Capture:
    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    digest: str
    length: int
    payload: bytes | None


def parse(member: bytes) -> Capture:
    """A record from its gzip member; the lengths in its headers must hold."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record")
    head = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines[1:])
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    body = rest[: int(head["Content-Length"])]
    if len(body) != int(head["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record of another length")
    http, _, payload = body.partition(b"\r\n\r\n")
    kind = head["WARC-Type"]
    uri = head["WARC-Target-URI"]
    ref = number(head["WARC-Refers-To"]) if kind == "revisit" else None
    return Capture(number(head["WARC-Record-ID"]), None if uri == "urn:none" else json.loads(f'"{uri}"'), kind, ref, head["WARC-Payload-Digest"][5:], int(head["WARC-Payload-Length"]), payload if kind == "response" else None)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            key, places, sizes = batch.column(5), [], []
            for p, u, h, d, r in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(p.as_py(), u.as_py(), h.as_buffer().to_pybytes() if h.is_valid else b"", d.as_py(), r.as_py())
                out.write(member)
                places.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([key, batch.column(0), pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["key", "page_id", "file", "place", "size"])
        if out is not None:
            out.close()

    return run


def place_of(key: str, page_id: int | None) -> list:
    """What the index is sorted by; a null id comes first."""
    return [key, page_id is not None, page_id or 0]


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, out, at, lines = f"{uuid.uuid4().hex}.idx", None, 0, []
        directory: list[list] = []

        def flush() -> None:
            nonlocal out, at, lines
            if out is None:
                out = store.open_output_stream(f"{base}/{name}", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode("utf-8", "surrogatepass"), 6)
            out.write(block)
            directory.append([place_of(*lines[0][:2]), place_of(*lines[-1][:2]), at, len(block)])
            at += len(block)
            lines = []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(line)
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode("utf-8", "surrogatepass"))
            ends = [json.dumps(directory[0][0]), json.dumps(directory[-1][1])]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*ends, name, len(directory))], ["first", "last", "shard", "blocks"])

    return run


@dataclass
class Archive:
    """Where the archives and index are; ``captures`` has the key and page of each, ``shards`` one row a shard."""

    folder: str
    captures: DataFrame
    shards: DataFrame


def write(pages: DataFrame, least: int = LEAST) -> Archive:
    """Archives and index of ``pages`` (page_id, url, html), in the shared folder.

    A null html has an empty payload; texts of any length are one record, and other columns are not read. An empty table
    gives an index without shards. Bodies stay in the tasks that read them unless more than FEW payloads occur twice; then
    they are joined by digest, from which short ones, which have no copies, stay apart. Rows that tie for the largest id of a payload are all responses; a null id is a
    response unless another row has the payload. A task that is run again writes files of other names; only those of the
    attempt that counted are in the index.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = new_folder(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("body"), F.sha1(body).alias("digest"))
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), body.alias("body")).where(F.octet_length("body") >= least)
    copies = known.select(F.sha1("body").alias("digest"), "page_id").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = staged(copies, "copies")
    few = copies.limit(FEW + 1).count() <= FEW
    apart = F.concat(F.lit("~"), F.xxhash64("page_id", "url").cast("string"))  # equals no digest, and spreads
    key = F.when(F.octet_length("body") >= least, F.col("digest")).otherwise(apart)
    copies = copies.withColumnRenamed("digest", "same")
    told = rows.withColumn("payload", key).join(F.broadcast(copies) if few else copies, F.col("payload") == F.col("same"), "left")
    refers = F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    laid = staged(told.select("page_id", "url", "body", "digest", refers.alias("refers_to"), url_key(F.col("url")).alias("key")).mapInArrow(tidy(_write(folder)), "key string, page_id bigint, file string, place bigint, size bigint"), "captures")
    sorted_ = laid.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    shards = sorted_.mapInArrow(tidy(_index(folder)), "first string, last string, shard string, blocks bigint")
    return Archive(folder, laid.select("key", "page_id"), staged(shards, "shards"))


class Reader:
    """Look-ups of captures. The directory is sparse: one entry for BLOCK captures; ``shards`` has (first, last, shard)."""

    def __init__(self, folder: str, shards: list[tuple]) -> None:
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.shards = sorted((json.loads(a), json.loads(b), name) for a, b, name in shards)
        self.ends = [s[1] for s in self.shards]
        self.open: dict = {}
        self.directories: dict[str, tuple[list, list]] = {}
        self.last: tuple[tuple, list, list] = ((), [], [])

    def directory(self, shard: str) -> tuple[list, list]:
        """A shard's blocks, and their last keys; those of a few shards are held."""
        held = self.directories.get(shard)
        if held is None:
            if len(self.directories) >= 4:
                self.directories.clear()
            with self.store.open_input_stream(f"{self.base}/{shard}.dir", compression=None) as f:
                blocks = json.loads(f.read().decode("utf-8", "surrogatepass"))
            held = self.directories[shard] = (blocks, [b[1] for b in blocks])
        return held

    def ranged(self, name: str, place: int, size: int) -> bytes:
        f = self.open.get(name)
        if f is None:
            if len(self.open) > 64:
                for x in self.open.values():
                    x.close()
                self.open.clear()
            f = self.open[name] = self.store.open_input_file(f"{self.base}/{name}")
        f.seek(place)
        return f.read(size)

    def block(self, shard: str, place: int, size: int) -> tuple[list, list]:
        """The lines of a block and what they are sorted by; the last one read is held."""
        if self.last[0] != (shard, place):
            lines = [json.loads(x) for x in zlib.decompress(self.ranged(shard, place, size)).decode("utf-8", "surrogatepass").split("\n")]
            self.last = ((shard, place), lines, [place_of(*x[:2]) for x in lines])
        return self.last[1], self.last[2]

    def between(self, low: list, high: list) -> Iterator[list]:
        """The lines from ``low`` to ``high``, by bisection of shards, blocks and lines."""
        s = bisect_left(self.ends, low)
        while s < len(self.shards) and self.shards[s][0] <= high:
            shard = self.shards[s][2]
            blocks, ends = self.directory(shard)
            i = bisect_left(ends, low)
            while i < len(blocks) and blocks[i][0] <= high:
                lines, places = self.block(shard, *blocks[i][2:])
                yield from lines[bisect_left(places, low) : bisect_right(places, high)]
                i += 1
            s += 1

    def lookup(self, key: str) -> list[Capture]:
        """All captures of a URL key, by page id."""
        return [parse(self.ranged(*x[2:5])) for x in self.between([key], [key, 2])]

    def pages(self, key: str, page_id: int | None) -> Iterator[Capture]:
        """The captures of a URL key that one page made."""
        at = place_of(key, page_id)
        return (parse(self.ranged(*x[2:5])) for x in self.between(at, at))


def _read(folder: str, shards: list[tuple]):
    """Rows (key, page_id), each wanted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shards)
        names = ["page_id", "n", "digest", "kind", "refers_to", "claimed"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        rows: list[tuple] = []

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            rows.clear()
            return out

        for batch in batches:
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = 0
                for c in reader.pages(key, page_id):
                    # A response is measured anew; a revisit has no payload, its response's figures are joined to it.
                    n = d = None
                    if c.payload is not None:
                        n, d = len(c.payload), hashlib.sha1(c.payload).hexdigest()
                        if (n, d) != (c.length, c.digest):
                            raise ValueError("a payload differs from its digest")
                    rows.append((c.page_id, n, d, c.kind, c.refers_to, c.digest))
                    found += 1
                    if len(rows) >= 5000:
                        yield done()
                if not found:
                    raise ValueError("a capture is not in the index")
        yield done()

    return run


def read(archive: Archive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every capture.

    Each pair of key and page is looked up through the index, in ranges of the sorted keys, so that a URL with very many
    captures is spread over tasks. The ends of the shards, as many as the index had tasks, go to all tasks.
    """
    shards = [tuple(r) for r in archive.shards.select("first", "last", "shard").collect()]
    wanted = archive.captures.distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    got = staged(wanted.mapInArrow(tidy(_read(archive.folder, shards)), "page_id bigint, n bigint, digest string, kind string, refers_to bigint, claimed string"), "read")
    # Only responses that some revisit names are joined, each once.
    named = got.where("kind = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct()
    full = got.where("kind = 'response'").join(named, "page_id", "left_semi").select(F.col("page_id").alias("to"), F.col("n").alias("full_n"), F.col("digest").alias("full_digest")).distinct()
    out = got.join(full, (got["refers_to"] == full["to"]) & (got["claimed"] == full["full_digest"]), "left")
    return out.select("page_id", F.coalesce("n", "full_n").alias("payload_bytes"), F.coalesce("digest", "full_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of an archive in order, for readers without an index."""
    at = 0
    while at < len(raw):
        start, d = at, zlib.decompressobj(31)
        while not d.eof:
            part = raw[at : at + 65_536]
            if not part:
                raise ValueError("an archive that ends within a record")
            d.decompress(part)
            at += len(part)
        at -= len(d.unused_data)
        yield raw[start:at]
