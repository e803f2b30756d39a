"""URL rules by a sort-merge range join.

A host's labels are reversed (``a.example.com`` gives ``com.example.a.``), so a rule for a host and its subdomains is the
interval of keys that begin with its reversed host. Rules are a table like the URLs. The borders of ranges are taken from a
sample of the URLs' keys; a URL goes to its range, a rule to every range that its interval meets, so a range has the rules
that are open where it begins. In each range rules and URLs are sorted by key together, and one sweep keeps a stack of the
rules whose intervals are open, which are nested. A URL takes the longest rule on the stack whose path its own begins with.
Equal keys are told apart by path and a hash of the row, so a host with very many URLs is spread over ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .shared import fresh, tidy

#: URLs of a range on average, and how many ranges there are at most; a range is swept as a stream, whatever its size.
RANGE, MOST_RANGES = 50_000, 4096
#: Sampled keys for each range, and how much of a key and of a path orders ranges.
SAMPLED, KEY, PATH = 30, 120, 60
OUTPUTS = {"host": "string", "path": "string", "rule": "string", "verdict": "string"}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels reversed, a dot after each; a host's key is a prefix of its subdomains' keys and of no other's."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def reverse_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Open:
    """The rules of one host that are open, by path."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Of rules with the same host and path a block goes before an allow."""
        if path not in self.rules and len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)
        if path not in self.rules or verdict == "block":
            self.rules[path] = (rule, verdict)

    def fits(self, path: str) -> tuple[str, str] | None:
        """The rule with the longest path that ``path`` begins with: one look-up for each length that rules have."""
        for n in self.lengths:
            if n <= len(path) and (found := self.rules.get(path[:n])):
                return found
        return None


class Sweep:
    """A stack of open rules; keys come in order."""

    def __init__(self) -> None:
        self.stack: list[Open] = []

    def _upto(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        self._upto(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Open(key))
        self.stack[-1].add(path, rule, verdict)

    def url(self, key: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict): the most characters of host and path together; of equals a block, then the larger text."""
        self._upto(key)
        fits = [f for o in self.stack if (f := o.fits(path))]
        return max(fits, key=lambda r: (len(r[0]), r[1] == "block", r[0])) if fits else (None, None)


def place(key: Column, path: Column, h: Column) -> Column:
    """What orders URLs over ranges."""
    return F.concat(F.substring(key, 1, KEY), F.lit("\0"), F.substring(path, 1, PATH), F.lit("\0"), F.lower(F.hex(h)))


def borders(places: DataFrame) -> list[str]:
    """First places of all ranges but the first, from a sample by hash; ``places`` has place and h."""
    n = places.count()
    ranges = min(MOST_RANGES, -(-n // RANGE))
    if ranges < 2:
        return []
    some = max(1, n // (SAMPLED * ranges))
    # About SAMPLED * ranges of them, whatever the number of URLs; the limit is far above, for odd hashes.
    got = sorted(r.place for r in places.where(F.pmod("h", F.lit(some)) == 0).select("place").limit(4 * SAMPLED * ranges).collect())
    return sorted({got[i * len(got) // ranges] for i in range(1, ranges)}) if got else []


def _ranged(cuts: list[str], last: str):
    """Adds the range of each place, or with ``last`` (what follows a rule's interval) a row for each range it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_pylist()
            first = [bisect_right(cuts, x) for x in at]
            if last:
                ends = [bisect_right(cuts, x + last) + 1 for x in at]
                rows = pa.array([i for i, (a, e) in enumerate(zip(first, ends, strict=True)) for _ in range(a, e)], pa.int64())
                first = [k for a, e in zip(first, ends, strict=True) for k in range(a, e)]
                b = b.take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *b.columns[:-1]], ["range", *b.schema.names[:-1]])

    return run


def _swept(default: str):
    """Rows (range, key, kind, path, host, rule, verdict, own) in order: rules (kind 0) are taken up, URLs are given out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep = None, Sweep()
        for b in batches:
            rows, found = [], []
            columns = [b.column(i).to_pylist() for i in range(7)]
            for i, (at, key, kind, path, _, rule, verdict) in enumerate(zip(*columns, strict=True)):
                if at != now:
                    now, sweep = at, Sweep()
                if kind:
                    rows.append(i)
                    found.append(sweep.url(key, path))
                else:
                    sweep.rule(key, path, rule, verdict)
            out = b.take(pa.array(rows, pa.int64()))
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([out.column(7), out.column(4), out.column(3), *more], ["own", "host", "path", "rule", "verdict"])

    return run


def table_of(spark, rules) -> DataFrame:
    """Rules as a table (key, path, rule, verdict); a null path is empty, rules without a host or verdict are left out."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    path = F.coalesce("path", F.lit(""))
    return rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(key_of(F.col("host")).alias("key"), path.alias("path"), F.concat("host", path).alias("rule"), "verdict").distinct()


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], ident: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``ident`` columns, host, path, rule and verdict of every row; ``rules`` (verdict, host, path) is a table of any size,
    or a list of such rows.

    A URL that no rule fits, null ones included, gets ``default`` and a null rule. Equal URLs, repeated rows and rows with a
    null id are judged alike, URLs of any length as a whole; an empty table gives an empty result, without rules every
    verdict is ``default``. Of ``ident``, a column that is named like a result gets underscores in front. Other columns may
    have any name.
    """
    spark = pages.sparkSession
    ship(spark)
    ident = ident or ["page_id"]
    own = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(ident)])
    urls = pages.select(own.alias("own"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", key_of(F.col("host")))
    urls = urls.withColumn("h", F.xxhash64(F.to_json(F.struct("own", "host", "path"))))
    urls = urls.withColumn("place", place(F.col("key"), F.col("path"), F.col("h")))
    cuts = borders(urls.select("place", "h"))
    kind = urls.schema["own"].dataType
    none, text = (lambda t: F.lit(None).cast(t)), "string"
    left = urls.select("key", F.lit(1).alias("kind"), "path", "host", none(text).alias("rule"), none(text).alias("verdict"), "own", "place")
    right = table_of(spark, rules).select("key", F.lit(0).alias("kind"), "path", none(text).alias("host"), "rule", "verdict", none(kind).alias("own"), F.substring("key", 1, KEY).alias("place"))
    names = ["range", "key", "kind", "path", "host", "rule", "verdict"]
    schema = T.StructType([*[T.StructField(n, T.IntegerType() if n in ("range", "kind") else T.StringType()) for n in names], T.StructField("own", kind)])
    ranged = left.mapInArrow(_ranged(cuts, ""), schema).unionByName(right.mapInArrow(_ranged(cuts, chr(0x10FFFF)), schema))
    ranged = ranged.repartition("range").sortWithinPartitions("range", "key", "kind")
    out = ranged.mapInArrow(tidy(_swept(default)), T.StructType([T.StructField("own", kind), *[T.StructField(n, T.StringType()) for n in OUTPUTS]]))
    clash = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in OUTPUTS.items()))
    named = [F.col(f"own.c{i}").alias(c if c.lower() not in OUTPUTS else fresh(clash, c)) for i, c in enumerate(ident)]
    return out.select(*named, *OUTPUTS)
