"""Claims whose figures are looked up in JSON documents by paths that are data themselves.

A document is unfolded level by level with ``variant_explode`` into edges: from a container by a segment to what lies there.
A map has an edge for each key, a list one for each index from either end, and one ``field=value`` for the first element
whose field has that value. Paths of any number of claims are then followed together, one join a segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

VERDICTS = ["closes", "bounded", "open"]
CLAIM = "claim string, verdict string, label string, path string, form string"


def _text(v):
    """A value as text: a string as it is, anything else as JSON; null for a null."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind != "VOID", F.to_json(v))


def nodes(documents: DataFrame, scratch: Scratch, deepest: int = 64) -> DataFrame:
    """(doc, parent, node, key, pos, value): every value below the root "$" of each document (doc, body).

    A node's name is its route. A body that isn't JSON has no nodes. One pass a level, so deep documents cost more, large
    ones don't; more than ``deepest`` levels are refused.
    """
    spark = documents.sparkSession
    level = scratch.keep(documents.select("doc", F.lit("$").alias("node"), F.try_parse_json("body").alias("v")).where("v IS NOT NULL"), "level")
    out = None
    for _ in range(deepest + 1):
        found = level.select("doc", "node", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        step = F.coalesce(F.concat(F.lit("."), F.col("key")), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = scratch.keep(found.select("doc", F.col("node").alias("parent"), F.concat("node", step).alias("node"), "key", "pos", F.col("value").alias("v")), "level")
        if not level.limit(1).count():
            break
        rows = level.select("doc", "parent", "node", "key", "pos", _text(F.col("v")).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    else:
        raise ValueError(f"a document has more than {deepest} levels")
    return out if out is not None else level.select("doc", "parent", "node", "key", "pos", F.lit(None).cast("string").alias("value"))


def edges(found: DataFrame) -> DataFrame:
    """(doc, parent, segment, node)."""
    keys = found.where("key IS NOT NULL").select("doc", "parent", F.col("key").alias("segment"), "node")
    listed = found.where("key IS NULL")
    n = listed.groupBy("doc", "parent").agg(F.count("*").alias("n"))
    both = listed.join(n, ["doc", "parent"]).withColumn("segment", F.explode(F.array(F.col("pos").cast("string"), (F.col("pos") - F.col("n")).cast("string"))))
    field = found.where("key IS NOT NULL").select("doc", F.col("parent").alias("node"), F.concat("key", F.lit("="), "value").alias("segment"))
    picked = listed.join(field, ["doc", "node"]).groupBy("doc", "parent", "segment").agg(F.min_by("node", "pos").alias("node"))
    columns = ["doc", "parent", "segment", "node"]
    return keys.unionByName(both.select(*columns)).unionByName(picked.select(*columns))


def readings(claims: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, claim, verdict, label, path, value): each reading of each claim in each document; null for any miss.

    ``claims`` has the columns of CLAIM; ``form`` is a printf pattern for a number, or null for the value as it is. Claims are few and
    are broadcast; readings that have lost their way drop out of the joins, and come back with a null at the end.
    """
    found = scratch.keep(nodes(documents.select("doc", "body"), scratch), "nodes")
    routes = scratch.keep(edges(found), "edges")
    told = claims.select("*", F.split("path", r"\.").alias("segments"))
    docs = documents.select("doc").distinct()
    state = docs.join(F.broadcast(told.select("path", "segments").distinct())).select("doc", "path", "segments", F.lit("$").alias("node"))
    longest = told.agg(F.max(F.size("segments"))).first()[0] or 0
    for i in range(longest):
        on = routes.select("doc", F.col("parent").alias("node"), F.col("segment").alias("_s"), F.col("node").alias("_next"))
        open_ = state.where(F.size("segments") > i).withColumn("_s", F.col("segments")[i])
        moved = open_.join(on, ["doc", "node", "_s"]).select("doc", "path", "segments", F.col("_next").alias("node"))
        state = scratch.keep(state.where(F.size("segments") <= i).select("doc", "path", "segments", "node").unionByName(moved), "state")
    values = state.join(found.select("doc", "node", "value"), ["doc", "node"]).select("doc", "path", "value")
    every = docs.join(F.broadcast(claims))
    shown = F.when(F.col("form").isNotNull() & F.col("value").try_cast("double").isNotNull(), F.printf("form", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    return every.join(values, ["doc", "path"], "left").select("doc", "claim", "verdict", "label", "path", shown.alias("value"))


def payloads(read: DataFrame) -> DataFrame:
    """(doc, claim, verdict, measured, readings): a claim is measured if all its figures were found."""
    one = F.struct("label", "path", "value")
    return read.groupBy("doc", "claim", "verdict").agg((F.count("*") == F.count("value")).alias("measured"), F.array_sort(F.collect_list(one)).alias("readings"))


def argument(claimed: DataFrame) -> DataFrame:
    """(doc, closes, bounded, open, unmeasured): claims by verdict, and the names of those without all their figures."""
    count = [F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in VERDICTS]
    return claimed.groupBy("doc").agg(*count, F.array_sort(F.collect_list(F.when(~F.col("measured"), F.col("claim")))).alias("unmeasured"))
