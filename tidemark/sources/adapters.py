"""The relations that the operators work on, derived from the driver's tables by rules that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import hashed
from ..functions.text import FACTS, PATTERN

# Each channel's level and compartments (SENSOR 1, LIAISON 2, LEGAL 4, PARTNER 8).
CHANNELS = [
    ("VESSEL_REPORT", 1, 1), ("SENSOR_TRACK", 2, 1), ("PORT_NOTICE", 0, 0), ("CREW_MANIFEST", 2, 4),
    ("PRESS_ITEM", 0, 0), ("LIAISON_TIP", 3, 2), ("DETENTION_RECORD", 2, 4), ("PARTNER_REPORT", 3, 8),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: three to an event, a channel with its label, two facts, a center and a voice."""
    d = table(spark, sf_dir, "documents")
    channel, a, b = F.col("doc_id") % 8, hashed("fact", F.col("doc_id")) % 15, hashed("other", F.col("doc_id")) % 14
    return d.select(
        F.col("doc_id").alias("report_id"), F.floor(F.col("doc_id") / 3).alias("event_id"), _pick([c[0] for c in CHANNELS], channel).alias("report_type"), F.col("source").alias("center"), F.col("lang").alias("voice"),
        _pick([c[1] for c in CHANNELS], channel).alias("sens"), _pick([c[2] for c in CHANNELS], channel).alias("mask"), F.array(_pick(FACTS, a), _pick(FACTS, (a + 1 + b) % 15)).alias("fact_ids"), "text",
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tasks: joined label, distinct evidence of the pattern, the same without the PARTNER channel, truth."""
    r = reports(spark, sf_dir)
    shown = F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list("fact_ids"))), F.array(*map(F.lit, PATTERN))))
    seen = F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("mask").bitwiseAND(8) == 0, F.col("fact_ids"))))), F.array(*map(F.lit, PATTERN))))
    return r.groupBy(F.col("event_id").alias("task")).agg(F.max("sens").alias("sens"), F.bit_or("mask").alias("mask"), shown.alias("evidence"), seen.alias("seen_evidence")).withColumn("truth", F.col("evidence") >= 2)


def clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as analysts with a level and compartments; some share a pseudonym."""
    s = table(spark, sf_dir, "supplier")
    h = hashed("clear", F.col("s_suppkey"))
    return s.select(F.col("s_suppkey").alias("analyst"), F.floor(F.col("s_suppkey") / 2).alias("pseudonym"), (h % 4).cast("int").alias("sens"), (F.floor(h / 4) % 16).cast("int").alias("mask"))


def part_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled tasks (task, sens, mask), most of them without compartments."""
    p = table(spark, sf_dir, "part")
    h = hashed("task", F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("task"), (h % 4).cast("int").alias("sens"), F.when(h % 3 == 0, _pick([1, 2, 4, 8], F.floor(h / 16) % 4)).otherwise(0).alias("mask"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems as votes (task, who, verdict) with planted truth: most suppliers vote the part's, every fifth inverts
    it, and one vote in eight slips. Duplicates stay."""
    l = table(spark, sf_dir, "lineitem")
    truth = F.col("l_partkey") % 2 == 0
    slip = hashed("vote", F.col("l_orderkey"), F.col("l_linenumber")) % 8 == 0
    return l.select(F.col("l_partkey").alias("task"), F.col("l_suppkey").alias("who"), (truth != ((F.col("l_suppkey") % 5 == 0) != slip)).alias("verdict"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials (task, outcome); errors have no outcome."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("task"), F.when(F.col("event_type") != "error", F.col("value") > 30).alias("outcome"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as client updates: round, client, vector of doubles."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("round"), F.col("vec_id").alias("client"), F.col("embedding").cast("array<double>").alias("v"))


#: The same relations for DuckDB, as the beginning of a WITH clause.
SQL = {
    "reports": f"""reports AS (SELECT doc_id AS report_id, doc_id // 3 AS event_id,
  {[c[0] for c in CHANNELS]}[1 + doc_id % 8] AS report_type, source AS center, lang AS voice,
  {[c[1] for c in CHANNELS]}[1 + doc_id % 8] AS sens, {[c[2] for c in CHANNELS]}[1 + doc_id % 8] AS mask,
  [{FACTS}[1 + ('0x' || substr(md5('fact:' || doc_id), 1, 8))::BIGINT % 15],
   {FACTS}[1 + (('0x' || substr(md5('fact:' || doc_id), 1, 8))::BIGINT % 15 + 1 + ('0x' || substr(md5('other:' || doc_id), 1, 8))::BIGINT % 14) % 15]] AS fact_ids, text FROM documents)""",
    "tasks": f"""tasks AS (SELECT event_id AS task, max(sens) AS sens, bit_or(mask) AS mask,
  len(list_intersect(list_distinct(flatten(list(fact_ids))), {PATTERN})) AS evidence,
  coalesce(len(list_intersect(list_distinct(flatten(list(fact_ids) FILTER (mask & 8 = 0))), {PATTERN})), 0) AS seen_evidence,
  len(list_intersect(list_distinct(flatten(list(fact_ids))), {PATTERN})) >= 2 AS truth FROM reports GROUP BY event_id)""",
    "clearances": """clearances AS (SELECT s_suppkey AS analyst, s_suppkey // 2 AS pseudonym, h % 4 AS sens, (h // 4) % 16 AS mask
  FROM (SELECT s_suppkey, ('0x' || substr(md5('clear:' || s_suppkey), 1, 8))::BIGINT AS h FROM supplier))""",
    "part_tasks": """part_tasks AS (SELECT p_partkey AS task, h % 4 AS sens, CASE WHEN h % 3 = 0 THEN 1 << ((h // 16) % 4)::INT ELSE 0 END AS mask
  FROM (SELECT p_partkey, ('0x' || substr(md5('task:' || p_partkey), 1, 8))::BIGINT AS h FROM part))""",
    "votes": """votes AS (SELECT l_partkey AS task, l_suppkey AS who,
  (l_partkey % 2 = 0) <> ((l_suppkey % 5 = 0) <> (('0x' || substr(md5('vote:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT % 8 = 0)) AS verdict FROM lineitem)""",
    "trials": """trials AS (SELECT user_id AS task, CASE WHEN event_type <> 'error' THEN value > 30 END AS outcome FROM events)""",
    "updates": """updates AS (SELECT label AS round, vec_id AS client, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
}
SQL["tasks"] = f"{SQL['reports']}, {SQL['tasks']}"


def using(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
