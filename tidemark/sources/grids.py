"""A folder of JSON artifacts whose parameters are in their names, and pairs that replicate each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the name of a grid's artifact.
GRID = r"review_adapter-t([123])s([0-9.]+)(?:\.json)?$"
# What has to be equal for two runs to be one procedure run twice.
DATA_KEYS = ["n_train", "n_eval", "eval_seed", "cross_corpus"]
TEACHER_KEYS = ["escalation_threshold", "slip_rate"]
SCHEMA = """teacher struct<reviewer:string, escalation_threshold:int, slip_rate:double, train_target_agreement:double>, adapter struct<accuracy:double, recall:double, unparsed:bigint, validity:struct<quotable:boolean>>,
 adapter_vs_teacher struct<accuracy:double>, hyperparameters map<string,string>, data struct<n_train:bigint, n_eval:bigint, eval_seed:bigint, cross_corpus:boolean>"""


def artifacts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(artifact and the fields of SCHEMA): one row a JSON document; fields that lack are null, what isn't JSON has no row.

    A document's name is that of its file, or of a folder ``artifact=name`` that it was written to, without the ending.
    """
    name = F.regexp_extract("_metadata.file_path", r"artifact=([^/]+)/", 1)
    name = F.when(name != "", name).otherwise(F.regexp_replace("_metadata.file_name", r"\.json$", ""))
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder, wholetext=True)
    sound = rows.where(F.try_parse_json("value").isNotNull())
    return sound.select(F.url_decode(name).alias("artifact"), F.from_json("value", SCHEMA).alias("j")).select("artifact", "j.*")


def grid(found: DataFrame, pattern: str = GRID) -> DataFrame:
    """One row for each artifact whose name has the grid's parameters; others, which were made in another way, stay out."""
    row = found.where(F.col("artifact").rlike(pattern))
    return row.select(
        "artifact", F.col("teacher.reviewer").alias("reviewer"), F.regexp_extract("artifact", pattern, 1).cast("int").alias("threshold"), F.regexp_extract("artifact", pattern, 2).cast("double").alias("slip_rate"),
        F.col("teacher.train_target_agreement").alias("teacher_agrees_with_world"), F.col("adapter.accuracy").alias("adapter_agrees_with_world"), F.col("adapter_vs_teacher.accuracy").alias("adapter_agrees_with_teacher"),
        F.col("adapter.recall").alias("adapter_recall"), F.col("adapter.unparsed").alias("adapter_unparsed"), F.col("adapter.validity.quotable").alias("quotable"),
    )


def ceilings(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How far below the best that is possible against a teacher who slips, 1 - s, adapters stay; and how many of them agree
    with the teacher more than two passes of the teacher would with each other."""
    s, a = F.col("slip_rate"), F.col("adapter_agrees_with_teacher")
    below, retest = a - (1 - s), a - ((1 - s) * (1 - s) + s * s)
    gap = F.col("adapter_agrees_with_world") - F.col("teacher_agrees_with_world")
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.median(below), 4).alias("residual_median"), F.round(F.min(below), 4).alias("residual_min"), F.round(F.max(below), 4).alias("residual_max"),
        F.round(F.median(retest), 4).alias("retest_median"), F.count_if(retest > 0).alias("exceeding"), F.round(F.median(gap), 4).alias("gap_median"), F.count_if(gap > 0).alias("better"),
    )


def twins(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(named, grid, mismatches and differences) of each pair (named, grid) of which both halves are there.

    ``mismatches`` names what differs though it may not; a pair with any is no pair of twins.
    """
    a, b = found.alias("a"), found.alias("b")
    both = pairs.join(a, F.col("named") == F.col("a.artifact")).join(b, F.col("grid") == F.col("b.artifact"))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    entries = lambda t: F.array_sort(F.map_entries(F.coalesce(f"{t}.hyperparameters", F.create_map().cast("map<string,string>"))))
    data = F.lit(True)
    for k in DATA_KEYS:
        data = data & same(f"data.{k}")
    bad = [F.when(~entries("a").eqNullSafe(entries("b")), "hyperparameters"), F.when(~data, "data"), *[F.when(~same(f"teacher.{k}"), f"teacher.{k}") for k in TEACHER_KEYS]]
    apart = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
    return both.select(
        "named", "grid", F.array_compact(F.array(*bad)).alias("mismatches"), F.col("a.teacher.slip_rate").alias("slip_rate"), same("teacher.train_target_agreement").alias("targets_identical"),
        apart("adapter.accuracy").alias("delta_vs_world"), apart("adapter_vs_teacher.accuracy").alias("delta_vs_teacher"), apart("teacher.train_target_agreement").alias("target_agreement_delta"),
    )


def bound(pairs: DataFrame) -> DataFrame:
    """(targets_identical, n_pairs, max, median, exactly_identical): how far a figure moves between twins, apart for those
    whose teachers gave the same targets; pairs with a mismatch are left out."""
    sound = pairs.where(F.size("mismatches") == 0)
    each = sound.withColumn("d", F.explode(F.array("delta_vs_world", "delta_vs_teacher")))
    moved = each.groupBy("targets_identical").agg(F.round(F.max("d"), 4).alias("max"), F.round(F.median("d"), 4).alias("median"))
    n = sound.groupBy("targets_identical").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("delta_vs_world") == 0).alias("exactly_identical"))
    return n.join(moved, "targets_identical").select("targets_identical", "n_pairs", "max", "median", "exactly_identical")
