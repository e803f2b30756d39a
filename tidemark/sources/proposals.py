"""Checked ingest of a model's verdicts: one pass marks rows as taken or refused; rows, reasons and counts come from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels as L

REASONS = ["unknown_task", "truth_differs", "unparsed", "superseded"]
#: Reasons that mean rows and tasks are of different worlds.
MISMATCH = ("unknown_task", "truth_differs")


class ArtifactMismatch(ValueError):
    """The rows don't describe these tasks."""


def checked(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """``rows`` (task, seq, truth, verdict) with reason: null for those that are taken.

    ``tasks`` has task, truth, sens and mask, one row each. The first reason that holds counts: no such task; another truth;
    no verdict; a later row (by seq) of the task has a verdict. A null truth differs from any.
    """
    own = tasks.select(F.col("task").alias("_task"), F.col("truth").alias("_truth"), "sens", "mask")
    both = rows.join(own, F.col("task") == F.col("_task"), "left")
    sound = F.col("_task").isNotNull() & F.coalesce(F.col("truth") == F.col("_truth"), F.lit(False)) & F.col("verdict").isNotNull()
    last = F.max(F.when(sound, F.struct("seq", "verdict"))).over(Window.partitionBy("task"))
    first = F.row_number().over(Window.partitionBy("task", sound).orderBy(F.desc("seq"), F.desc("verdict")))
    why = (
        F.when(F.col("_task").isNull(), "unknown_task").when(~F.coalesce(F.col("truth") == F.col("_truth"), F.lit(False)), "truth_differs").when(F.col("verdict").isNull(), "unparsed")
        .when((F.struct("seq", "verdict") != last) | (first > 1), "superseded")
    )
    return both.withColumn("reason", why).drop("_task", "_truth")


def tally(kept: DataFrame) -> dict[str, int]:
    """Rows by reason, those taken, and all; ``kept`` is what ``checked`` gave, written.

    An ``Observation`` of the pass would tell the same, but a session of Spark 4.1 that has used one can't send models of
    ``pyspark.ml`` to its executors any more (they drag the session's observation manager along). Only one column is read.
    """
    by = {r.reason: r["count"] for r in kept.groupBy("reason").count().collect()}  # one row a reason
    return {"rows": sum(by.values()), "taken": by.get(None, 0), **{r: by.get(r, 0) for r in REASONS}}


def accepted(marked: DataFrame, ruling: L.Ruling = L.KEEP) -> DataFrame:
    """(task, verdict, release): what a reviewer is given: the verdict, and the task's label under the fail-closed ruling."""
    return marked.where("reason IS NULL").select("task", "verdict", L.declassify(L.label(F.col("sens"), F.col("mask"), 0), ruling).alias("release"))


def refused(marked: DataFrame) -> DataFrame:
    """(task, seq, reason)."""
    return marked.where("reason IS NOT NULL").select("task", "seq", "reason")


def load(rows: DataFrame, tasks: DataFrame, scratch, strict: bool = True) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Accepted and refused rows and counts, from one pass that is written to ``scratch``; rows without a verdict are dropped.

    With ``strict`` rows of an unknown task or with another truth raise ArtifactMismatch: figures of two worlds would be
    joined without anybody seeing it.
    """
    kept = scratch.keep(checked(rows, tasks), "proposals")
    counts = tally(kept)
    if strict and any(counts[r] for r in MISMATCH):
        sample = kept.where(F.col("reason").isin(*MISMATCH)).orderBy("task", "seq").limit(3).collect()
        raise ArtifactMismatch(f"{counts}; first: {[(r.task, r.reason) for r in sample]}")
    return accepted(kept), refused(kept), counts
