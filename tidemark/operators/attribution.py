"""Which sources a statement rests on, and what its label should be. Sources are rows (task, pos, sens, mask, fact_ids)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import detect_facts, numbered, without


def contributing(sources: DataFrame, asserted: str = "asserted") -> DataFrame:
    """Sources that carry any asserted fact; ``asserted`` is a column of facts beside each source."""
    return sources.where(F.arrays_overlap("fact_ids", asserted))


def label_over(sources: DataFrame, chosen: Column) -> Column:
    """Aggregate: the joined label of the chosen sources, of none (OPEN, none), at FREETEXT."""
    return L.label(F.coalesce(F.max(F.when(chosen, F.col("sens"))), F.lit(0)), F.coalesce(F.bit_or(F.when(chosen, F.col("mask"))), F.lit(0)), 3)


def outcome(found: Column, true: Column) -> Column:
    """exact, creep (stricter, safe), leak (laxer) or incomparable."""
    same = (found["sens"] == true["sens"]) & (found["mask"] == true["mask"])
    return F.when(same, "exact").when(L.dominates(found, true), "creep").when(L.dominates(true, found), "leak").otherwise("incomparable")


def score(sources: DataFrame, attributed: Column, asserted: str = "asserted") -> DataFrame:
    """Per task: recall and precision of the attributed sources (1 of none), whether both sets are equal, label outcome."""
    true = F.arrays_overlap("fact_ids", asserted)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    s = sources.groupBy("task").agg(n(attributed & true).alias("both"), n(true).alias("t"), n(attributed).alias("a"), label_over(sources, attributed).alias("found"), label_over(sources, true).alias("true"))
    share = lambda k: F.when(F.col(k) == 0, 1.0).otherwise(F.col("both") / F.col(k))
    return s.select("task", share("t").alias("recall"), share("a").alias("precision"), ((F.col("both") == F.col("t")) & (F.col("both") == F.col("a"))).alias("exact_set"), outcome(F.col("found"), F.col("true")).alias("outcome"))


def leave_one_out(tasks: DataFrame, summarise: Callable[[Column], Column]) -> DataFrame:
    """(task, pos, lost, attributed): facts that a task's summary loses without one source. ``tasks`` has task and texts;
    ``summarise`` turns a prompt column into a summary column (a model, or any function of the text)."""
    whole = tasks.select("task", "texts", detect_facts(summarise(numbered(F.col("texts")))).alias("full"), F.explode(F.sequence(F.lit(0), F.size("texts") - 1)).alias("pos"))
    lost = F.array_except("full", detect_facts(summarise(numbered(without(F.col("texts"), F.col("pos"))))))
    return whole.select("task", "pos", lost.alias("lost")).withColumn("attributed", F.size("lost") > 0)


def triage_score(verdict: Column, truth: Column) -> dict[str, Column]:
    return {"correct": verdict == truth, "over": verdict & ~truth, "under": ~verdict & truth}
