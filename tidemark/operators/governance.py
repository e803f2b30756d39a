"""Which tasks to audit, what an audit corrects, and what withholding answers costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rng import hashed, uniform


def margin() -> Column:
    """|2 votes - seen| / seen, 1 if unseen."""
    return F.when(F.col("seen") > 0, F.abs(2 * F.col("votes") - F.col("seen")) / F.col("seen")).otherwise(F.lit(1.0))


def with_residuals(view: DataFrame) -> DataFrame:
    """Adds residual: votes - seen * rate of the task's evidence stratum."""
    r = view.groupBy("evidence").agg((F.sum("votes") / F.nullif(F.sum("seen"), F.lit(0))).alias("_r"))
    return view.join(F.broadcast(r), "evidence").withColumn("residual", F.col("votes") - F.col("seen") * F.coalesce("_r", F.lit(0.0))).drop("_r")


def channel_score(deepest: int) -> Column:
    """Tasks that carry the detected channel first, deep evidence before shallow."""
    return F.when(F.col("carries"), 0.0).otherwise(1.0) + (1 - F.col("evidence") / F.lit(float(max(deepest, 1))))


#: Score of a task by policy name; the lowest is audited first. Callers may add their own.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "margin": lambda v: v.withColumn("score", margin()),
    "posterior": lambda v: v.withColumn("score", F.abs(F.col("posterior") - 0.5)),
    "consensus": lambda v: v.withColumn("score", -margin()),
    "channel": lambda v: v.withColumn("score", channel_score(v.agg(F.coalesce(F.max("evidence"), F.lit(0))).first()[0])),
    "deviation": lambda v: with_residuals(v).withColumn("score", -F.abs("residual")),
    "shortfall": lambda v: with_residuals(v).withColumn("score", F.col("residual")),
    "uniform": lambda v: v.withColumn("score", hashed(4242, F.col("task")).cast("double")),
    "oracle": lambda v: v.withColumn("score", F.when(F.col("label") != F.col("truth"), 0.0).otherwise(1.0)),
}


def select(view: DataFrame, policy: str, count: int) -> DataFrame:
    """The ``count`` tasks with the lowest score, ties by task; more than there are is refused."""
    scored = POLICIES[policy](view)
    if view.limit(count).count() < count:
        raise ValueError("the budget exceeds the pool")
    return scored.orderBy("score", "task").limit(count).select("task", "score")


def selective_risk(view: DataFrame, policy: str, budgets: list[int]) -> DataFrame:
    """budget, coverage, risk, caught, precision after withholding the first tasks of a policy. ``view`` has label, truth."""
    place = F.row_number().over(Window.orderBy("score", "task"))
    # Only tasks within the largest budget are put in order.
    first = POLICIES[policy](view).orderBy("score", "task").limit(max(budgets)).withColumn("place", place).select("task", "place")
    wrong = (F.col("label") != F.col("truth")).cast("long")
    all_ = view.agg(F.count("*").alias("pool"), F.sum(wrong).alias("errors"))
    held = view.join(first, "task").select("place", wrong.alias("wrong"))
    cuts = view.sparkSession.createDataFrame([(b,) for b in budgets], "budget int")
    per = cuts.join(held, F.col("place") <= F.col("budget"), "left").groupBy("budget").agg(F.coalesce(F.sum("wrong"), F.lit(0)).alias("caught"))
    rest = F.col("pool") - F.col("budget")
    return per.join(F.broadcast(all_)).select(
        "budget", (rest / F.col("pool")).alias("coverage"), F.when(rest > 0, (F.col("errors") - F.col("caught")) / rest).otherwise(0.0).alias("risk"), "caught", F.when(F.col("budget") > 0, F.col("caught") / F.col("budget")).otherwise(0.0).alias("precision"),
    )


def first_budget_halving(cells: DataFrame, errors: str = "errors") -> DataFrame:
    """Smallest budget whose errors are at most half of those at budget 0; null if none."""
    base = cells.where("budget = 0").select((F.col(errors) / 2).alias("half"))
    return cells.join(F.broadcast(base)).agg(F.min(F.when((F.col("budget") > 0) & (F.col(errors) <= F.col("half")), F.col("budget"))).alias("budget"))


def ruling(truth: Column, task: Column, error: float, seed: int) -> Column:
    """An authority's answer: the truth, flipped at a rate."""
    return truth != (uniform(seed, task, "authority") < error)


def audit_outcome(view: DataFrame, anchors: DataFrame, after: DataFrame) -> DataFrame:
    """agreement after an audit on tasks without anchor, and what it corrected beyond the anchors themselves.

    ``view`` has task, label, truth before; ``after`` has task, label when the anchors are known.
    """
    b = view.join(anchors.select("task", F.lit(1).alias("anchored")), "task", "left").join(after.select("task", F.col("label").alias("new")), "task", "left")
    wrong, free = (F.col("label") != F.col("truth")).cast("long"), F.col("anchored").isNull()
    s = b.agg(F.count("*").alias("pool"), F.sum(wrong).alias("errors"), F.sum(F.when(~free, wrong).otherwise(0)).alias("hits"), F.sum(F.when(free & (F.col("new") != F.col("truth")), 1).otherwise(0)).alias("remaining"), F.sum(F.when(free, 1).otherwise(0)).alias("unanchored"))
    ratio = lambda a: F.when(F.col("unanchored") > 0, a / F.col("unanchored")).otherwise(0.0)
    return s.select("pool", "errors", "hits", ratio(F.col("unanchored") - F.col("remaining")).alias("agreement"), ratio(F.col("unanchored") - (F.col("errors") - F.col("hits"))).alias("mechanical"), (F.col("errors") - F.col("hits") - F.col("remaining")).alias("corrected"))


def threshold(rows: DataFrame, repaired: float = 0.95) -> DataFrame:
    """Smallest budget that is repaired and corrected something; null if none."""
    return rows.agg(F.min(F.when((F.col("agreement") >= repaired) & (F.col("corrected") > 0), F.col("budget"))).alias("threshold"))


def lower_median(rows: DataFrame, value: str) -> DataFrame:
    """Lower median with nulls last (censored), smallest and largest, and how many are null."""
    n = rows.count()
    at = rows.select(value, F.row_number().over(Window.orderBy(F.asc_nulls_last(value))).alias("_p")).where(F.col("_p") == (n - 1) // 2 + 1).select(F.col(value).alias("median"))
    return at.join(F.broadcast(rows.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum(F.col(value).isNull().cast("long")).alias("censored"))))


def better(policy: Column, baseline: Column) -> Column:
    """Less than, where null is never."""
    return F.when(policy.isNull(), False).when(baseline.isNull(), True).otherwise(policy < baseline)
