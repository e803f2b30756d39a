"""Tasks from reports, and what reviewers with stated standards do with proposals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels as L
from ..functions.rng import uniform
from ..functions.text import PATTERN


def chunks(rows: DataFrame, group: str, order: str, size: int = 8) -> DataFrame:
    """Runs of ``size`` rows within each group, in order; a remainder is dropped. Adds chunk and pos (from 0)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("_p", place).withColumn("_n", n).where(F.floor(F.col("_p") / size) < F.floor(F.col("_n") / size)).withColumn("chunk", F.floor(F.col("_p") / size)).withColumn("pos", (F.col("_p") % size).cast("int")).drop("_p", "_n")


def evidence(fact_ids: Column, counted: Column | None = None) -> Column:
    """Aggregate: distinct facts of the pattern that a task's reports show; ``counted`` leaves reports out."""
    facts = fact_ids if counted is None else F.when(counted, fact_ids)
    return F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list(facts))), F.array(*map(F.lit, PATTERN))))


def carriage(tasks: DataFrame) -> DataFrame:
    """(task, compartment, carries) for each of the four compartments."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("compartment"), (F.col("mask").bitwiseAND(1 << i) != 0).alias("carries")) for i, n in enumerate(L.COMPARTMENTS)]))
    return tasks.select("task", rows.alias("x")).select("task", "x.*")


@dataclass(frozen=True)
class Reviewer:
    """One reviewer's standard; see ``review``."""

    name: str
    threshold: int = 3
    ruling: L.Ruling = L.KEEP
    ceiling: tuple[int, int] = (1, 1)
    slip_rate: float = 0.0
    revision_rate: float = 1.0
    names_grounds: bool = True
    escalates: bool = True
    prohibited: tuple[tuple[int, str], ...] = ()
    purpose: str = "fleet_training"
    blind: bool = False


# The reviewers of the standard ensemble.
ENSEMBLE = [
    Reviewer("by-the-book"), Reviewer("two-of-three", threshold=2), Reviewer("any-one", threshold=1), Reviewer("releaser", ruling=L.DROP),
    Reviewer("inattentive", slip_rate=0.15), Reviewer("terse", revision_rate=0.25), Reviewer("unexplained", names_grounds=False), Reviewer("no-escalation", escalates=False),
]


def review(tasks: DataFrame, reviewers: list[Reviewer] = ENSEMBLE, seed: int = 7) -> DataFrame:
    """Reviews of every proposal by every reviewer: task, analyst, action, grounds, reasons, corrected_verdict,
    corrected_sens, corrected_mask.

    ``tasks`` has task, evidence (and seen_evidence for blind reviewers), sens, mask, and the proposal as p_verdict, p_sens,
    p_mask. A task without a proposal has no review. Slip and revision are drawn apart, by reviewer and task.
    """
    # Reviewers are a column of parameters, so one chain of expressions serves them all, in one pass over the tasks.
    veto = [sum(bit for bit, use in r.prohibited if use == r.purpose) for r in reviewers]
    rows = [F.struct(F.lit(r.name).alias("analyst"), F.lit(r.threshold).alias("thr"), F.lit(0 in r.ruling.capacities).alias("lowers"), F.lit(r.ruling.floor).alias("floor"), F.lit(r.ruling.drop).alias("drop"), F.lit(r.ceiling[0]).alias("c_sens"), F.lit(r.ceiling[1]).alias("c_mask"), F.lit(float(r.slip_rate)).alias("slip"), F.lit(float(r.revision_rate)).alias("rev"), F.lit(r.names_grounds).alias("told"), F.lit(r.escalates).alias("esc"), F.lit(r.blind).alias("blind"), F.lit(v).alias("veto")) for r, v in zip(reviewers, veto, strict=True)]
    seen = "seen_evidence" if "seen_evidence" in tasks.columns else "evidence"
    base = tasks.where("p_verdict IS NOT NULL").select("task", "sens", "mask", "p_verdict", "p_sens", "p_mask", "evidence", F.col(seen).alias("seen_evidence"), F.explode(F.array(*rows)).alias("r")).select("*", "r.*").drop("r")
    drawn = lambda purpose: uniform(seed, F.col("analyst"), F.col("task"), purpose)

    def disposition(sens: str, mask: str) -> Column:
        fits = (F.col(sens) <= F.col("c_sens")) & (F.col(mask).bitwiseAND(F.bitwise_not(F.col("c_mask"))) == 0)
        return F.when(F.col(mask).bitwiseAND(F.col("veto")) != 0, "PURPOSE_PROHIBITED").when(fits, "RELEASABLE").when(F.col(sens) > F.col("c_sens"), "LEVEL_ABOVE_CEILING").otherwise("COMPARTMENT_NOT_HELD")

    one = base.select(
        "*", (F.when(F.col("blind"), F.col("seen_evidence")).otherwise(F.col("evidence")) >= F.col("thr")).alias("held"), drawn("slip").alias("u1"), drawn("revise").alias("u2"),
        F.when(F.col("lowers"), F.least("sens", "floor")).otherwise(F.col("sens")).alias("own_sens"), F.when(F.col("lowers") & F.col("drop"), 0).otherwise(F.col("mask")).alias("own_mask"),
    )
    two = one.select("*", (F.col("held") != (F.col("u1") < F.col("slip"))).alias("own"), disposition("p_sens", "p_mask").alias("judged"), disposition("own_sens", "own_mask").alias("corrected"))
    three = two.select("*", (F.col("own") != F.col("p_verdict")).alias("on_verdict"), (F.col("judged") != "RELEASABLE").alias("on_release"))
    action = (
        F.when(~F.col("on_verdict") & ~F.col("on_release"), "accept").when(F.col("esc") & F.col("on_release") & (F.col("corrected") == "COMPARTMENT_NOT_HELD"), "escalate")
        .when(F.col("u2") < F.col("rev"), "revise").otherwise("reject")
    )
    four = three.select("*", action.alias("action"))
    grounds = F.array_compact(F.array(F.when(F.col("told") & F.col("on_verdict"), F.lit("verdict")), F.when(F.col("told") & F.col("on_release"), F.lit("release"))))
    reasons = F.array_compact(F.array(F.when(F.col("told") & F.col("on_release"), F.col("judged"))))
    by = lambda accepted, other: F.when(F.col("action") == "accept", F.col(accepted)).when(F.col("action") != "reject", F.col(other))
    return four.select("task", "analyst", "action", grounds.alias("grounds"), reasons.alias("reasons"), by("p_verdict", "own").alias("corrected_verdict"), by("p_sens", "own_sens").alias("corrected_sens"), by("p_mask", "own_mask").alias("corrected_mask"))


def contributions(reviews: DataFrame) -> DataFrame:
    """Votes (task, who, verdict); escalations and rejections give none."""
    return reviews.where(F.col("action").isin("accept", "revise")).select("task", F.col("analyst").alias("who"), F.col("corrected_verdict").alias("verdict"))


def supervision_yield(reviews: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts by action, and how many reviews supervise, locate, and are right. ``truth`` has task and truth."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    is_ = lambda a: F.col("action") == a
    right = F.coalesce(F.col("corrected_verdict") == F.col("truth"), F.lit(False))
    return reviews.join(truth.select("task", "truth"), "task", "left").agg(
        F.count("*").alias("n"), count(is_("accept")).alias("accepted"), count(is_("revise")).alias("revised"), count(is_("escalate")).alias("escalated"), count(is_("reject")).alias("rejected"),
        count(F.col("corrected_verdict").isNotNull()).alias("supervised"), count(~is_("accept") & (F.size("grounds") > 0)).alias("located"), count(right).alias("correct"),
    )


def release_recovery(reviews: DataFrame, tasks: DataFrame, ceiling: tuple[int, int] = (1, 1)) -> DataFrame:
    """Proposals that can't be released at the ceiling: how often a reviewer objected, corrected, and made it releasable."""
    c = L.label(*ceiling, 3)
    stuck = tasks.where(~L.dominates(c, L.label(F.col("p_sens"), F.col("p_mask")))).select("task")
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    fixed = F.col("corrected_sens").isNotNull() & (F.col("action") != "accept")
    free = fixed & L.dominates(c, L.label(F.col("corrected_sens"), F.col("corrected_mask")))
    return reviews.join(stuck, "task", "left_semi").agg(F.count("*").alias("n"), count(F.col("action") != "accept").alias("objections"), count(fixed).alias("corrections"), count(F.coalesce(free, F.lit(False))).alias("releasable"), count(F.col("action") == "escalate").alias("escalated"))


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """n_items, n_raters, observed, expected, kappa over items of the most frequent panel size (of equals the larger).

    Items of another size are dropped; with fewer than two raters all figures are 0, and kappa is 0 where chance agrees
    always.
    """
    counts = ratings.groupBy(item, category).agg(F.count("*").alias("n"))
    items = counts.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    panel = items.groupBy("r").agg(F.count("*").alias("k")).agg(F.max(F.struct("k", "r")).alias("m")).select(F.col("m.r").alias("r"))
    kept = items.join(F.broadcast(panel), "r")
    n, r = F.col("n_items"), F.col("n_raters")
    agreed = F.when(F.col("r") > 1, (F.col("sq") - F.col("r")) / (F.col("r") * (F.col("r") - 1)))
    head = kept.agg(F.count("*").alias("n_items"), F.coalesce(F.max("r"), F.lit(0)).alias("n_raters"), F.avg(agreed).alias("obs"))
    sums = counts.join(kept.select(item), item, "left_semi").groupBy(category).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    both = head.join(F.broadcast(sums))
    usable = (r >= 2) & (n > 0)
    exp = F.when(usable, F.col("sq") / F.greatest((n * r).cast("double") * (n * r), F.lit(1.0))).otherwise(0.0)
    obs = F.when(usable, F.col("obs")).otherwise(0.0)
    two = both.select("n_items", "n_raters", obs.alias("observed"), exp.alias("expected"))
    return two.withColumn("kappa", F.when((F.col("expected") >= 1) | (F.col("n_raters") < 2) | (F.col("n_items") == 0), 0.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
