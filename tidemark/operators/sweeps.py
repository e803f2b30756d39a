"""Grids of fleets: what a wrong share, shared schools, a blind channel or few tasks do to a consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import hashed, uniform
from .stats import cluster_bootstrap


def majority(fleet: int) -> int:
    return fleet // 2 + 1


# Named shares of a fleet.
RUNGS = {"none": 0.0, "one-third": 1 / 3, "majority": None, "seven-ninths": 7 / 9, "all-but-one": -1.0, "unanimous": 1.0}


def ladder(fleet: int, rungs: list[str] | None = None) -> list[int]:
    """Sorted distinct counts of named shares; halves go to the even number."""
    at = {"majority": majority(fleet), "all-but-one": fleet - 1}
    return sorted({at.get(r, round(fleet * (RUNGS[r] or 0.0))) for r in rungs or RUNGS})


def fleet_votes(tasks: DataFrame, fleet: int, counts: list[int], slip: float = 0.0, seed: int = 7, blind: bool = False, need: int = 3) -> DataFrame:
    """(n_wrong, task, who, verdict, truth): fleets of which the first n_wrong hold a wrong standard, one fact less than the
    ``need`` that are true, or with ``blind`` don't see one channel. ``tasks`` has task, evidence, seen_evidence."""
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("n_wrong"), F.lit(w).alias("who")) for c in counts for w in range(fleet)]))
    rows = tasks.select("task", "evidence", "seen_evidence", grid.alias("g")).select("*", "g.*")
    truth = F.col("evidence") >= need
    standard = F.col("seen_evidence") >= need if blind else F.col("evidence") >= need - 1
    own = F.when(F.col("who") < F.col("n_wrong"), standard).otherwise(truth)
    slips = uniform(seed, F.col("n_wrong"), F.col("who"), F.col("task")) < slip
    return rows.select("n_wrong", "task", "who", (own != slips).alias("verdict"), truth.alias("truth"))


def consensus_by_wrong(votes: DataFrame) -> DataFrame:
    """(n_wrong, accuracy, unanimous): majority labels (a tie is true) against the truth, and the share without dissent."""
    t = votes.groupBy("n_wrong", "task").agg(F.sum(F.col("verdict").cast("long")).alias("v"), F.count("*").alias("n"), F.max("truth").alias("truth"))
    return t.groupBy("n_wrong").agg(F.avg(((2 * F.col("v") >= F.col("n")) == F.col("truth")).cast("double")).alias("accuracy"), F.avg(((F.col("v") == 0) | (F.col("v") == F.col("n"))).cast("double")).alias("unanimous"))


def cliff(cells: DataFrame, safe: float = 0.95) -> DataFrame:
    """highest_safe and lowest_broken number of wrong standards."""
    return cells.agg(F.max(F.when(F.col("accuracy") >= safe, F.col("n_wrong"))).alias("highest_safe"), F.min(F.when(F.col("accuracy") < safe, F.col("n_wrong"))).alias("lowest_broken"))


def school_fleets(draws: DataFrame, schools: int, fleet: int, rate: float, seed: int = 7) -> DataFrame:
    """(draw, wrong): how many of a fleet are wrong in each of ``draws`` (draw) if schools are wrong as a whole."""
    wrong = [F.when(uniform(seed, F.col("draw"), k) < rate, F.lit(len(range(k, fleet, schools)))).otherwise(0) for k in range(schools)]
    return draws.select("draw", sum(wrong[1:], wrong[0]).cast("long").alias("wrong"))


def decode_stability(answers: DataFrame) -> DataFrame:
    """tasks, differing, unparsed: tasks whose repeated answers differ; no answer is an answer of its own."""
    t = answers.groupBy("task").agg(F.count_distinct(F.coalesce(F.col("answer").cast("string"), F.lit("none"))).alias("k"), F.sum(F.col("answer").isNull().cast("long")).alias("u"))
    return t.agg(F.count("*").alias("tasks"), F.sum((F.col("k") > 1).cast("long")).alias("differing"), F.sum("u").alias("unparsed"))


def clearance_inference(fleet: DataFrame, tag) -> DataFrame:
    """accuracy of naming each tag's most common level, groups, and prior, that of the whole fleet's."""
    c = fleet.withColumn("tag", tag).groupBy("tag", "sens").agg(F.count("*").alias("n"))
    per = c.groupBy("tag").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("accuracy"), F.count("*").alias("groups"))
    prior = fleet.groupBy("sens").count().agg((F.max("count") / F.sum("count")).alias("prior"))
    return per.join(F.broadcast(prior))


def half_width(trials: DataFrame, resamples: int = 200, seed: int = 7) -> DataFrame:
    """Half width of the bootstrap interval, and twice that: the smallest difference it can show."""
    return cluster_bootstrap(trials, resamples, seed=seed).select(((F.col("high") - F.col("low")) / 2).alias("half_width"), (F.col("high") - F.col("low")).alias("detectable"))


def latent_slice(tasks: DataFrame, size: int, seed: int = 7) -> DataFrame:
    """``size`` tasks drawn among those that show all three facts, nested in size."""
    return tasks.where("evidence >= 3").orderBy(hashed(seed, F.col("task"), "slice"), "task").limit(size)


def compare_models(scores: DataFrame) -> DataFrame:
    """(a, b, gap, resolved) for pairs of measurements (name, point, low, high): neither covers the other's point."""
    a, b = scores.alias("a"), scores.alias("b")
    out = ~F.col("a.point").between(F.col("b.low"), F.col("b.high")) & ~F.col("b.point").between(F.col("a.low"), F.col("a.high"))
    return a.join(b, F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), (F.col("a.point") - F.col("b.point")).alias("gap"), out.alias("resolved"))
