"""Fleets drawn from the space of clearances, signatures of facts, grids of review and eligibility, latency and cost."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels as L
from ..functions.rng import gauss, hashed, uniform


def assign_fleet(people: DataFrame, ident: str, seed: int = 7) -> DataFrame:
    """``people`` with sens and mask: clearances drawn with replacement from all 64, by a hash of ``ident``."""
    h = hashed(seed, "fleet", F.col(ident)) % 64
    return people.withColumns({"sens": F.floor(h / 16).cast("int"), "mask": (h % 16).cast("int")})


def unmatched(facts: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """Facts of the vocabulary (fact) for which a detector has no terms."""
    known = facts.sparkSession.createDataFrame([(k,) for k, v in terms.items() if v] or [(None,)], "fact string")
    return facts.select("fact").distinct().join(F.broadcast(known), "fact", "left_anti")


def names_of(mask: Column) -> Column:
    """The compartments of a mask, in order of their bits."""
    return F.filter(F.transform(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(1 << i).alias("b")) for i, n in enumerate(L.COMPARTMENTS)]), lambda x: F.when(mask.bitwiseAND(x["b"]) != 0, x["n"])), lambda n: n.isNotNull())


def subsets(tasks: DataFrame) -> DataFrame:
    """(mask, names, tasks): the sets of compartments that tasks have, named, and how many have each."""
    return tasks.groupBy("mask").agg(F.count("*").alias("tasks")).withColumn("names", names_of(F.col("mask")))


def dominance_key(sens: Column, mask: Column, cap: Column | None = None) -> Column:
    """``LEVEL|A,B`` or ``LEVEL|A,B|CAPACITY``: a label's key in a table that was computed beforehand."""
    level = F.get(F.array(*map(F.lit, L.LEVELS)), sens)
    parts = [level, F.array_join(names_of(mask), ",")]
    return F.concat_ws("|", *parts, *([] if cap is None else [F.get(F.array(*map(F.lit, L.CAPACITIES)), cap)]))


def label_payload(sens: Column, mask: Column, cap: Column) -> Column:
    """A label as JSON with names."""
    return F.to_json(F.struct(F.get(F.array(*map(F.lit, L.LEVELS)), sens).alias("sensitivity"), names_of(mask).alias("compartments"), F.get(F.array(*map(F.lit, L.CAPACITIES)), cap).alias("capacity")))


def parse_label(payload: Column) -> Column:
    """struct<sens, mask, cap> from JSON; null if any name is unknown. What is missing is OPEN, no compartment, FREETEXT."""
    p = F.from_json(payload, "sensitivity string, compartments array<string>, capacity string")
    code = lambda names, x, default: F.array_position(F.array(*map(F.lit, names)), F.coalesce(x, F.lit(default))).cast("int") - 1
    sens, cap = code(L.LEVELS, p["sensitivity"], "OPEN"), code(L.CAPACITIES, p["capacity"], "FREETEXT")
    said = F.coalesce(p["compartments"], F.array().cast("array<string>"))
    bits = F.transform(F.array_distinct(said), lambda n: F.array_position(F.array(*map(F.lit, L.COMPARTMENTS)), n).cast("int"))
    mask = F.aggregate(bits, F.lit(0), lambda a, b: a + F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 4, 8)]), b + 1))
    return F.when((sens >= 0) & (cap >= 0) & ~F.exists(bits, lambda b: F.coalesce(b, F.lit(0)) == 0), L.label(sens, mask, cap))


def bounded(value: Column, low: int, high: int, name: str) -> Column:
    """The value itself; the query fails on one that lies outside."""
    return F.when(value.between(low, high), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} must be from {low} to {high}, not "), value.cast("string"))))


def triggered(facts: Column, required: Column) -> Column:
    """Are all required facts there?"""
    return F.size(F.array_except(required, facts)) == 0


def signatures(spark: SparkSession, rules: dict[str, tuple[list[str], list[list[str]]]]) -> DataFrame:
    """Registered signatures (name, required, decoys); a later one of a name replaces an earlier one."""
    return spark.createDataFrame([(k, r, d) for k, (r, d) in rules.items()], "name string, required array<string>, decoys array<array<string>>")


def overlap(facts: Column, pattern: Column) -> Column:
    return F.size(F.array_intersect(facts, pattern))


def class_balance(tasks: DataFrame, truth: str) -> DataFrame:
    """n, positive, share and floor (what answering the larger class always gets right); shares of no rows are 0."""
    share = F.coalesce(F.avg(F.col(truth).cast("double")), F.lit(0.0))
    return tasks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(truth).cast("long")), F.lit(0)).alias("positive"), share.alias("share")).withColumn("floor", F.when(F.col("n") == 0, 0.0).otherwise(F.greatest("share", 1 - F.col("share"))))


def review_sweep(tasks: DataFrame, thresholds: list[int], slips: list[float], seeds: list[int]) -> DataFrame:
    """(threshold, slip, accuracy): answers of a reviewer who escalates from ``threshold`` facts on and slips now and then,
    against the truth, as the mean over the seeds. ``tasks`` has task, evidence and truth; one pass over them."""
    grid = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("slip"), F.lit(r).alias("seed")) for t in thresholds for s in slips for r in seeds])
    rows = tasks.select("task", "evidence", "truth", F.explode(grid).alias("g")).select("*", "g.*")
    said = (F.col("evidence") >= F.col("threshold")) != (uniform(F.col("seed"), F.col("threshold"), F.col("slip"), F.col("task")) < F.col("slip"))
    per = rows.groupBy("threshold", "slip", "seed").agg(F.avg((said == F.col("truth")).cast("double")).alias("a"))
    return per.groupBy("threshold", "slip").agg(F.avg("a").alias("accuracy"))


def equivalent_slip(cells: DataFrame) -> DataFrame:
    """(threshold, slip): the smallest slip at which the strictest threshold does no better than each one does without."""
    best = cells.agg(F.max("threshold").alias("top"))
    strict = cells.join(F.broadcast(best), F.col("threshold") == F.col("top")).select(F.col("slip").alias("s"), F.col("accuracy").alias("a"))
    plain = cells.where("slip = 0").select("threshold", "accuracy")
    return plain.join(F.broadcast(strict), F.col("a") <= F.col("accuracy"), "left").groupBy("threshold").agg(F.min("s").alias("slip"))


def monotone(values: Column) -> Column:
    """Never falling, and higher at the end than at the beginning; false for fewer than two."""
    steps = F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b >= a)
    return (F.size(values) >= 2) & F.forall(steps, lambda s: s) & (F.element_at(values, -1) > F.element_at(values, 1))


def beats_every_draw(theirs: Column, draws: Column) -> Column:
    """Below the least of the draws; false without a value or without draws."""
    return F.coalesce(theirs < F.array_min(draws), F.lit(False))


def split_latency(calls: DataFrame, by: str, order: list[str], seconds: str) -> DataFrame:
    """(by, cold, warm_median, warm_p95, warm_min, n_warm): a group's first call apart from the rest; p95 by position.

    Groups with fewer than two calls have no row.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    rows = calls.select(by, F.col(seconds).alias("s"), *order).withColumn("call", place)
    warm = Window.partitionBy(by, F.col("call") > 1)
    ranked = rows.withColumns({"r": F.row_number().over(warm.orderBy("s")) - 1, "n": F.count("*").over(warm)})
    late = F.least(F.col("n") - 1, F.floor(F.lit(0.95) * F.col("n")))
    is_warm = F.col("call") > 1
    return ranked.groupBy(by).agg(
        F.max(F.when(~is_warm, F.col("s"))).alias("cold"), F.median(F.when(is_warm, F.col("s"))).alias("warm_median"), F.max(F.when(is_warm & (F.col("r") == late), F.col("s"))).alias("warm_p95"),
        F.min(F.when(is_warm, F.col("s"))).alias("warm_min"), F.sum(is_warm.cast("long")).alias("n_warm"),
    ).where("n_warm > 0")


def sync_cost(trainable: Column, total: Column) -> dict[str, Column]:
    """MiB of a round's update at two and four bytes a parameter, and the trained share; null where a count is missing."""
    known = (trainable > 0) & (total > 0)
    return {"mib_half": F.when(known, trainable * 2 / 2.0**20), "mib_full": F.when(known, trainable * 4 / 2.0**20), "share": F.when(known, trainable / total)}


def wrong_majority(rate: Column, fleet: int) -> Column:
    """Probability that most of a fleet are wrong, each alone with probability ``rate``."""
    terms = [math.comb(fleet, k) * F.pow(rate, k) * F.pow(1 - rate, fleet - k) for k in range(fleet // 2 + 1, fleet + 1)]
    return functools.reduce(lambda a, b: a + b, terms)


def understatement(rate: Column, fleet: int) -> Column:
    """How many times likelier a wrong majority is if the fleet went to one school than if each was wrong alone; null if
    nobody is ever wrong."""
    alone = wrong_majority(rate, fleet)
    return F.when(alone > 0, F.round(rate / alone, 1))


def eligibility(labels: DataFrame, ceilings: dict[str, tuple[int, int]], rulings: dict[str, L.Ruling]) -> DataFrame:
    """(ceiling, ruling, capacity, eligible, share): how many rows (sens, mask) may be shared in each cell of the grid.

    Rows are counted by label first, so the grid meets at most 64 rows.
    """
    cells = labels.groupBy("sens", "mask").agg(F.count("*").alias("k"))
    out = None
    for c, top in ceilings.items():
        for r, ruling in rulings.items():
            for code, cap in enumerate(L.CAPACITIES):
                ok = L.eligible(L.label(F.col("sens"), F.col("mask"), code), L.label(*top), ruling)
                one = F.struct(F.lit(c).alias("ceiling"), F.lit(r).alias("ruling"), F.lit(cap).alias("capacity"), ok.alias("ok"))
                out = [one] if out is None else [*out, one]
    rows = cells.select("k", F.explode(F.array(*out)).alias("x")).groupBy("x.ceiling", "x.ruling", "x.capacity").agg(F.sum(F.when(F.col("x.ok"), F.col("k")).otherwise(0)).alias("eligible"), F.sum("k").alias("n"))
    return rows.select("ceiling", "ruling", "capacity", "eligible", (F.col("eligible") / F.col("n")).alias("share"))


def channel_check(tasks: DataFrame, threshold: int, slack: float = 0.5) -> DataFrame:
    """Can a channel's blind spot be measured? affected (answers that change without it), mean_with and mean_without
    (evidence of tasks that carry it and of others), usable. ``tasks`` has evidence, seen_evidence and carries."""
    flips = (F.col("evidence") >= threshold) != (F.col("seen_evidence") >= threshold)
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("evidence"))), F.lit(0.0))
    x = tasks.agg(F.coalesce(F.sum(flips.cast("long")), F.lit(0)).alias("affected"), mean(F.col("carries")).alias("mean_with"), mean(~F.col("carries")).alias("mean_without"))
    return x.withColumn("usable", (F.col("affected") > 0) & (F.abs(F.col("mean_with") - F.col("mean_without")) <= slack))


class ChannelUnusable(ValueError):
    """A corpus on which the blind spot of a channel can't be measured."""


def assert_channel_usable(tasks: DataFrame, threshold: int, slack: float = 0.5) -> DataFrame:
    """The row of ``channel_check``; ChannelUnusable where no verdict depends on the channel, or where the tasks that carry
    it differ from others in evidence by more than ``slack``: a blind spot would be mistaken for difficulty."""
    r = channel_check(tasks, threshold, slack).first()
    if not r.affected:
        raise ChannelUnusable("no verdict changes without the channel")
    if not r.usable:
        raise ChannelUnusable(f"evidence is {r.mean_with:.2f} on tasks that carry the channel and {r.mean_without:.2f} on others")
    return tasks.sparkSession.createDataFrame([r])


def gap_summary(rows: DataFrame, gap: str, by: list[str]) -> DataFrame:
    """n, median, most and least of a gap, and how many exceed a hundredth."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(gap).alias("median_gap"), F.max(gap).alias("max_gap"), F.min(gap).alias("min_gap"), F.sum((F.col(gap) > 0.01).cast("long")).alias("better"))


def fleet_gradients(updates: DataFrame, one_in: int = 5, seed: int = 42) -> DataFrame:
    """(client, byzantine, v): each client's update with a little noise; one client ``one_in``, by a hash, turns it round
    and makes it half as large again."""
    bad = hashed(seed, "bad", F.col("client")) % one_in == 0
    v = F.transform("v", lambda x, i: F.when(bad, x * -1.5).otherwise(x + 0.1 * gauss(seed, "noise", F.col("client"), i)))
    return updates.select("client", bad.alias("byzantine"), v.alias("v"))
