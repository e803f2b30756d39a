"""Slices of tasks on which some reviewers err, drawn so that no channel names them.

A slice of k tasks is drawn from those that show just enough facts: whoever distrusts every report of one fact of such a
task comes to the other verdict. A draw is refused if a scan of channels could name it: if its worst gap of carriage lies
above nearly all gaps of draws of its size. All seeded candidates are drawn and tested in one pass, and so are the draws
they are compared with; in each the tasks that come first by a hash are kept, partitions send no more than k of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rng import Draws, hashed
from ..ship import ship

ATTEMPTS, STRIDE, NULL_DRAWS, QUANTILE = 50, 1009, 2000, 0.99
BITS = (1, 2, 4, 8)


class SliceUnusable(ValueError):
    """No slice; ``structural`` if no other seed would help."""

    def __init__(self, why: str, structural: bool = True):
        super().__init__(why)
        self.structural = structural


@dataclass(frozen=True)
class Slice:
    """tasks (task, fact), distrusted (report_id), and how it was come by."""

    tasks: DataFrame
    distrusted: DataFrame
    eligible: int
    worst_gap: float
    percentile: float
    rejected: int


def shown(reports: DataFrame, pattern: list[str]) -> DataFrame:
    """(task, shown, mask): the facts of the pattern that a task's reports tell, sorted, and the channels they come by."""
    wanted = F.array(*[F.lit(p) for p in pattern])
    facts = F.array_sort(F.array_intersect(F.array_distinct(F.flatten(F.collect_list("fact_ids"))), wanted))
    return reports.groupBy(F.col("event_id").alias("task")).agg(facts.alias("shown"), F.bit_or("mask").alias("mask"))


def _first(n: int, size: int, prefix: Callable[[int], str]):
    """Of the tasks of a partition, those that may be among the first ``size`` of each draw: (draw, task, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, h = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        lost = False
        for batch in batches:
            lost = lost or batch.column(0).null_count > 0
            own = batch.column(0).drop_null().to_numpy()
            if not len(own):
                continue
            made = Draws(own)
            for d in range(n):
                x = made.under(prefix(d))
                at = np.flatnonzero(x <= np.partition(x, size - 1)[size - 1]) if len(x) > size else np.arange(len(x))
                k, v = np.r_[tasks[d], own[at]], np.r_[h[d], x[at].astype(np.int64)]
                first = np.lexsort((k, v))[:size]
                tasks[d], h[d] = k[first], v[first]
        sizes = [len(x) for x in tasks]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), sizes), pa.int32()), pa.array(np.concatenate(tasks), pa.int64()), pa.array(np.concatenate(h), pa.int64())], ["draw", "task", "h"])
        if lost:  # a task without id is hashed without it
            none = [int(hashlib.md5(prefix(d)[:-1].encode()).hexdigest()[:8], 16) for d in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.nulls(n, pa.int64()), pa.array(none, pa.int64())], ["draw", "task", "h"])

    return run


def draws(pool: DataFrame, n: int, size: int, prefix: Callable[[int], str]) -> DataFrame:
    """(draw and the pool's columns): of each draw the ``size`` tasks that come first by the hash of ``prefix`` of the draw and task.

    No row is made for a task and draw: partitions keep the first ones of every draw.
    """
    ship(pool.sparkSession)
    some = pool.select(F.col("task").cast("bigint")).mapInArrow(_first(n, size, prefix), "draw int, task bigint, h bigint")
    place = F.row_number().over(Window.partitionBy("draw").orderBy("h", "task"))
    taken = some.withColumn("_p", place).where(F.col("_p") <= size).select("draw", F.col("task").alias("_task"))
    return pool.join(F.broadcast(taken), F.col("task").eqNullSafe(F.col("_task"))).drop("_task")  # no more than n * size rows


def worst_gaps(drawn: DataFrame, size: int, n: int, totals: dict[int, int]) -> DataFrame:
    """(draw, gap): the largest difference in any channel's carriage between a slice and the rest of the pool."""
    inside = [F.sum((F.col("mask").bitwiseAND(b) > 0).cast("long")).alias(f"c{b}") for b in BITS]
    rest = max(n - size, 1)
    gap = [F.abs(F.col(f"c{b}") / size - ((F.lit(totals[b]) - F.col(f"c{b}")) / rest if n > size else F.lit(0.0))) for b in BITS]
    return drawn.groupBy("draw").agg(*inside).select("draw", F.round(F.greatest(*gap), 9).alias("gap"))


def flips(reports: DataFrame, distrusted: DataFrame, pattern: list[str], need: int) -> DataFrame:
    """(draw, flipped): tasks whose evidence falls below ``need`` without the distrusted reports, wherever those occur."""
    marked = distrusted.select("draw", "report_id").distinct()
    touched = reports.join(marked, "report_id").select("draw", F.col("event_id")).distinct()
    rows = reports.join(touched, "event_id").join(marked.withColumn("_out", F.lit(True)), ["draw", "report_id"], "left")
    wanted = F.array(*[F.lit(p) for p in pattern])
    seen = lambda x: F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list(x))), wanted))
    per = rows.groupBy("draw", "event_id").agg(seen(F.col("fact_ids")).alias("all"), seen(F.when(F.col("_out").isNull(), F.col("fact_ids"))).alias("left"))
    return per.groupBy("draw").agg(F.sum(((F.col("all") >= need) & (F.col("left") < need)).cast("long")).alias("flipped"))


def balanced_slice(reports: DataFrame, pattern: list[str], size: int, seed: int = 7, need: int = 3, attempts: int = ATTEMPTS, null_draws: int = NULL_DRAWS, quantile: float = QUANTILE) -> Slice:
    """The first of ``attempts`` seeded draws that is balanced, and how many were refused before it.

    ``reports`` has report_id, event_id, fact_ids and mask. SliceUnusable if the pool is smaller than ``size``, if a draw
    flips other verdicts than it means to (structural), or if no draw is balanced.
    """
    tasks = shown(reports, pattern)
    pool = tasks.where(F.size("shown") == need).select("task", "shown", "mask")
    sums = pool.agg(F.count("*").alias("n"), *[F.sum((F.col("mask").bitwiseAND(b) > 0).cast("long")).alias(f"c{b}") for b in BITS]).first()
    if sums.n < size or not size:
        raise SliceUnusable(f"a slice of {size} needs as many tasks that show {need} facts; there are {sums.n}")
    totals = {b: sums[f"c{b}"] for b in BITS}
    own = (F.lit(seed) + F.col("draw") * STRIDE).cast("string")
    drawn = draws(pool, attempts, size, lambda d: f"{seed + d * STRIDE}:").withColumn("fact", F.element_at("shown", (hashed(own, "fact", F.col("task")) % F.size("shown") + 1).cast("int")))
    distrusted = reports.join(drawn.select("draw", F.col("task").alias("event_id"), "fact"), "event_id").where(F.array_contains("fact_ids", F.col("fact"))).select("draw", "report_id")
    null = worst_gaps(draws(pool.select("task", "mask"), null_draws, size, lambda d: f"{seed}:null:{d}:"), size, sums.n, totals)
    levels = null.groupBy("gap").agg(F.count("*").alias("n"))
    cells = worst_gaps(drawn, size, sums.n, totals).join(flips(reports, distrusted, pattern, need), "draw", "left")
    known = {r.gap: r.n for r in levels.collect()}  # no more than null_draws
    rejected = 0
    for r in cells.orderBy("draw").collect():  # no more than attempts
        if r.flipped != size:
            raise SliceUnusable(f"draw {r.draw} was to flip {size} verdicts and flips {r.flipped}")
        percentile = sum(n for g, n in known.items() if g <= r.gap) / null_draws
        if percentile <= quantile:
            mine = F.col("draw") == r.draw
            return Slice(drawn.where(mine).select("task", "fact"), distrusted.where(mine).select("report_id").distinct(), sums.n, r.gap, percentile, rejected)
        rejected += 1
    raise SliceUnusable(f"no balanced slice of {size} in {attempts} draws", structural=False)


def without_slice(tasks: DataFrame, taken: Slice) -> DataFrame:
    """``tasks`` (task, evidence) with ``seen_evidence``, what those see who distrust the slice's reports."""
    lost = taken.tasks.select("task", F.lit(1).alias("_lost"))
    return tasks.drop("seen_evidence").join(lost, "task", "left").withColumn("seen_evidence", F.col("evidence") - F.coalesce("_lost", F.lit(0))).drop("_lost")
