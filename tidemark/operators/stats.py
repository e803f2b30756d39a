"""Rates, intervals, permutation tests, dispersion, ranking quality and checks of a measurement."""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegralType

from ..functions.rng import Draws, choice, hashed
from ..scratch import Scratch
from ..ship import ship

#: Tasks whose counts may be sent to the draws: some 32 MB.
SENT = 2_000_000
#: Tasks of one block that draws put in order, partitions of such blocks, and draws that one task of Spark makes of a block.
BLOCK, BLOCKS, TOGETHER = 1 << 16, 64, 64


def by_task(trials: DataFrame) -> DataFrame:
    """task, n (answers), wins; outcomes may be null."""
    return trials.groupBy("task").agg(F.count("outcome").alias("n"), F.coalesce(F.sum(F.col("outcome").cast("long")), F.lit(0)).alias("wins"))


def rates(trials: DataFrame) -> DataFrame:
    """Share of answers that win, and share of tasks with a strict majority of wins (a tie isn't one, no answer neither)."""
    t = by_task(trials)
    return t.agg(
        F.coalesce(F.sum("wins") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("single_run_rate"),
        F.coalesce(F.avg((2 * F.col("wins") > F.col("n")).cast("double")), F.lit(0.0)).alias("consensus_rate"),
    )


def variance_split(trials: DataFrame) -> DataFrame:
    """Population variance of task rates, and mean of p (1 - p), over tasks with answers."""
    p = F.col("wins") / F.col("n")
    return by_task(trials).where("n > 0").agg(F.coalesce(F.var_pop(p), F.lit(0.0)).alias("between"), F.coalesce(F.avg(p * (1 - p)), F.lit(0.0)).alias("within"))


def resampled(trials: DataFrame, resamples: int, seed: int = 7) -> DataFrame:
    """(draw, rate): tasks drawn with replacement, all trials of a task together.

    A resample is as many draws as there are tasks, so draws x tasks hashes; the counts of up to ``SENT``
    tasks are sent to them, else they are joined by place.
    """
    order = Window.orderBy("task")
    t = by_task(trials).withColumn("i", F.row_number().over(order) - 1)
    n = t.count()
    if 0 < n <= SENT:
        ship(trials.sparkSession)
        own = t.orderBy("i").select("wins", "n").toArrow()
        found = trials.sparkSession.range(resamples * n).mapInArrow(_drawn(own.column("wins").to_numpy(), own.column("n").to_numpy(), seed), "draw bigint, wins bigint, n bigint")
        return found.groupBy("draw").agg(F.coalesce(F.sum("wins") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("rate"))
    draws = trials.sparkSession.range(resamples * n).select(F.floor(F.col("id") / max(n, 1)).alias("draw"), F.pmod(hashed(seed, F.col("id")), F.lit(max(n, 1))).alias("i"))
    return draws.join(t, "i").groupBy("draw").agg(F.coalesce(F.sum("wins") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("rate"))


def _range_hashes(at: np.ndarray, prefix: str, made: dict[int, Draws]) -> np.ndarray:
    """``hashed`` of the prefix and numbers that follow each other. Runs of 10,000 share all but their last five digits, whose
    text is kept in ``made``; where the fifth is 0 it would be lost, and the numbers are written out."""
    out = np.empty(len(at), np.int64)
    block = at // 10_000
    for b in np.unique(block).tolist():
        mine, fifth = block == b, b % 10
        if fifth:
            if fifth not in made:
                made[fifth] = Draws(np.arange(fifth * 10_000, (fifth + 1) * 10_000))
            of = np.zeros(10_000, bool)
            of[at[mine] - b * 10_000] = True
            out[mine] = made[fifth].under(f"{prefix}{b // 10 or ''}", of)
        else:
            out[mine] = Draws(at[mine]).under(prefix)
    return out


def _drawn(wins: np.ndarray, n: np.ndarray, seed: int):
    """(draw, wins, n) of rows (id), draws one after another: the sums of the tasks that a batch draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Draws] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            if not len(at):
                continue
            i, draw = _range_hashes(at, f"{seed}:", made) % len(n), at // len(n)
            begin = np.r_[0, np.flatnonzero(np.diff(draw)) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(draw[begin]), pa.array(np.add.reduceat(wins[i], begin)), pa.array(np.add.reduceat(n[i], begin))], ["draw", "wins", "n"])

    return run


def cluster_bootstrap(trials: DataFrame, resamples: int = 2000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """point, low, high: positions max(0, int(tail * B) - 1) and min(B - 1, int((1 - tail) * B)) of the sorted draws.

    With fewer than two tasks the interval is the point.
    """
    tail = (1 - level) / 2
    low, high = max(0, int(tail * resamples) - 1), min(resamples - 1, int((1 - tail) * resamples))
    point = rates(trials).select(F.col("single_run_rate").alias("point"))
    if by_task(trials).limit(2).count() < 2:
        return point.select("point", F.col("point").alias("low"), F.col("point").alias("high"))
    ends = resampled(trials, resamples, seed).withColumn("p", F.row_number().over(Window.orderBy("rate")) - 1).agg(F.max(F.when(F.col("p") == low, F.col("rate"))).alias("low"), F.max(F.when(F.col("p") == high, F.col("rate"))).alias("high"))
    return point.join(F.broadcast(ends))


def resolves(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Neither interval (point, low, high) covers the other's point."""
    return ~a[0].between(b[1], b[2]) & ~b[0].between(a[1], a[2])


def resolves_difference(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The gap exceeds the half widths in quadrature."""
    half = lambda x: (x[2] - x[1]) / 2
    return F.abs(a[0] - b[0]) > F.sqrt(half(a) * half(a) + half(b) * half(b))


def concerns(tp: Column, fp: Column, tn: Column, fn: Column, unparsed: Column) -> Column:
    """Names of what speaks against quoting a confusion table, in a fixed order."""
    scored = tp + fp + tn + fn
    total, pos, neg = scored + unparsed, tp + fn, fp + tn
    some = F.greatest(scored, F.lit(1)).cast("double")
    majority, accuracy = F.greatest(pos, neg) / some, (tp + tn) / some
    rows = [
        ("empty", total == 0), ("small_n", (total > 0) & (total < 30)), ("unparsed", (unparsed > 0) & (unparsed / F.greatest(total, F.lit(1)) > 0.1)), ("skewed", (scored > 0) & (majority > 0.7)),
        ("below_floor", (scored > 0) & (accuracy <= majority)), ("saturated", (scored > 0) & (tp + tn == scored)), ("degenerate", (scored > 0) & ((tp + fp == scored) | (tn + fn == scored))), ("over_escalation", (pos > 0) & (fn == 0) & (fp > tp)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rows]))


def auc(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by midranks within groups; groups of one class have no row.

    Scores are counted before they are ranked, so ties cost one row.
    """
    c = rows.groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(score)) - F.col("n")
    c = c.withColumn("won", F.col("p") * (before + F.col("n") / F.lit(2.0)))
    return c.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("pos"), F.sum("n").alias("neg")).where("pos > 0 AND neg > 0").select(*by, (F.col("won") / (F.col("pos").cast("double") * F.col("neg"))).alias("auc"))


def stratified_delta(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over strata of mean rate with minus without carriage; strata that lack a side are skipped. Adds strata used.

    ``rows`` has stratum, carries, rate and the columns ``by``.
    """
    by = by or []
    s = rows.groupBy(*by, "stratum").agg((F.avg(F.when(F.col("carries"), F.col("rate"))) - F.avg(F.when(~F.col("carries"), F.col("rate")))).alias("gap")).where("gap IS NOT NULL")
    return s.groupBy(*by).agg(F.avg("gap").alias("delta"), F.count("*").alias("strata")) if by else s.agg(F.avg("gap").alias("delta"), F.count("*").alias("strata"))


def shuffled(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """Each draw gives the carriage of a stratum to its tasks anew, keeping how many carry: those that come first in the
    order of a hash of draw and task. Adds draw."""
    k = rows.groupBy("stratum").agg(F.sum(F.col("carries").cast("int")).alias("k"))
    every = rows.join(F.broadcast(k), "stratum").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.row_number().over(Window.partitionBy("draw", "stratum").orderBy(hashed(seed, F.col("draw"), F.col("task")), "task"))
    return every.select("draw", "stratum", "task", "rate", (place <= F.col("k")).alias("carries"))


def _settled(seed: int, width: float):
    """For each draw of a block of a stratum's tasks: those that surely come first, as sums, and those near the cut, as rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                task, rate = np.asarray(row.tasks, np.int64), np.asarray(row.rates, float)
                known = ~np.isnan(rate)
                rate, known, hashes, k, n = np.where(known, rate, 0.0), known.astype(float), Draws(task), row.k, row.size
                room = width * math.sqrt(k * (n - k) / n) + width * width
                low, high = (np.uint64(min(max(math.floor(x / n * 4294967296.0), 0), 1 << 32)) for x in (k - room, k + room))
                sums, near, held = [], [], []
                for draw in row.draws:
                    h = hashes.under(f"{seed}:{draw}:")
                    first = h < low
                    at = np.flatnonzero(~first & (h < high))
                    sums.append((np.count_nonzero(first), known @ first, rate @ first))
                    near.append((h[at], task[at], rate[at], known[at]))
                    held.append(len(at))
                whole = bool(low == 0 and high == 1 << 32)
                lists = [np.concatenate(x) for x in zip(*near, strict=True)]
                yield pd.DataFrame([(row.stratum, row.draws[0], row.draws, k, whole, known.sum(), rate.sum(), *map(np.array, zip(*sums, strict=True)), np.array(held), lists[0].astype(np.int64), *lists[1:])], columns=_SETTLED)

    return run


_SETTLED = ["stratum", "first", "draws", "k", "whole", "known", "total", "n_in", "known_in", "sum_in", "held", "h", "task", "rate", "is_known"]


def _gaps(f: pd.DataFrame) -> pd.DataFrame:
    """(stratum, draw, gap, short) from the blocks of a stratum; ``short``: the cut lies outside what was taken to be near."""
    draws, k = f["draws"].iloc[0], int(f["k"].iloc[0])
    chosen, with_n, with_sum = (np.sum(np.stack(f[c]), axis=0) for c in ("n_in", "known_in", "sum_in"))
    owner = np.concatenate([np.repeat(np.arange(len(draws)), x) for x in f["held"]])
    h, task, rate, known = (np.concatenate(f[c].to_numpy()) for c in ("h", "task", "rate", "is_known"))
    order = np.lexsort((task, h, owner))
    owner, held = owner[order], np.bincount(owner, minlength=len(draws))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held)
    mine = place < (k - chosen)[owner]
    with_n = with_n + np.bincount(owner, known[order] * mine, len(draws))
    with_sum = with_sum + np.bincount(owner, rate[order] * mine, len(draws))
    other = f["known"].sum() - with_n
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = with_sum / with_n - (f["total"].sum() - with_sum) / other
    short = ((chosen > k) | (chosen + held < k)) & ~f["whole"].iloc[0]
    gap = pd.Series(gap).astype(object).where((with_n > 0) & (other > 0), None)
    return pd.DataFrame({"stratum": f["stratum"].iloc[0], "draw": draws, "gap": gap, "short": short})


def order_gaps(rows: DataFrame, draws: int, seed: int, scratch: Scratch, width: float = 5.0) -> DataFrame:
    """(draw, gap) by stratum: what ``shuffled`` gives, of tasks that are whole numbers; ones without task are left out.

    Every draw hashes every task. Hashes are even, so where the k-th lies is known but for some standard deviations:
    only tasks within ``width`` of them are shuffled and put in order, about the root of their number. Draws whose cut lies
    outside are done again with a wider one, until none is left.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.where("task IS NOT NULL AND stratum IS NOT NULL").select("stratum", F.col("task").cast("long").alias("task"), "carries", F.col("rate").cast("double").alias("rate"))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size"), F.sum(F.col("carries").cast("long")).alias("k")).where("k > 0 AND k < size")
    blocks = sizes.agg(F.sum(F.ceil(F.col("size") / BLOCK))).first()[0]
    block = F.pmod(F.xxhash64("task"), F.ceil(F.col("size") / BLOCK))
    dealt = rows.join(F.broadcast(sizes), "stratum").withColumn("_b", block).repartition(max(1, min(blocks or 1, BLOCKS)), "stratum", "_b")
    lists = dealt.groupBy("stratum", "_b", "k", "size").agg(F.collect_list(F.struct("task", "rate")).alias("c"))
    work = scratch.keep(lists.select("stratum", "k", "size", F.col("c.task").alias("tasks"), F.col("c.rate").alias("rates")), "blocks")
    kind = rows.schema["stratum"].dataType.simpleString()
    form = f"stratum {kind}, first int, draws array<int>, k bigint, whole boolean, known double, total double, n_in array<bigint>, known_in array<double>, sum_in array<double>, held array<bigint>, h array<bigint>, task array<bigint>, rate array<double>, is_known array<double>"
    out, todo, together = None, list(range(draws)), TOGETHER if (blocks or 0) > 16 else max(TOGETHER, -(-draws // 16))
    while todo:
        chunks = [(todo[i : i + together],) for i in range(0, len(todo), together)]
        dealt = spark.createDataFrame(chunks, "draws array<int>").repartition(len(chunks))
        found = work.crossJoin(dealt.hint("shuffle_replicate_nl")).mapInPandas(_settled(seed, width), form)
        gaps = scratch.keep(found.groupBy("stratum", "first").applyInPandas(_gaps, f"stratum {kind}, draw int, gap double, short boolean"), "gaps")
        todo = sorted(r[0] for r in gaps.where("short").select("draw").distinct().collect())
        fit = gaps.join(F.broadcast(gaps.where("short").select("draw").distinct()), "draw", "left_anti").select("draw", "gap")
        out, width = fit if out is None else out.unionByName(fit), width * 4
    return out


def channel_test(rows: DataFrame, draws: int = 4200, seed: int = 90210, alpha: float = 0.001) -> DataFrame:
    """delta, p = (draws at or below it + 1) / (draws + 1), detected. One-sided: low rates with carriage are what counts.

    Both are rounded to 12 places before they are compared, so that equal ones are equal.
    """
    scratch = Scratch(rows.sparkSession, "channel")
    if isinstance(rows.schema["task"].dataType, IntegralType):
        rows = scratch.keep(rows.select("stratum", "task", "carries", "rate"), "rows")
        null = order_gaps(rows, draws, seed, scratch).where("gap IS NOT NULL").groupBy("draw").agg(F.avg("gap").alias("null_delta"))
    else:
        null = stratified_delta(shuffled(rows, draws, seed), ["draw"]).select(F.col("delta").alias("null_delta"))
    seen = stratified_delta(rows)
    p = (F.sum((F.round("null_delta", 12) <= F.round("delta", 12)).cast("long")) + 1) / F.lit(draws + 1.0)
    return scratch.finish(null.join(F.broadcast(seen)).groupBy("delta", "strata").agg(p.alias("p")).withColumn("detected", F.col("p") < alpha))


def dispersion(view: DataFrame, least: int = 10) -> DataFrame:
    """Index of overdispersion: sum of (votes - seen * r)^2 over sum of seen * r * (1 - r), r the stratum's rate, over
    strata of at least ``least`` tasks; strata without variance are counted apart. ``view`` has stratum, votes, seen."""
    s = view.groupBy("stratum").agg(F.count("*").alias("k"), (F.sum("votes") / F.sum("seen")).alias("r")).where(F.col("k") >= least)
    r, n, v = F.col("r"), F.col("seen"), F.col("votes")
    rows = view.join(F.broadcast(s), "stratum")
    flat = (r <= 0) | (r >= 1)
    per = rows.groupBy("stratum").agg(F.sum((v - n * r) * (v - n * r)).alias("top"), F.sum(n * r * (1 - r)).alias("bottom"), F.max(flat.cast("int")).alias("flat"))
    return per.agg((F.sum(F.when(F.col("flat") == 0, F.col("top"))) / F.sum(F.when(F.col("flat") == 0, F.col("bottom")))).alias("index"), F.coalesce(F.sum((F.col("flat") == 0).cast("long")), F.lit(0)).alias("strata"), F.coalesce(F.sum("flat"), F.lit(0)).alias("degenerate"))


def dispersion_null(view: DataFrame, draws: int = 2000, seed: int = 0, least: int = 10) -> DataFrame:
    """(draw, index) with each task's votes redrawn as a binomial of its stratum's rate."""
    s = view.groupBy("stratum").agg(F.count("*").alias("k"), (F.sum("votes") / F.sum("seen")).alias("r")).where((F.col("k") >= least) & (F.col("r") > 0) & (F.col("r") < 1))
    rows = view.join(F.broadcast(s), "stratum").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    one = lambda a, i: a + F.when(hashed(seed, F.col("draw"), F.col("task"), i) / F.lit(4294967296.0) < F.col("r"), 1).otherwise(0)
    v = F.when(F.col("seen") >= 1, F.aggregate(F.sequence(F.lit(1), F.col("seen").cast("int")), F.lit(0), one)).otherwise(0)
    n, r = F.col("seen"), F.col("r")
    return rows.withColumn("v", v).groupBy("draw").agg((F.sum((F.col("v") - n * r) * (F.col("v") - n * r)) / F.sum(n * r * (1 - r))).alias("index"))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    scale = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tail = 0.0
    for m in range(400, 0, -1):  # from the inside out: two terms a round
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = even / (1 + odd / (1 + tail))
    first = -(a + b) * x / (a + 1)
    return scale / (1 + first / (1 + tail))


def rate_upper_bound(differing: int, n: int, level: float = 0.95) -> float:
    """Upper end of the exact binomial interval: the ``level`` quantile of a beta with differing + 1 and n - differing, by
    Newton's method in the logit. 1 if there are no trials or all differ."""
    a, b = differing + 1, n - differing
    if n == 0 or b <= 0:
        return 1.0
    logit = math.log(a / b)
    for _ in range(100):
        p = 1 / (1 + math.exp(-logit))
        slope = math.exp(a * math.log(p) + b * math.log1p(-p) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        move = (beta_cdf(p, a, b) - level) / max(slope, 1e-300)
        logit -= max(-1.0, min(1.0, move))
        if abs(move) < 1e-14:
            break
    return 1 / (1 + math.exp(-logit))


def exact_wrong_majority(rate: float, schools: int, fleet: int) -> float:
    """Probability that most of a fleet is wrong if whole schools are wrong together, each with probability ``rate``."""
    sizes = [fleet // schools + (i < fleet % schools) for i in range(schools)]
    chance = {0: 1.0}
    for s in sizes:
        new: dict[int, float] = {}
        for k, p in chance.items():
            new[k] = new.get(k, 0.0) + p * (1 - rate)
            new[k + s] = new.get(k + s, 0.0) + p * rate
        chance = new
    return sum(p for k, p in chance.items() if k >= fleet // 2 + 1)


__all__ = ["auc", "by_task", "channel_test", "choice", "cluster_bootstrap", "concerns", "dispersion", "dispersion_null", "exact_wrong_majority", "order_gaps", "rate_upper_bound", "rates", "resampled", "resolves", "resolves_difference", "shuffled", "stratified_delta", "variance_split"]
