"""Can a class be told from the shape of a text alone? Held-out centers, a permutation null, and fitted probes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.rng import hashed
from ..scratch import Scratch
from . import fitting
from .stats import auc

BAND = (0.45, 0.55)


def null_of_auc(rows: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """(trial, auc) with classes shuffled within centers: each keeps its number of positives, given to the rows that come
    first by a hash; the mean over centers. ``rows`` has id, center, score, positive."""
    k = rows.groupBy("center").agg(F.sum(F.col("positive").cast("int")).alias("k"))
    every = rows.join(F.broadcast(k), "center").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    place = F.row_number().over(Window.partitionBy("trial", "center").orderBy(hashed(seed, F.col("trial"), F.col("id")), "id"))
    return auc(every.select("trial", "center", "score", (place <= F.col("k")).alias("positive")), "score", "positive", ["trial", "center"]).groupBy("trial").agg(F.avg("auc").alias("auc"))


def against_null(observed: DataFrame, null: DataFrame, trials: int) -> DataFrame:
    """auc, null_mean, null_sd (sample), null_p95 (by position), z (null without spread), significant, passed."""
    at = max(int(0.95 * trials) - 1, 0) + 1
    n = null.withColumn("p", F.row_number().over(Window.orderBy("auc"))).agg(F.avg("auc").alias("null_mean"), F.stddev_samp("auc").alias("null_sd"), F.max(F.when(F.col("p") == at, F.col("auc"))).alias("null_p95"))
    both = observed.select("auc").join(F.broadcast(n))
    return both.select("*", F.when(F.col("null_sd") > 0, (F.col("auc") - F.col("null_mean")) / F.col("null_sd")).alias("z"), (F.col("auc") > F.col("null_p95")).alias("significant"), F.col("auc").between(*BAND).alias("passed"))


def probes(rows: DataFrame, features: list[str], trees: int = 20) -> DataFrame:
    """(probe, center, auc): a balanced logistic regression on scaled features and boosted trees, each fitted without a
    center and judged on it; centers or trainings of one class are left out. ``rows`` has center, positive, features.

    One fit for each center and probe, so centers should be few.
    """
    data = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(rows.select("center", F.col("positive").cast("double").alias("label"), *features)).cache()
    out = None
    for (center,) in data.select("center").distinct().orderBy("center").collect():
        train, test = data.where(F.col("center") != center), data.where(F.col("center") == center)
        n, pos = train.agg(F.count("*"), F.sum("label")).first()
        if not n or not 0 < pos < n:
            continue
        weighed = train.withColumn("w", F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(weighed)
        models = {"logistic": LogisticRegression(weightCol="w", regParam=1.0 / n).fit(scaler.transform(weighed)), "trees": GBTClassifier(maxIter=trees, seed=0).fit(scaler.transform(weighed))}
        for name, model in models.items():
            scored = model.transform(scaler.transform(test)).select("center", (F.col("label") == 1).alias("positive"), vector_to_array("probability")[1].alias("score"))
            a = auc(scored, "score", "positive", ["center"]).select(F.lit(name).alias("probe"), "center", "auc")
            out = a if out is None else out.unionByName(a)
    return out if out is not None else rows.sparkSession.createDataFrame([], "probe string, center string, auc double")


def verdict(folds: DataFrame) -> DataFrame:
    """The probe whose mean over centers lies furthest from chance."""
    m = folds.groupBy("probe").agg(F.avg("auc").alias("auc"), F.count("*").alias("folds"))
    return m.agg(F.max(F.struct(F.abs(F.col("auc") - 0.5).alias("far"), "probe", "auc", "folds")).alias("m")).select("m.probe", "m.auc", "m.folds", F.col("m.auc").between(*BAND).alias("passed"))


def usable(cells: int, null_run: bool, baseline: float, most: float = 0.72) -> bool:
    """More than one label cell, a null that was run, and a baseline no higher than ``most``."""
    return cells > 1 and null_run and baseline <= most


@dataclass(frozen=True)
class GateResult:
    """What the shape of a text tells of its class: by center, over centers, and against shuffled labels."""

    auc: float
    per_fold: dict[str, float]
    n_rows: int
    n_test: int
    centers: tuple[str, ...]
    null: tuple[float, ...] = field(default=())
    passes: int = 0
    converged: bool = True

    @property
    def passed(self) -> bool:
        return BAND[0] <= self.auc <= BAND[1]

    @property
    def spread(self) -> float:
        return max(self.per_fold.values()) - min(self.per_fold.values())

    @property
    def null_mean(self) -> float | None:
        return float(np.mean(self.null)) if self.null else None

    @property
    def null_sd(self) -> float | None:
        return (float(np.std(self.null, ddof=1)) if len(self.null) > 1 else 0.0) if self.null else None

    @property
    def null_p95(self) -> float | None:
        return sorted(self.null)[max(int(0.95 * len(self.null)) - 1, 0)] if self.null else None

    @property
    def null_z(self) -> float | None:
        return (self.auc - self.null_mean) / self.null_sd if self.null_sd else None

    @property
    def leak_is_significant(self) -> bool | None:
        """None without a null, so that it can't pass for a clean one."""
        return None if self.null_p95 is None else self.auc > self.null_p95


def _matrix(rows: DataFrame, features: list[str], centers: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, fold, y, at, x): features moved and scaled by all rows' figures, for sums that keep their digits, and a constant.

    Each fold's own scaling, without its center, is part of its fit.
    """
    stats = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    scaled = [(F.col(f) - float(stats[f"m{i}"])) / float(stats[f"s{i}"] or 1.0) for i, f in enumerate(features)]
    joined = rows.join(F.broadcast(centers), "center")
    at = F.array(*[F.lit(i) for i in range(len(features) + 1)])
    made = joined.select(F.xxhash64("id").alias("h"), "fold", F.col("positive").cast("double").alias("y"), at.alias("at"), F.array(*scaled, F.lit(1.0)).alias("x"))
    return scratch.keep(made, "matrix")


def _fold_scales(matrix: DataFrame, d: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature over the rows outside each fold: sums of all less the fold's own."""
    sums = matrix.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"a{i}") for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"b{i}") for i in range(d)]).collect()
    n, a, b = np.zeros(folds), np.zeros((folds, d)), np.zeros((folds, d))
    for r in sums:
        n[r.fold], a[r.fold], b[r.fold] = r.n, [r[f"a{i}"] for i in range(d)], [r[f"b{i}"] for i in range(d)]
    n, a, b = n.sum() - n, a.sum(axis=0) - a, b.sum(axis=0) - b
    mean = a / np.maximum(n, 1)[:, None]
    var = np.maximum(b / np.maximum(n, 1)[:, None] - mean * mean, 0.0)
    return mean, np.where(var > 1e-18, np.sqrt(var), 1.0)


def run_gate(rows: DataFrame, features: list[str], null_trials: int = 0, null_seed: int = 0, most: int = 10_000) -> GateResult:
    """Can the class be told from ``features``? A balanced logistic regression on scaled features, each center held out.

    ``rows`` has id, center, positive and the features; rows with a null among them are left out. All centers are fitted at
    once, one job a step whatever their number, and so are all trials of shuffled labels. A center is judged by the area
    under the curve of its own rows; centers whose rows, or the rows of the others, are of one class are left out. Fewer
    than two centers are refused, as are rows without any usable center: a gate may not pass for want of data. At most
    ``most`` centers.
    """
    scratch = Scratch(rows.sparkSession, "gate")
    try:
        data = scratch.keep(rows.select("id", F.col("center").cast("string").alias("center"), "positive", *[F.col(f).cast("double").alias(f) for f in features]).dropna(), "rows")
        names = tuple(r.center for r in data.select("center").distinct().orderBy("center").limit(most + 1).collect())
        if len(names) < 2:
            raise ValueError("fewer than two centers: none can be held out")
        if len(names) > most:
            raise ValueError(f"more than {most} centers")
        centers = rows.sparkSession.createDataFrame(list(enumerate(names)), "fold int, center string")
        matrix = _matrix(data, features, centers, scratch)
        n, positives = matrix.agg(F.count("*"), F.sum("y").cast("long")).first()
        d, k = len(features), len(names)
        mean, sd = _fold_scales(matrix, d, k)
        seen, fits = _held_out(matrix, d, k, mean, sd, fitting.Labels(), scratch)
        if not seen:
            raise ValueError("no center has both classes")
        per = {names[f]: a for (_, f), a in seen.items()}
        sizes = {r.fold: r["count"] for r in matrix.groupBy("fold").count().collect()}
        null: tuple[float, ...] = ()
        if null_trials:
            labels = fitting.Labels(tuple(fitting.thresholds(matrix, null_trials, positives, null_seed)), null_seed)
            shuffled, _ = _held_out(matrix, d, k, mean, sd, labels, scratch)
            by: dict[int, list[float]] = {}
            for (t, _), a in sorted(shuffled.items()):
                by.setdefault(t, []).append(a)
            null = tuple(float(np.mean(v)) for v in by.values())
        return GateResult(float(np.mean(list(per.values()))), per, n, sum(sizes[f] for _, f in seen), names, null, fits.passes, fits.converged)
    finally:
        scratch.close()


def _held_out(matrix: DataFrame, d: int, k: int, mean: np.ndarray, sd: np.ndarray, labels: fitting.Labels, scratch: Scratch) -> tuple[dict[tuple[int, int], float], fitting.Fits]:
    """Area under the curve by trial and fold."""
    fits = fitting.fit(matrix, d + 1, k, labels, free=d, scale=(np.tile(mean, (labels.trials, 1)), np.tile(sd, (labels.trials, 1))))
    rated = scratch.keep(fitting.scored(matrix, fits, d + 1, k, labels).withColumn("score", F.round("score", 10)), "scored")
    return {(r.trial, r.fold): r.auc for r in auc(rated, "score", "positive", ["trial", "fold"]).collect()}, fits
