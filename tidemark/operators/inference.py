"""Truth from votes of unknown quality. Votes are rows (task, who, verdict); repeated votes each count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .secagg import decode, encode, ring


#: Voters whose rates may be broadcast: some 40 MB. With more of them votes are merged with rates.
FEW = 500_000


def vote_shares(votes: DataFrame) -> DataFrame:
    """(task, p): the share of true votes, where estimation starts."""
    return votes.groupBy("task").agg(F.avg(F.col("verdict").cast("double")).alias("p"))


def rates_of(votes: DataFrame, posterior: DataFrame) -> DataFrame:
    """M step: (who, e11, e01), the smoothed probability of a true vote on true and on false tasks."""
    # By its files a posterior looks small, since it repeats few values; it is never broadcast.
    v = votes.join(posterior.hint("merge"), "task").groupBy("who").agg(
        F.sum("p").alias("w1"), F.sum(F.when(F.col("verdict"), F.col("p")).otherwise(0.0)).alias("n11"),
        F.sum(1 - F.col("p")).alias("w0"), F.sum(F.when(F.col("verdict"), 1 - F.col("p")).otherwise(0.0)).alias("n01"),
    )
    return v.select("who", ((F.col("n11") + 1) / (F.col("w1") + 2)).alias("e11"), ((F.col("n01") + 1) / (F.col("w0") + 2)).alias("e01"))


def prevalence(posterior: DataFrame) -> DataFrame:
    return posterior.agg(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.avg("p"))).alias("prior"))


def logistic(d: Column) -> Column:
    """1 / (1 + exp(-d)) without overflow."""
    return F.when(d >= 0, 1 / (1 + F.exp(-d))).otherwise(F.exp(d) / (1 + F.exp(d)))


def evidence_of(votes: DataFrame, rates: DataFrame, few: bool = False) -> DataFrame:
    """(task, l1, l0): log-likelihood of a task's votes if it is true and if it is false; rates of ``few`` voters are broadcast."""
    yes = lambda e: F.when(F.col("verdict"), F.log(e)).otherwise(F.log(1 - F.col(e)))
    return votes.join(F.broadcast(rates) if few else rates, "who").groupBy("task").agg(F.sum(yes("e11")).alias("l1"), F.sum(yes("e01")).alias("l0"))


def step(votes: DataFrame, posterior: DataFrame, anchors: DataFrame | None = None, few: bool = False) -> DataFrame:
    """One round of estimation: a new (task, p). Anchored tasks keep the anchor's value."""
    e = evidence_of(votes, rates_of(votes, posterior), few).join(F.broadcast(prevalence(posterior)))
    new = e.select("task", logistic(F.log(F.col("prior")) - F.log(1 - F.col("prior")) + F.col("l1") - F.col("l0")).alias("p"))
    return anchored(new, anchors)


def anchored(posterior: DataFrame, anchors: DataFrame | None) -> DataFrame:
    if anchors is None:
        return posterior
    known = anchors.select("task", F.col("verdict").cast("double").alias("_a"))
    return posterior.join(known, "task", "left").select("task", F.coalesce("_a", "p").alias("p"))


def dawid_skene(votes: DataFrame, max_iters: int = 100, tolerance: float = 1e-6, start: DataFrame | None = None, anchors: DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame, int, bool]:
    """(posterior, rates, iterations, converged). ``start`` gives another first (task, p), ``anchors`` known verdicts.

    ``folder`` is shared by all executors: each round is written there, so the plan doesn't grow; without it the rounds
    are chained lazily, which suits a few of them. Votes are written there once, a task's beside each other, so a round
    sums most of a task's evidence before it shuffles anything.
    """
    votes = votes.where("task IS NOT NULL AND who IS NOT NULL AND verdict IS NOT NULL")
    few = False
    if folder is not None:
        votes = votes.select("task", "who", "verdict")
        votes.repartition("task").sortWithinPartitions("task").write.mode("overwrite").parquet(f"{folder}/votes")
        votes = votes.sparkSession.read.schema(votes.schema).parquet(f"{folder}/votes")
        few = votes.agg(F.count_distinct("who")).first()[0] <= FEW
    spark, p = votes.sparkSession, anchored(start if start is not None else vote_shares(votes), anchors)
    done = False
    n = 0
    for n in range(1, max_iters + 1):
        new = step(votes, p, anchors, few)
        if folder is not None:
            new.write.mode("overwrite").parquet(f"{folder}/round-{n}")
            new = spark.read.schema(new.schema).parquet(f"{folder}/round-{n}")
            moved = new.alias("n").join(p.alias("o"), "task").agg(F.max(F.abs(F.col("n.p") - F.col("o.p")))).first()[0]
            done = moved is None or moved < tolerance
        p = new
        if done:
            break
    return p, rates_of(votes, p), n, done


def reliability(rates: DataFrame) -> DataFrame:
    """(who, reliability): mean of the two rates of being right."""
    return rates.select("who", ((F.col("e11") + 1 - F.col("e01")) / 2).alias("reliability"))


def labels_of(posterior: DataFrame) -> DataFrame:
    """(task, label); a tie is true."""
    return posterior.select("task", (F.col("p") >= 0.5).alias("label"))


def agreement(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of labels that equal the truth on tasks in both; 0 if there are none."""
    return labels.join(truth.select("task", "truth"), "task").agg(F.coalesce(F.avg((F.col("label") == F.col("truth")).cast("double")), F.lit(0.0)).alias("agreement"))


def weighted_targets(votes: DataFrame, rates: DataFrame, floor: float) -> DataFrame:
    """Votes of those whose reliability is at least ``floor``."""
    return votes.join(reliability(rates).where(F.col("reliability") >= floor).select("who"), "who", "left_semi")


def log_likelihood(votes: DataFrame, posterior: DataFrame, rates: DataFrame) -> DataFrame:
    """Of the observed votes; those of unknown voters are skipped."""
    e = evidence_of(votes, rates).join(F.broadcast(prevalence(posterior)))
    a, b = F.log("prior") + F.col("l1"), F.log(1 - F.col("prior")) + F.col("l0")
    top = F.greatest(a, b)
    return e.agg(F.sum(top + F.log(F.exp(a - top) + F.exp(b - top))).alias("log_likelihood"))


def federated_step(votes: DataFrame, posterior: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """As ``step``, but of each task only ring sums of fixed-point log terms leave the voters: masks cancel in sums, so
    the total is what remains (see ``secagg`` for the masked exchange)."""
    r = rates_of(votes, posterior)
    own = votes.join(r, "who").groupBy("task", "who").agg(F.sum(F.when(F.col("verdict"), F.log("e11")).otherwise(F.log(1 - F.col("e11")))).alias("l1"), F.sum(F.when(F.col("verdict"), F.log("e01")).otherwise(F.log(1 - F.col("e01")))).alias("l0"))
    s = own.groupBy("task").agg(decode(ring(F.sum(encode(F.col("l1"))))).alias("l1"), decode(ring(F.sum(encode(F.col("l0"))))).alias("l0")).join(F.broadcast(prevalence(posterior)))
    return anchored(s.select("task", logistic(F.log("prior") - F.log(1 - F.col("prior")) + F.col("l1") - F.col("l0")).alias("p")), anchors)


# --- Estimators with item difficulty: gradient ascent in numpy, one group of votes a task of Spark ---

# Step size, steps a round, priors.
RATE, STEPS, PRIOR = 0.05, 40, 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _update(t: np.ndarray, v: np.ndarray, right1: np.ndarray, right0: np.ndarray, n: int) -> np.ndarray:
    """Posterior from the probabilities of a correct vote if the task is true and if it is false."""
    right1, right0 = np.clip(right1, 1e-9, 1 - 1e-9), np.clip(right0, 1e-9, 1 - 1e-9)
    pos = np.bincount(t, np.log(np.where(v, right1, 1 - right1)), n)
    neg = np.bincount(t, np.log(np.where(v, 1 - right0, right0)), n)
    return _sigmoid(pos - neg)


#: Votes whose probabilities are worked out together, so that all of it stays in a core's cache.
_AT_ONCE = 1 << 15


def _runs(begin: np.ndarray, votes: int) -> Iterator[tuple[int, int, int, int]]:
    """(first task, end, first vote, end) of whole tasks with about ``_AT_ONCE`` votes; ``begin`` has each task's first vote."""
    ends, x = np.r_[begin, votes], 0
    while x < len(begin):
        y = max(x + 1, int(np.searchsorted(begin, begin[x] + _AT_ONCE)))
        yield x, y, int(ends[x]), int(ends[y])
        x = y


def fit_glad(t: np.ndarray, w: np.ndarray, v: np.ndarray, max_iters: int, tolerance: float) -> dict:
    """A vote is right with probability sigmoid(ability * exp(-log difficulty)).

    Votes are put in the order of their tasks, whose sums are then runs, and are gone through in runs that fit a core's cache.
    """
    order = np.argsort(t, kind="stable")
    t, w, v = t[order], np.ascontiguousarray(w[order], np.intp), v[order]
    nt, nw = t.max() + 1, w.max() + 1
    size = np.bincount(t, minlength=nt)
    begin = np.cumsum(size) - size
    runs = list(_runs(begin, len(t)))
    p = np.bincount(t, v.astype(float), nt) / size
    a, b, done, n = np.full(nw, 1.0), np.full(nt, 1.0), False, 0
    pull, held = np.empty(len(t)), np.empty((2, max(e - s for _, _, s, e in runs)))
    while n < max_iters and not done:
        n += 1
        target = np.where(v, p[t], 1 - p[t])
        for _ in range(STEPS):
            inv, minus, db = np.exp(-b), -a, np.empty(nt)
            for x, y, s, e in runs:
                (own, i), r = held[:, : e - s], pull[s:e]
                np.take(minus, w[s:e], out=own, mode="clip"), np.take(inv, t[s:e], out=i, mode="clip")
                np.multiply(own, i, out=r), np.minimum(r, 700, out=r), np.exp(r, out=r), np.add(r, 1, out=r), np.divide(1, r, out=r), np.subtract(target[s:e], r, out=r)
                np.multiply(own, r, out=own), np.multiply(i, r, out=r)
                db[x:y] = np.add.reduceat(own, begin[x:y] - s)
            # Difficulty moves by the gradient at the old abilities, as both are taken before either is changed.
            a, b = a + RATE * (np.bincount(w, pull, nw) - (a - PRIOR)), b + RATE * (db * inv - (b - PRIOR))
        right = _sigmoid(a[w] * np.exp(-b)[t])
        new = _update(t, v, right, right, nt)
        done, p = bool(np.abs(new - p).max() < tolerance), new
    return {"p": p, "ability": a, "difficulty": np.exp(b), "iterations": n, "converged": done}


def fit_rasch(t: np.ndarray, w: np.ndarray, v: np.ndarray, max_iters: int, tolerance: float) -> dict:
    """A vote on class k is right with probability sigmoid(ability[k] - difficulty[k]).

    Exponentials are taken by voter and by task and multiplied for each vote; what was voted doesn't change, so it is added
    up once a round. Votes are put in the order of their tasks, whose sums are then runs.
    """
    order = np.argsort(t, kind="stable")
    t, w, v = t[order], np.ascontiguousarray(w[order], np.intp), v[order]
    nt, nw = t.max() + 1, w.max() + 1
    size = np.bincount(t, minlength=nt)
    begin = np.cumsum(size) - size
    yes = np.bincount(t, v.astype(float), nt)
    p = yes / size
    a, b, done, n = np.ones((2, nw)), np.zeros((2, nt)), False, 0
    right, held = np.empty(len(t)), np.empty(min(_AT_ONCE, len(t)))
    while n < max_iters and not done:
        n += 1
        by, own = (1 - p, p), ((1 - p)[t], p[t])
        told_w = [np.bincount(w, own[k] * (v == bool(k)), nw) for k in (0, 1)]
        told_t = (1 - p) * (size - yes), p * yes
        for _ in range(STEPS):
            da, db = np.empty_like(a), np.empty_like(b)
            for k in (0, 1):
                down, up = np.exp(-np.clip(a[k], -300, 300)), np.exp(np.clip(b[k], -300, 300))
                for x in range(0, len(t), _AT_ONCE):
                    s = right[x : x + _AT_ONCE]
                    r = held[: len(s)]
                    np.take(down, w[x : x + _AT_ONCE], out=s, mode="clip"), np.take(up, t[x : x + _AT_ONCE], out=r, mode="clip")
                    np.multiply(s, r, out=s), np.add(s, 1, out=s), np.divide(1, s, out=s)
                db[k] = by[k] * np.add.reduceat(right, begin) - told_t[k] - (b[k] - b[k].mean()) - 0.01 * b[k].mean() / nt
                np.multiply(right, own[k], out=right)
                da[k] = told_w[k] - np.bincount(w, right, nw) - (a[k] - a[k].mean()) - 0.01 * a[k].mean() / nw
            a, b = a + RATE * da, b + RATE * db
        gauge = a.mean(axis=1, keepdims=True) - 1.0
        a, b = a - gauge, b - gauge
        new = _update(t, v, _sigmoid(a[1][w] - b[1][t]), _sigmoid(a[0][w] - b[0][t]), nt)
        done, p = bool(np.abs(new - p).max() < tolerance), new
    return {"p": p, "ability": a.mean(axis=0), "difficulty": b.mean(axis=0), "iterations": n, "converged": done}


def with_difficulty(votes: DataFrame, fit, group: str, max_iters: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(group, kind, id, value, second, iterations, converged): tasks with posterior and difficulty, voters with ability.

    ``group`` names the column of separate fleets; one fleet's votes are estimated together in one task of Spark, so a
    fleet has to fit there.
    """
    ship(votes.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tasks, t = np.unique(pdf["task"], return_inverse=True)
        who, w = np.unique(pdf["who"], return_inverse=True)
        got = fit(t, w, pdf["verdict"].to_numpy(bool), max_iters, tolerance)
        head = {group: pdf[group].iloc[0], "iterations": got["iterations"], "converged": got["converged"]}
        one = pd.DataFrame({"kind": "task", "id": tasks, "value": got["p"], "second": got["difficulty"], **head})
        two = pd.DataFrame({"kind": "who", "id": who, "value": got["ability"], "second": np.nan, **head})
        return pd.concat([one, two])[[group, "kind", "id", "value", "second", "iterations", "converged"]]

    kind = votes.schema[group].dataType.simpleString()
    return votes.select(group, "task", "who", "verdict").groupBy(group).applyInPandas(run, f"`{group}` {kind}, kind string, id bigint, value double, second double, iterations int, converged boolean")


def starts(votes: DataFrame, truth: DataFrame, seed: int = 7, n: int = 32) -> Iterator[tuple[str, DataFrame]]:
    """Named first posteriors: majority, uninformative, adversarial, oracle and random ones."""
    from ..functions.rng import uniform

    p = vote_shares(votes)
    known = p.join(truth.select("task", F.col("truth").cast("double").alias("t")), "task")
    yield "majority", p
    yield "uninformative", p.select("task", F.lit(0.5).alias("p"))
    yield "adversarial", known.select("task", (1 - F.col("t")).alias("p"))
    yield "oracle", known.select("task", F.col("t").alias("p"))
    for i in range(n):
        yield f"random-{i}", p.select("task", uniform(seed, i, F.col("task")).alias("p"))
