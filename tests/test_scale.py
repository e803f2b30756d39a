"""Steps that once grew faster than their input, against the plain forms they stand for."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions.rng import Draws, below
from tidemark.operators import federated as D
from tidemark.operators import inference as I
from tidemark.operators import linkage as K
from tidemark.operators import restarts as R
from tidemark.operators import robust as V
from tidemark.operators import slices as Z
from tidemark.operators import stats as S
from tidemark.plans import fleet_queries as Q
from tidemark.scratch import Scratch


def test_draws_are_md5():
    numbers = np.array([0, 7, 10, 999, 1000, -5, 2**40, 2**62, *range(50_000, 50_100)])
    for tail in (b"", b":part"):
        draws = Draws(numbers, tail)
        for prefix in ("7:", "7:12345:", "x" * 20):
            want = np.array([int(hashlib.md5(prefix.encode() + str(n).encode() + tail).hexdigest()[:8], 16) for n in numbers], np.uint32)
            assert (draws.under(prefix) == want).all()
            assert (draws.under(prefix, numbers % 2 == 0) == want[numbers % 2 == 0]).all()
    assert (below(0.25), below(0.0), below(1.0)) == (1 << 30, 0, 1 << 32)


def test_counted_draws_are_the_rows_counted(spark):
    fleet = spark.createDataFrame([(a, a // 2, a % 4, a * 7 % 16) for a in range(90)] + [(3, 1, 3, 15)], "analyst long, pseudonym long, sens int, mask int")
    tasks = spark.createDataFrame([(t, t % 4, (0, 1, 2, 4, 8)[t % 5]) for t in range(0, 1500, 7)], "task long, sens int, mask int")
    for ruling, ceiling, fabricate in ((L.DROP, (0, 0), 0.05), (L.KEEP, (0, 1), 0.05), (L.KEEP, (1, 1), 0.0)):
        rows = K.participation(fleet, tasks, 0.8, fabricate, ruling=ruling, ceiling=ceiling)
        want = rows.groupBy("analyst").agg(F.count("*"), F.sum(F.col("genuine").cast("long")), F.sum((~F.col("readable")).cast("long")), F.sum(F.col("coin").cast("long")))
        got = K.drawn_counts(fleet, tasks, 0.8, fabricate, ruling=ruling, ceiling=ceiling)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert K.noise_of(got).first().asDict() == K.label_noise(rows).first().asDict()
    want = K.subsample(K.contribute(fleet, tasks), 0.25).groupBy("analyst").count()
    assert sorted(map(tuple, K.drawn_counts(fleet, tasks, 0.25, 0.0, tail="", coin="").select("analyst", "n").collect())) == sorted(map(tuple, want.collect()))


def test_posteriors_are_not_broadcast(spark):
    votes = spark.createDataFrame([(t, w, (t + w) % 3 > 0) for t in range(20) for w in range(5)], "task long, who long, verdict boolean")
    truth = votes.select("task", (F.col("task") % 2 == 0).alias("truth")).distinct()
    counts = R.counted(votes, [])
    starts = R.all_starts(counts, truth, [], 2)
    for df in (R.rates(counts, starts, []), R.step(counts, starts, [])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        # Only the prior, a row a start, may be sent whole.
        assert plan.count("BroadcastHashJoin") <= 1


def test_krum_scores_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.default_rng(3)
    some = rng.normal(size=(25, 5))
    sets = {1: np.r_[some, some[:4], some[:1], some[:1], some[:1], 1e6 * rng.normal(size=(3, 5))], 2: np.ones((9, 5)), 3: some[:2], 4: some[:1], 5: some[:5]}
    rows = [(r, c, v.tolist()) for r, m in sets.items() for c, v in enumerate(m)]
    f, want = 2, {}
    for r, m in sets.items():
        if len(m) > 1:
            d = ((m[:, None] - m[None]) ** 2).sum(axis=2)
            scores = [np.sort(np.delete(d[i], i))[: max(1, len(m) - f - 2)].sum() for i in range(len(m))]
            want |= {(r, c): x for c, x in enumerate(scores)}
    scored = V.krum_scores(spark.createDataFrame(rows, "round int, client long, v array<double>"), f)
    # No row a pair: blocks are compared within tasks.
    assert "MapInPandas" in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.round, x.client): (x.score, x.place) for x in scored.collect()}
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k][0], want[k], rtol=1e-12, atol=0) for k in want)
    assert [c for _, c in sorted((got[2, c][1], c) for c in range(9))] == list(range(9))


def test_estimation_writes_its_votes_once(spark, tmp_path):
    votes = spark.createDataFrame([(t, w, (t * 5 + w * 3) % 7 > 2) for t in range(40) for w in range(6)] + [(None, 1, True)], "task long, who long, verdict boolean")
    p, _, n, _ = I.dawid_skene(votes, max_iters=3, tolerance=0.0, folder=f"file://{tmp_path}")
    assert n == 3 and spark.read.parquet(f"file://{tmp_path}/votes").count() == 240
    want = dict(map(tuple, I.dawid_skene(votes, max_iters=3)[0].collect()))
    got = dict(map(tuple, p.collect()))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_the_view_of_all_policies_is_made_once(spark):
    plan = Q.audit_policies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_permutation_p_tells_p(spark):
    assert Q.permutation_p(spark, "/root/testdata/sf0.001").columns == ["delta", "strata", "p", "detected"]
    assert "range(4200)" in Q.PERMUTATION_P


def test_rates_of_few_voters_are_sent_to_the_links(spark):
    votes = spark.createDataFrame([(t, w, (t * 5 + w * 3) % 7 > 2) for t in range(12) for w in range(8)], "task long, who long, verdict boolean")
    links = D.exchange(votes)
    p = D.start(links, 1).select("task", "p")
    one, two = (dict(map(tuple, D.advance(links, p, None, 3, few).collect())) for few in (True, False))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_rounds_of_all_starts_send_sums_by_voter(spark, monkeypatch):
    votes = spark.createDataFrame([(t, w, (t * 5 + w * 3) % 7 > 2) for t in range(60) for w in range(t % 3, 8)] + [(3, 4, True), (None, 1, True)], "task long, who long, verdict boolean")
    truth = spark.createDataFrame([(t, t % 2 == 0 if t % 5 else None) for t in range(50)], "task long, truth boolean")
    monkeypatch.setattr(R, "CHUNK", 3)
    scratch = Scratch(spark, "rounds")
    monkeypatch.setattr(R, "PAIRS", 0)  # merged tables
    want = {r.start: r for r in R.judged_rounds(votes, truth, scratch, 2, n=3).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(R, "CHUNK", 3)
    monkeypatch.setattr(R, "fit", None)  # a row for each vote and start
    got = {r.start: r for r in R.judged_rounds(votes, truth, scratch, 2, n=3).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for k, r in want.items():
        assert abs(got[k].log_likelihood - r.log_likelihood) < 1e-9 and abs(got[k].agreement - r.agreement) < 1e-12 and got[k].iterations == 2


def test_slices_are_drawn_without_a_row_for_each_task_and_draw(spark):
    pool = spark.createDataFrame([(t, t % 16) for t in range(5, 900, 3)] + [(None, 3)], "task long, mask int")
    got = Z.draws(pool.repartition(3), 20, 4, lambda d: f"7:null:{d}:")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    h = lambda d, t: int(hashlib.md5((f"7:null:{d}" + ("" if t is None else f":{t}")).encode()).hexdigest()[:8], 16)
    rows = [r.task for r in pool.collect()]
    want = {(d, t) for d in range(20) for t in sorted(rows, key=lambda t: (h(d, t), t or 0))[:4]}
    assert {(r.draw, r.task) for r in got.collect()} == want


def test_resamples_are_not_joined(spark, monkeypatch):
    trials = spark.createDataFrame([(t, None if t % 7 == 0 else (t * k) % 3 > 0) for t in range(400) for k in range(t % 4 + 1)], "task long, outcome boolean")
    got = S.resampled(trials, 60)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(S, "SENT", 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.resampled(trials, 60).collect()))
    for a in (0, 9_990, 99_990, 12_309_995):
        at = np.arange(a, a + 10_020)
        assert (S._range_hashes(at, "7:", {}) == [int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], 16) for i in at]).all()


def test_rasch_takes_no_exponential_by_vote_and_step(monkeypatch):
    rng = np.random.default_rng(4)
    t, w = np.unique(rng.integers(0, 90, 1500), return_inverse=True)[1], np.unique(rng.integers(0, 40, 1500), return_inverse=True)[1]
    v = (t % 2 == 0) != (rng.random(1500) < 0.2)
    sizes, plain = [], I._sigmoid
    monkeypatch.setattr(I, "_sigmoid", lambda x: sizes.append(len(x)) or plain(x))
    got = I.fit_rasch(t, w, v, 3, 0.0)
    assert sizes.count(1500) == 2 * 3  # at the end of a round
    p, a, b = np.bincount(t, v) / np.bincount(t), np.ones((2, 40)), np.zeros((2, 90))
    for _ in range(3):
        for _ in range(I.STEPS):
            res = [(p[t] if k else 1 - p[t]) * ((v == bool(k)) - plain(a[k][w] - b[k][t])) for k in (0, 1)]
            m, n = a.mean(axis=1, keepdims=True), b.mean(axis=1, keepdims=True)
            da = np.stack([np.bincount(w, r, 40) for r in res]) - (a - m) - 0.01 * m / 40
            db = -np.stack([np.bincount(t, r, 90) for r in res]) - (b - n) - 0.01 * n / 90
            a, b = a + I.RATE * da, b + I.RATE * db
        g = a.mean(axis=1, keepdims=True) - 1
        a, b = a - g, b - g
        p = I._update(t, v, plain(a[1][w] - b[1][t]), plain(a[0][w] - b[0][t]), 90)
    assert np.allclose(got["p"], p, atol=1e-9) and np.allclose(got["ability"], a.mean(axis=0)) and np.allclose(got["difficulty"], b.mean(axis=0))


def test_orders_of_draws_are_not_shuffled(spark, monkeypatch):
    rows = [(t, t % 3 if t % 50 else None, None if t % 41 == 0 else t % 7 < 2, None if t % 13 == 0 else (t * 37 % 11) / 10) for t in range(-40, 900)]
    rows += [(1000 + t, 7, True, 0.5) for t in range(5)] + [(2000, 8, True, None), (2001, 8, False, 0.5)]
    view = spark.createDataFrame(rows, "task int, stratum int, carries boolean, rate double")
    want = S.stratified_delta(S.shuffled(view, 60, 5), ["draw"]).collect()
    monkeypatch.setattr(S, "shuffled", None)
    for block, width in ((1 << 16, 5.0), (100, 0.05)):  # narrow: draws are done again
        monkeypatch.setattr(S, "BLOCK", block)
        got = S.order_gaps(view, 60, 5, Scratch(spark, "t"), width).where("gap IS NOT NULL").groupBy("draw").agg(F.avg("gap"), F.count("*")).collect()
        assert [(r[0], r[2]) for r in sorted(got)] == [(r[0], r[2]) for r in sorted(want)]
        assert np.allclose([r[1] for r in sorted(got)], [r[1] for r in sorted(want)], rtol=0, atol=1e-12)
    assert S.channel_test(view, 60).columns == ["delta", "strata", "p", "detected"]


def test_blocks_of_analysts_grow_with_their_number(spark):
    fleet = spark.range(6000).select(F.col("id").alias("analyst"), (F.col("id") % 4).cast("int").alias("sens"), F.lit(3).alias("mask"))
    blocks = K._packed(fleet, "analyst", K.PEOPLE, K.CROWD).select(F.size("analyst_analyst")).collect()
    assert len(blocks) == 16 and sum(r[0] for r in blocks) == 6000  # 94 blocks of 64 sent each block of tasks 94 times
    assert K._packed(fleet.limit(640), "analyst", K.PEOPLE, K.CROWD).count() > 8


def test_study_merges_no_posteriors(spark, monkeypatch):
    rows = [(f, d, t, w, (t % 2 == 0) != ((w < f) or (t * 7 + w * 5 + d) % 6 == 0)) for f in (1, 3) for d in (0, 1) for t in range(60) for w in range(5)] + [(None, 0, 1, 1, True), (1, 0, 5, 3, None), (1, 0, 5, 3, True)]
    votes = spark.createDataFrame(rows, "n_wrong int, draw int, task bigint, who int, verdict boolean")
    truth = spark.createDataFrame([(t, None if t % 9 == 0 else t % 2 == 0) for t in range(50)], "task bigint, truth boolean")
    key = ["n_wrong", "draw", "start"]
    for most in (100, 3):
        with monkeypatch.context() as m:
            m.setattr(R, "PAIRS", 0)
            want = R.study(votes, truth, ["n_wrong", "draw"], 2, max_iters=most).toPandas().sort_values(key)
        with monkeypatch.context() as m:
            m.setattr(R, "fit", None)
            got = R.study(votes, truth, ["n_wrong", "draw"], 2, max_iters=most).toPandas().sort_values(key)
        assert got[[*key, "iterations", "converged"]].to_numpy().tolist() == want[[*key, "iterations", "converged"]].to_numpy().tolist() and len(want) == 24
        assert np.allclose(got[["log_likelihood", "agreement", "shift"]], want[["log_likelihood", "agreement", "shift"]], rtol=0, atol=1e-9)
