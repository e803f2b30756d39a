"""Federated estimation, channel scans, restarts, the gate and the content baseline against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import channels as C
from tidemark.operators import content as N
from tidemark.operators import federated as D
from tidemark.operators import fitting
from tidemark.operators import gate as X
from tidemark.operators import inference as I
from tidemark.operators import restarts as R
from tidemark.operators import secagg as M
from tidemark.scratch import Scratch


def crowd(rng, tasks, voters, p=0.6, hot=None):
    """Votes with tasks of one to many voters, repeated votes, and one hot task."""
    rows = [(t, w, bool((t % 2 == 0) != ((w % 5 == 0) != (rng.random() < 0.2)))) for t in range(tasks) for w in range(voters) if rng.random() < p * (t % 7) / 6 or w == t % voters]
    rows += [(hot, w, w % 3 != 0) for w in range(voters)] if hot is not None else []
    return rows + rows[:10]


def em(rows, start=None, rounds=100, tol=1e-6, anchors=None):
    """Plain Dawid-Skene: posterior, log-likelihood, rounds."""
    t, ti = np.unique([r[0] for r in rows], return_inverse=True)
    w, wi = np.unique([r[1] for r in rows], return_inverse=True)
    v = np.array([r[2] for r in rows], float)
    p = np.bincount(ti, v) / np.bincount(ti) if start is None else np.array([start[x] for x in t])
    fixed = np.array([anchors[x] if anchors and x in anchors else np.nan for x in t], float)
    p = np.where(np.isnan(fixed), p, fixed)

    def evidence(p):
        q = p[ti]
        a = (np.bincount(wi, q * v) + 1) / (np.bincount(wi, q) + 2)
        b = (np.bincount(wi, (1 - q) * v) + 1) / (np.bincount(wi, 1 - q) + 2)
        pr = min(max(p.mean(), 1e-6), 1 - 1e-6)
        one = np.bincount(ti, np.where(v == 1, np.log(a[wi]), np.log(1 - a[wi])))
        two = np.bincount(ti, np.where(v == 1, np.log(b[wi]), np.log(1 - b[wi])))
        return math.log(pr) + one, math.log(1 - pr) + two

    n = 0
    while n < rounds:
        n += 1
        x, y = evidence(p)
        new = 1 / (1 + np.exp(np.clip(y - x, -700, 700)))
        new = np.where(np.isnan(fixed), new, fixed)
        moved, p = np.abs(new - p).max(), new
        if moved < tol:
            break
    return dict(zip(t.tolist(), p, strict=True)), float(np.logaddexp(*evidence(p)).sum()), n


@pytest.fixture(scope="module")
def votes(spark):
    rows = crowd(np.random.default_rng(4), 60, 90, hot=1000)
    return rows, spark.createDataFrame([*rows, (None, 1, True), (3, None, True), (3, 1, None)], "task int, who int, verdict boolean").repartition(3)


def test_federated_equals_central(votes, spark):
    rows, df = votes
    r = D.federated_dawid_skene(df, seed=9)
    want, _, n = em(rows)
    got = {x.task: x.p for x in r.posterior.collect()}
    assert r.converged and r.iterations == n and r.participants == len({x[1] for x in rows})
    assert got.keys() == want.keys() and max(abs(got[t] - want[t]) for t in want) < 1e-9
    seen = {x.task: x.seen for x in r.readership.collect()}
    assert all(seen[t] == sum(x[0] == t for x in rows) for t in want)
    assert r.prevalence == pytest.approx(np.mean(list(want.values())))
    rules = spark.createDataFrame([(t, t % 2 == 0) for t in range(0, 60, 3)] + [(5, None), (777, True)], "task int, verdict boolean")
    r = D.federated_dawid_skene(df, anchors=rules)
    want, _, n = em(rows, anchors={t: float(t % 2 == 0) for t in range(0, 60, 3)})
    assert r.converged and r.iterations == n
    assert max(abs(x.p - want[x.task]) for x in r.posterior.collect()) < 1e-9


def test_no_share_stands_alone(votes):
    _, df = votes
    links = D.exchange(df).cache()
    per = links.groupBy("task", "cell").agg(F.count("*").alias("n"), F.min(F.size("peers")).alias("peers")).agg(F.min("n"), F.max("n"), F.min("peers")).first()
    assert per[0] >= 3 and per[1] < 2 * 32 and per[2] >= 2
    hot = links.where("task = 1000").select("cell").distinct().count()
    assert hot == 2  # ninety voters of one task are dealt to two cells
    raw = links.select("task", "cell", "who", F.col("yes").cast("double").alias("t"))
    one = D.shares(links, [F.col("yes").cast("double")], 1).join(raw, ["task", "cell", "who"])
    assert one.where(F.abs(D.decode(F.col("s0")) - F.col("t")) < 0.01).count() == 0  # no share is what it hides
    two = D.shares(links, [F.col("yes").cast("double")], 2)
    assert one.select("s0").intersect(two.select("s0")).count() == 0  # masks are fresh in each round
    back = D.revealed(one, 1).join(links.groupBy("task").agg(F.sum("yes").alias("y")), "task")
    assert back.where(F.col("t0") != F.col("y")).count() == 0


def test_federated_refuses_and_takes_nothing(spark, votes):
    two = spark.createDataFrame([(t, w, True) for t in range(5) for w in range(2)], "task int, who int, verdict boolean")
    with pytest.raises(ValueError, match="fewer than 3"):
        D.federated_dawid_skene(two)
    r = D.federated_dawid_skene(votes[1].limit(0))
    assert (r.iterations, r.converged, r.participants, r.posterior.count()) == (0, True, 0, 0)
    three = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 2, False)], "task int, who int, verdict boolean")
    want, _, _ = em([(0, 0, True), (0, 1, True), (1, 2, False)])
    got = {x.task: x.p for x in D.federated_dawid_skene(three).posterior.collect()}
    assert all(abs(got[t] - want[t]) < 1e-9 for t in want)


def test_cohorts_take_nulls_and_repeats(spark):
    rows = [(None, 1, [1.0, 2.0]), (None, 2, [0.5, 0.25]), (None, 3, [-1.0, 4.0]), (None, 3, [1.0, 1.0]), ("a", 1, [1.0, 1.0]), ("a", 2, [1.0, 1.0]), ("b", None, [9.0]), ("b", 2, None), ("b", 3, [])] + [("c", i, [float(i)] * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, client int, v array<double>")
    got = {(r.g, r.coord): (r.total, r.participants) for r in M.cohort_sum(df, 3, ["g"]).collect()}
    assert got == {(None, 0): (1.5, 3), (None, 1): (7.25, 3), **{("c", i): (float(sum(range(200))), 200) for i in range(3)}}
    assert {r.coord: r.total for r in M.cohort_sum(df.where("g = 'c'").drop("g"), 3).collect()} == {i: 19900.0 for i in range(3)}


# --- channels


def scan_rows(spark):
    blind = [(t, t % 2, t % 3 == 0, t % 5 == 0, 0.1 + 0.01 * (t % 4) if t % 3 == 0 else 0.9 - 0.02 * (t % 5)) for t in range(90)]
    rows = spark.createDataFrame([(*r, True) for r in blind], "task int, stratum int, a boolean, b boolean, rate double, every boolean")
    return C.by_channel(rows, {"A": F.col("a"), "B": F.col("b"), "ALL": F.col("every")})


def test_scan_finds_the_channel_and_no_other(spark):
    got = {r.channel: r for r in C.scan(scan_rows(spark), ["channel"]).collect()}
    assert set(got) == {"A", "B"}  # a channel that all tasks carry has no result
    assert got["A"].detected and got["A"].p == 1 / 4201 and got["A"].extreme == 0 and not got["B"].detected
    again = {r.channel: r.p for r in C.scan(scan_rows(spark).repartition(7), ["channel"]).collect()}
    assert again == {k: r.p for k, r in got.items()}


def test_null_has_its_moments_and_ties_count(spark):
    counts = C.counted(scan_rows(spark).where("channel = 'B'"), ["channel"])
    gaps = C.null_gaps(counts, ["channel"], 4000).groupBy("draw").agg(F.avg("gap").alias("g")).agg(F.avg("g"), F.stddev_samp("g")).first()
    sd = C.observed(counts, ["channel"]).first().null_sd
    assert abs(gaps[0]) < 4 * sd / math.sqrt(4000) and gaps[1] == pytest.approx(sd, rel=0.05)
    small = spark.createDataFrame([(0, i < 2, float(i)) for i in range(5)], "stratum int, carries boolean, rate double")
    r = C.scan(small, draws=4000).first()
    assert r.p == pytest.approx(0.1, abs=0.02) and r.delta == pytest.approx(0.5 - 3.0)  # one of ten choices is as low
    flat = small.withColumn("rate", F.lit(0.3))
    assert C.scan(flat, draws=50).first().p == 1.0
    assert C.scan(small.limit(0)).count() == 0


# --- restarts


def test_restarts_equal_single_fits(spark):
    rng = np.random.default_rng(8)
    truth = {t: t % 2 == 0 for t in range(40)}
    rows = {k: [(t, w, bool(truth[t] != (w < k))) if rng.random() > 0.15 else (t, w, bool(rng.random() < 0.5)) for t in range(40) for w in range(7)] for k in (2, 5)}
    votes = spark.createDataFrame([(k, *r) for k, v in rows.items() for r in v], "n_wrong int, task int, who int, verdict boolean")
    known = spark.createDataFrame(list(truth.items()), "task int, truth boolean")
    runs = R.study(votes, known, ["n_wrong"], restarts=3)
    got = {(r.n_wrong, r.start): r for r in runs.collect()}
    starts = {(r.n_wrong, r.start, r.task): r.p for r in R.all_starts(R.counted(votes, ["n_wrong"]), known, ["n_wrong"], 3).collect()}
    assert len(got) == 14
    for (k, name), r in got.items():
        p, ll, n = em(rows[k], {t: starts[k, name, t] for t in truth})
        assert r.log_likelihood == pytest.approx(ll, abs=1e-6) and r.iterations == n and r.converged and r.shift < 1e-5
        assert r.agreement == pytest.approx(np.mean([(p[t] >= 0.5) == truth[t] for t in truth]))
    cells = {r.n_wrong: r for r in R.composition_rows(runs, ["n_wrong"]).collect()}
    assert cells[2].published_recovers and not cells[5].published_recovers and cells[5].restarts == 3
    both = [got[5, f"random-{i}"] for i in range(3)]
    assert cells[5].best_restart_agreement == max(both, key=lambda r: round(r.log_likelihood, 6)).agreement
    s = {r.n_wrong: r for r in R.summarise(R.composition_rows(runs, ["n_wrong"]), ["n_wrong"]).collect()}
    assert (s[2].draws_broken, s[5].draws_broken) == (0, 1) and s[2].restart_recovery_rate is None
    assert s[5].median_gap == pytest.approx(got[5, "oracle"].log_likelihood - got[5, "majority"].log_likelihood, abs=1e-4)


# --- gate and content


def newton(x, y, l2, free):
    n, k = len(y), y.sum()
    s = np.where(y == 1, n / (2 * k), n / (2 * (n - k)))
    ridge = np.full(x.shape[1], l2)
    ridge[free] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (s * (p - y)) + ridge * w)
    return w


def area(z, y):
    a, b = z[y], z[~y]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_gate_equals_a_plain_fit(spark):
    rng = np.random.default_rng(6)
    x = np.c_[rng.normal(2000, 500, 400), rng.random(400), np.zeros(400)]
    center, y = rng.integers(0, 5, 400), (x[:, 0] + rng.normal(0, 700, 400)) > 2000
    y[center == 4] = True  # a center of one class has no fold
    df = spark.createDataFrame([(i, f"c{c}", bool(t), *map(float, r)) for i, (c, t, r) in enumerate(zip(center, y, x, strict=True))] + [(900, "c0", True, None, 1.0, 0.0)], "id int, center string, positive boolean, a double, b double, z double").repartition(4)
    g = X.run_gate(df, ["a", "b", "z"], null_trials=30)
    assert set(g.per_fold) == {f"c{i}" for i in range(4)} and g.converged and g.n_rows == 400 and g.n_test == int((center != 4).sum())
    for c in range(4):
        tr, te = center != c, center == c
        sd = x[tr].std(axis=0)
        scaled = (x - x[tr].mean(axis=0)) / np.where(sd > 0, sd, 1)
        u = np.c_[scaled, np.ones(400)]
        w = newton(u[tr], y[tr].astype(float), 1.0, 3)
        assert g.per_fold[f"c{c}"] == pytest.approx(area(u[te] @ w, y[te]), abs=1e-6)
    assert g.leak_is_significant and not g.passed and len(g.null) == 30 and abs(g.null_mean - 0.5) < 0.05 and g.null_z > 4
    assert X.run_gate(df, ["a", "b", "z"]).leak_is_significant is None
    with pytest.raises(ValueError, match="two centers"):
        X.run_gate(df.where("center = 'c0'"), ["a"])
    with pytest.raises(ValueError, match="both classes"):
        X.run_gate(df.where("positive"), ["a"])


def test_shuffled_labels_keep_their_number(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    cuts = fitting.thresholds(rows, 4, 1234, 3)
    h = np.array([r.h for r in rows.collect()])
    sets = [fitting.trial_hash(h, t, 3).astype(np.int64) <= c for t, c in enumerate(cuts)]
    assert [int(s.sum()) for s in sets] == [1234] * 4
    assert 200 < int((sets[0] & sets[1]).sum()) < 420  # trials are independent


def test_content_baseline(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, 25)) + (" grumble" if i % 3 == 0 and rng.random() < 0.8 else ""), i % 3 == 0) for i in range(300)] + [(300, None, False), (301, "", True), (302, "x", None), (303, "once", True)]
    df = spark.createDataFrame(rows, "id int, text string, positive boolean").select("*", F.lit(1).alias("fold"), F.lit("q").alias("term"))
    scratch = Scratch(spark, "content-test")
    out, made = N.baseline(df, scratch)
    got, v = {r.fold: r for r in out.collect()}, made.toPandas().sort_values("id")
    assert sum(r.n for r in got.values()) == 303 and min(r.auc for r in got.values()) > 0.8
    width = int(max(max(a) for a in v["at"])) + 1
    x = np.zeros((len(v), width))
    for i, (a, b) in enumerate(zip(v["at"], v["x"], strict=True)):
        x[i, a] = b
    assert np.allclose((x[:, :-1] ** 2).sum(axis=1)[:300], 1.0) and x[-1, :-1].sum() == 0  # a term of one document is none
    for k, r in got.items():
        tr, te = (v["fold"] != k).to_numpy(), (v["fold"] == k).to_numpy()
        y = v["y"].to_numpy()
        assert r.auc == pytest.approx(area(np.round(x[te] @ newton(x[tr], y[tr], 1.0, width - 1), 6), y[te] == 1), abs=2e-3)
    with pytest.raises(ValueError):
        N.baseline(df.where("positive"), scratch)


def test_sums_of_ring_elements_are_exact(spark):
    rng = np.random.default_rng(3)
    x = [759717859617144773, (1 << 60) - 1, (1 << 59) + (1 << 30) - 1, *(int(h) << 30 | (1 << 30) - int(k) for h, k in zip(rng.integers(1 << 24, 1 << 30, 200), rng.integers(1, 65, 200)))]
    got = spark.createDataFrame([(i % 7, v) for i, v in enumerate(x)], "g long, x long").groupBy("g").agg(D.ring_sum(F.col("x")).alias("s")).collect()
    assert {r.g: r.s for r in got} == {g: sum(x[g::7]) % (1 << 60) for g in range(7)}


def test_a_share_just_below_a_half_is_read_right(spark):
    # Of this task and seed the second voter's first share ends 59 below a multiple of 2^30.
    votes = spark.createDataFrame([(263176, w, w % 3 > 0) for w in range(9)], "task long, who long, verdict boolean")
    assert [(r.votes, r.seen) for r in D.start(D.exchange(votes), 5).collect()] == [(6.0, 9.0)]


# --- difficulty and studies


def test_votes_of_few_voters_are_shuffled_once(spark, monkeypatch):
    from tidemark.operators import difficulty as Y

    def no(*x):
        raise AssertionError("votes are joined")

    df = spark.createDataFrame(crowd(np.random.default_rng(5), 30, 9), "task int, who int, verdict boolean")
    for model in (Y.Glad, Y.Rasch):
        monkeypatch.setattr(Y, "FEW", 8)
        want = [x.toPandas().sort_values(x.columns[0]).to_numpy(float) for x in Y.fit(df, model, max_iters=2, steps=2)[:2]]
        monkeypatch.undo()
        monkeypatch.setattr(Y, "joined", no)
        got = [x.toPandas().sort_values(x.columns[0]).to_numpy(float) for x in Y.fit(df, model, max_iters=2, steps=2)[:2]]
        monkeypatch.undo()
        assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["glad", "rasch"])
def test_grouped_steps_equal_the_fit_in_memory(spark, monkeypatch, name):
    from tidemark.operators import difficulty as Y

    model, fit = {"glad": (Y.Glad, I.fit_glad), "rasch": (Y.Rasch, I.fit_rasch)}[name]
    monkeypatch.setattr(I, "STEPS", 3)
    rows = crowd(np.random.default_rng(2), 21, 8)
    df = spark.createDataFrame([*rows, (None, 1, True), (3, 1, None)], "task int, who int, verdict boolean").repartition(3)
    tasks, voters, n, done = Y.fit(df, model, max_iters=4, steps=3)
    t, ti = np.unique([r[0] for r in rows], return_inverse=True)
    w, wi = np.unique([r[1] for r in rows], return_inverse=True)
    want = fit(ti, wi, np.array([r[2] for r in rows]), 4, 1e-6)
    got = {r.task: r for r in tasks.collect()}
    assert (n, done) == (want["iterations"], want["converged"]) and list(sorted(got)) == t.tolist()
    assert np.allclose([[got[x].p, got[x].difficulty] for x in t.tolist()], np.stack([want["p"], want["difficulty"]], axis=1), atol=1e-9)
    able = {r.who: r.ability for r in voters.collect()}
    assert np.allclose([able[x] for x in w.tolist()], want["ability"], atol=1e-9)
    none, _, n, done = Y.fit(df.limit(0), model)
    assert none.count() == 0 and (n, done) == (0, True)


def test_conditions_and_the_cliff(spark):
    from tidemark.operators import studies as Y

    truth = {t: t % 3 != 0 for t in range(30)}
    rows = [(k, t, w, truth[t] != (w < k)) for k in (0, 2, 3, 5) for t in range(30) for w in range(5)]
    votes = spark.createDataFrame(rows, "n_wrong int, task int, who int, verdict boolean")
    known = spark.createDataFrame(list(truth.items()), "task int, truth boolean")
    out = Y.conditions(votes, known, ["n_wrong"], Scratch(spark, "conditions-test")).cache()
    got = {r.n_wrong: r for r in out.collect()}
    assert {k: (r.unweighted, r.oracle, r.consensus, r.dawid_skene, r.kept, r.targets) for k, r in got.items()} == {
        0: (1.0, 1.0, 1.0, 1.0, 150, 150), 2: (0.6, 1.0, 1.0, 1.0, 90, 150), 3: (0.4, 1.0, 0.0, 0.0, 60, 150), 5: (0.0, None, 0.0, 0.0, 0, 150),
    }
    r = Y.cliff_row(out, "n_wrong", 5).first()
    assert (r.majority, r.cliff_at, r.cliff_is_at_majority, r.consensus_before, r.consensus_at, r.dawid_skene_survives) == (3, 3, True, 1.0, 0.0, False)
    assert Y.cliff_row(out.where("n_wrong < 3"), "n_wrong", 5).first().cliff_at is None
    reviews = spark.createDataFrame([(1, 1, "accept", True, None), (1, 2, "revise", True, False), (1, 3, "reject", True, None)], "task int, who int, action string, proposed boolean, corrected boolean")
    assert sorted(tuple(r) for r in Y.targets(reviews, []).collect()) == [(1, 1, True), (1, 2, False)]


def test_winning_rules(spark):
    from tidemark.operators import studies as Y

    base = "task int, votes long, seen long, posterior double, evidence int, carries boolean, truth boolean, label boolean"
    rows = lambda wrong, sure: spark.createDataFrame([(i, 9 if sure(i) else 5, 9, 0.99 if sure(i) else 0.55, 1, i % 4 == 0, True, not wrong(i)) for i in range(80)], base)
    by_channel = Y.winning_rule(rows(lambda i: i % 4 == 0, lambda i: i % 5 > 0), budget=20)
    assert by_channel["winner"] == "channel" and by_channel["channel"] == 0.0
    by_margin = Y.winning_rule(rows(lambda i: i % 5 == 1, lambda i: i % 5 != 1), budget=16)
    assert by_margin["winner"] == "confidence" and by_margin["confidence"] == 0.0
    assert Y.winning_rule(rows(lambda i: False, lambda i: True))["winner"] is None


def test_a_pass_sends_blocks_of_sums():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    sizes, width, folds = rng.integers(0, 9, 500), 3000, 4
    at, x = [rng.choice(width, n, replace=False) for n in sizes], [rng.standard_normal(n) for n in sizes]
    fold, y, w = rng.integers(0, folds, 500), rng.integers(0, 2, 500).astype(float), rng.standard_normal((folds, width))
    rows = pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(y), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], ["fold", "y", "at", "x"])
    weight = np.ones((folds, 2)) * [0.5, 2.0]
    parts = [b for i in (0, 200) for b in fitting._pass(w, weight, fitting.Labels(), folds)(iter([rows.slice(i, 200 if i == 0 else 300), rows.slice(0, 0)]))]
    assert all(b.num_rows <= -(-folds * (width + 1) // fitting.BLOCK) for b in parts)
    got = np.zeros(folds * (width + 1))
    for k, v in (r.values() for b in fitting._added(iter(parts)) for r in b.to_pylist()):
        got[k * fitting.BLOCK : (k + 1) * fitting.BLOCK] = v
    m = np.zeros((500, width))
    for i in range(500):
        m[i, at[i]] = x[i]
    z, s = m @ w.T, np.where(y == 1, 2.0, 0.5)[:, None] * (fold[:, None] != np.arange(folds))
    want = np.c_[(s * (np.logaddexp(0, z) - y[:, None] * z)).sum(axis=0), (s * (1 / (1 + np.exp(-z)) - y[:, None])).T @ m]
    assert np.allclose(got.reshape(folds, -1), want, atol=1e-9)
