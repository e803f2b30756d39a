"""Semantics on small literal inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import text as T
from tidemark.operators import governance as G
from tidemark.operators import inference as I
from tidemark.operators import review as R
from tidemark.operators import robust as V
from tidemark.operators import secagg as M
from tidemark.operators import stats as S
from tidemark.sources import corpus as C
from tidemark.streaming import votes as streaming


def one(df):
    return df.collect()[0]


def test_all_labels_form_a_lattice(spark):
    a, b = L.candidates(spark).alias("a"), L.candidates(spark).alias("b")
    x, y = L.label(F.col("a.c_sens"), F.col("a.c_mask")), L.label(F.col("b.c_sens"), F.col("b.c_mask"))
    top = L.join_array(F.array(x, y), 0)
    pairs = a.crossJoin(b).select(L.dominates(x, y).alias("xy"), L.dominates(y, x).alias("yx"), (F.struct("a.c_sens", "a.c_mask") == F.struct("b.c_sens", "b.c_mask")).alias("same"), L.dominates(top, x).alias("tx"), L.dominates(top, y).alias("ty"))
    assert pairs.where("xy AND yx AND NOT same OR NOT tx OR NOT ty").count() == 0
    assert pairs.where("NOT xy AND NOT yx").count() > 0


def test_join_of_nothing_is_bottom(spark):
    r = one(spark.createDataFrame([], "s int, m int").agg(L.join_agg("s", "m", 3).alias("j"))).j
    assert (r.sens, r.mask, r.cap) == (0, 0, 3)


@pytest.mark.parametrize(
    ("label", "rules", "purpose", "want"),
    [
        ((2, 1, 0), L.ReleaseRules(L.KEEP), "fleet_training", ("release", "RELEASABLE")),
        ((2, 3, 0), L.ReleaseRules(L.KEEP), "fleet_training", ("approval", "COMPARTMENT_NOT_HELD")),
        ((2, 3, 3), L.ReleaseRules(L.DROP), "fleet_training", ("withhold", "CAPACITY_NOT_DECLASSIFIABLE")),
        ((3, 3, 0), L.ReleaseRules(L.Ruling(floor=2, drop=True)), "fleet_training", ("withhold", "LEVEL_ABOVE_CEILING")),
        ((0, 4, 0), L.ReleaseRules(L.DROP, ((4, "fleet_training"),)), "fleet_training", ("withhold", "PURPOSE_PROHIBITED")),
        ((0, 4, 0), L.ReleaseRules(L.DROP, ((4, "fleet_training"),)), "incident_review", ("release", "RELEASABLE")),
        ((1, 1, 3), L.ReleaseRules(L.KEEP), "fleet_training", ("release", "RELEASABLE")),
    ],
)
def test_decide(spark, label, rules, purpose, want):
    r = one(spark.range(1).select(L.decide(L.label(*label), L.label(1, 1, 3), rules, purpose).alias("d"))).d
    assert (r.disposition, r.reason) == want


def test_render_and_worst(spark):
    assert one(spark.range(1).select(L.render(L.label(3, 11, 3), True).alias("t"))).t == "RESTRICTED[LIAISON,PARTNER,SENSOR]@FREETEXT"
    d = spark.createDataFrame([("release",), ("approval",)], "d string")
    assert one(d.agg(L.most_restrictive(F.col("d")).alias("w"))).w == "approval"
    assert one(d.limit(0).agg(L.most_restrictive(F.col("d")).alias("w"))).w == "release"


def test_text_functions(spark):
    f = T.shape(F.lit("Seen at 0412Z by. Two CONTACTS; no dark."))
    r = one(spark.range(1).select(*[c.alias(k) for k, c in f.items()], T.detect_facts(F.lit("Vessel report: flag Panama. Unlit, small craft; flag changes")).alias("facts")))
    assert (r.char_len, r.word_count, r.sentence_count, r.has_timestamp) == (40.0, 8.0, 2.0, 1.0)
    assert r.facts == ["unlit_contact", "reflagging", "shoal_activity"]
    e = one(spark.range(1).select(T.shape(F.lit(""))["digit_ratio"].alias("d"), T.detect_facts(F.lit(None).cast("string")).alias("f")))
    assert e.d == 0.0 and e.f == []


def test_prompt(spark):
    shots = F.array(F.struct(F.array(F.lit("a")).alias("texts"), F.lit(True).alias("verdict")))
    assert one(spark.range(1).select(T.prompt(F.array(F.lit("x"), F.lit("y")), shots, "EX", "DO").alias("p"))).p == "EX\n\n--- CASE 1 ---\n[1] a\nOFFICER'S VERDICT: SIGNIFICANT\n\n\n--- NEW CASE ---\n\n[1] x\n\n[2] y\n\nDO"


def test_rates_and_ties(spark):
    t = spark.createDataFrame([("a", True)] * 3 + [("b", True), ("b", False), ("b", False), ("c", None)], "task string, outcome boolean")
    r = one(S.rates(t))
    assert r.single_run_rate == pytest.approx(4 / 6) and r.consensus_rate == pytest.approx(1 / 3)
    assert one(S.rates(t.where("task = 'none'"))).single_run_rate == 0.0
    assert one(S.rates(spark.createDataFrame([("a", True), ("a", False)], t.schema))).consensus_rate == 0.0
    s = one(S.cluster_bootstrap(t.where("task = 'a'"), 50))
    assert s.point == s.low == s.high == 1.0


def test_dispersion_is_nine(spark):
    v = spark.createDataFrame([(i, 3, 9 * (i % 2), 9) for i in range(40)], "task int, stratum int, votes int, seen int")
    r = one(S.dispersion(v))
    assert r["index"] == pytest.approx(9.0) and (r.strata, r.degenerate) == (1, 0)
    assert one(S.dispersion(v.limit(5)))["index"] is None
    null = S.dispersion_null(v, 40).agg(F.avg("index").alias("m")).first().m
    assert 0.7 < null < 1.3


def test_channel_test(spark):
    rows = spark.createDataFrame([(i, 3, i < 10, 0.0 if i < 10 else 1.0) for i in range(20)], "task int, stratum int, carries boolean, rate double")
    r = one(S.channel_test(rows, 1100))
    assert r.delta == -1.0 and r.detected and r.p == pytest.approx(1 / 1101)
    other = rows.withColumn("rate", 1 - F.col("rate"))
    assert not one(S.channel_test(other, 200)).detected
    assert one(S.stratified_delta(rows.withColumn("carries", F.lit(True)))).delta is None


def test_concerns(spark):
    t = lambda *x: one(spark.range(1).select(S.concerns(*map(F.lit, x)).alias("c"))).c
    assert t(0, 0, 0, 0, 0) == ["empty"]
    assert t(40, 10, 40, 10, 0) == []
    assert "over_escalation" in t(10, 30, 60, 0, 0) and "saturated" in t(50, 0, 50, 0, 0) and "unparsed" in t(20, 20, 20, 20, 20)
    assert S.rate_upper_bound(0, 60) == pytest.approx(1 - 0.05 ** (1 / 60), abs=1e-9)
    assert S.exact_wrong_majority(0.3, 9, 9) == pytest.approx(sum(math.comb(9, k) * 0.3**k * 0.7 ** (9 - k) for k in range(5, 10)))


CROWD = [(r, c, [1.0] * 6) for r in (0,) for c in range(12)] + [(0, 12 + c, [-1.5] * 6) for c in range(4)]


@pytest.mark.parametrize(("name", "args"), [("fed_median", ()), ("trimmed_mean", (4,)), ("krum", (4,)), ("multi_krum", (4, 8)), ("bulyan", (4,)), ("geometric_median", (5,))])
def test_robust_rules_withstand(spark, name, args):
    v = spark.createDataFrame(CROWD, "round int, client int, v array<double>")
    got = [r.value for r in V.STRATEGIES[name](v, *args).collect()]
    assert len(got) == 6 and all(abs(x - 1) < 0.1 for x in got)
    assert abs(one(V.fed_avg(v)).value - 1) > 0.4


def test_clip_and_noise(spark):
    r = one(spark.range(1).select(V.norm(V.clip(F.array(F.lit(3.0), F.lit(4.0)), 1.0)).alias("n"), V.clip(F.array(F.lit(0.1)), 1.0).alias("c")))
    assert r.n == pytest.approx(1.0) and r.c == [0.1]
    assert V.dp_sigma(2.0, 1e-5, 1.0) == pytest.approx(math.sqrt(2 * math.log(1.25e5)) / 2)


def test_secure_sum(spark):
    rows = [(0, [-1.5, 2.25, 0.0]), (1, [0.5, -0.25, 3.0]), (2, [1.0, 1.0, -3.0])]
    v = spark.createDataFrame(rows, "client int, v array<double>")
    got = {r.coord: (r.total, r.participants) for r in M.secure_sum(v, 3).collect()}
    assert got == {0: (0.0, 3), 1: (3.0, 3), 2: (0.0, 3)}
    assert M.secure_sum(v.limit(2), 3).count() == 0
    shares = {(r.client, r.coord): r.share for r in M.shares(v, 3, []).collect()}
    assert shares[0, 2] != 0  # a share alone tells nothing


def planted(spark, good, bad, tasks=40):
    return spark.createDataFrame([(t, w, (t % 2 == 0) != (w >= good)) for t in range(tasks) for w in range(good + bad)], "task int, who int, verdict boolean")


def test_dawid_skene(spark, tmp_path):
    v = planted(spark, 4, 1)
    truth = v.select("task", (F.col("task") % 2 == 0).alias("truth")).distinct()
    p, r, n, done = I.dawid_skene(v, folder=str(tmp_path / "ds"))
    assert done and n < 100
    rel = {x.who: x.reliability for x in I.reliability(r).collect()}
    assert rel[4] < 0.2 and min(rel[i] for i in range(4)) > 0.8
    assert one(I.agreement(I.labels_of(p), truth)).agreement == 1.0
    p2, *_ = I.dawid_skene(planted(spark, 2, 5), max_iters=3)
    assert one(I.agreement(I.labels_of(p2), truth)).agreement == 0.0  # a wrong majority is learned, as designed
    anchors = truth.where("task < 30").select("task", F.col("truth").alias("verdict"))
    p3, *_ = I.dawid_skene(planted(spark, 2, 5), max_iters=3, anchors=anchors)
    assert one(I.agreement(I.labels_of(p3), truth)).agreement == 1.0


@pytest.mark.parametrize("fit", [I.fit_glad, I.fit_rasch])
def test_difficulty(spark, fit):
    v = planted(spark, 4, 1, 20).withColumn("fleet", F.lit(1))
    got = I.with_difficulty(v, fit, "fleet", 30).collect()
    assert all((r.value >= 0.5) == (r.id % 2 == 0) for r in got if r.kind == "task")
    ability = {r.id: r.value for r in got if r.kind == "who"}
    assert ability[4] < min(ability[i] for i in range(4))


def test_kappa_and_review(spark):
    rated = spark.createDataFrame([(i, w, "a" if (i + w // 2) % 2 else "b") for i in range(6) for w in range(3)] + [(9, 0, "a")], "i int, w int, c string")
    r = one(R.fleiss_kappa(rated, "i", "c"))
    assert (r.n_items, r.n_raters) == (6, 3)
    same = one(R.fleiss_kappa(rated.withColumn("c", F.lit("a")), "i", "c"))
    assert same.kappa == 0.0
    assert one(R.fleiss_kappa(rated.limit(0), "i", "c")).n_items == 0
    t = spark.createDataFrame([(1, 3, 3, 0, 1, True, 0, 1), (2, 3, 3, 0, 2, True, 0, 2), (3, 1, 1, 0, 0, True, 0, 0), (4, 1, 1, 0, 0, None, 0, 0)], "task int, evidence int, seen_evidence int, sens int, mask int, p_verdict boolean, p_sens int, p_mask int")
    got = {r.task: r.action for r in R.review(t, [R.Reviewer("x")]).collect()}
    assert got == {1: "accept", 2: "escalate", 3: "revise"}


def test_policies_nest_and_refuse(spark):
    v = spark.createDataFrame([(f"{i:02d}", float(i % 5), 4.0, 0.1 * (i % 9), i % 3, i % 2 == 0, True, i % 4 == 0) for i in range(20)], "task string, votes double, seen double, posterior double, evidence int, carries boolean, truth boolean, label boolean")
    for name in G.POLICIES:
        five, ten = ({r.task for r in G.select(v, name, k).collect()} for k in (5, 10))
        assert len(five) == 5 and five < ten
    with pytest.raises(ValueError):
        G.select(v, "margin", 21)
    rows = spark.createDataFrame([(5,), (None,), (9,), (7,)], "b int")
    r = one(G.lower_median(rows, "b"))
    assert (r.median, r.low, r.high, r.censored) == (7, 5, 9, 1)


def test_corpus_is_a_prefix_and_tells_its_facts(spark, tmp_path):
    small, large = C.generate(spark, C.CorpusConfig(3, 20)), C.generate(spark, C.CorpusConfig(3, 40))
    assert small.columns == C.FIELDS and small.count() == 60
    assert small.exceptAll(large).count() == 0
    facts = large.groupBy("event_id", "is_plant").agg(F.array_distinct(F.flatten(F.collect_list("fact_ids"))).alias("f")).collect()
    assert all((set(T.PATTERN) <= set(r.f)) == r.is_plant and len(r.f) == 5 for r in facts)
    made = one(C.write_jsonl(small, str(tmp_path / "c")))
    back = C.read_jsonl(spark, str(tmp_path / "c"), small.schema)
    assert made.n_rows == 60 and one(C.digest(back)).digest == made.digest == one(C.digest(small.repartition(3))).digest
    assert '"cr:RecordSet"' in C.croissant(small, C.CorpusConfig(3, 20))
    with pytest.raises(ValueError):
        C.CorpusConfig(n_events=0)


def test_stream_of_votes(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"2024-01-0{1 + i % 3} 10:00:00", i % 5, rng.random() < 0.5, i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "ts string, task int, verdict boolean, analyst int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("running", streaming.running_votes(stream), "complete"), ("rates", streaming.windowed_rates(stream), "complete")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(spark.table("running").collect()) == sorted(streaming.running_votes(df).collect())
    assert spark.table("rates").agg(F.sum("seen")).first()[0] == 60
