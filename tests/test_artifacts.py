"""Slices, prefixes, claims, artifact grids, ledgers and proposals on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import prefixes as P
from tidemark.operators import slices as Z
from tidemark.operators import sweeps as W
from tidemark.scratch import Scratch
from tidemark.sources import artifacts as D
from tidemark.sources import claims as C
from tidemark.sources import grids as G
from tidemark.sources import ledgers as E
from tidemark.sources import proposals as Q

PATTERN = ["a", "b", "c"]


def reports(spark, n=60, skewed=False, shared=False):
    rng = random.Random(3)
    rows = []
    for t in range(n):
        for i, f in enumerate(PATTERN if t % 3 else PATTERN[:2]):
            mask = 8 if skewed and t % 3 == 1 else rng.choice([0, 1, 2, 4])
            rows.append((0 if shared and i == 0 else 10 * t + i, t, [f, "x"], mask))
            if i == 1:
                rows.append((10 * t + 7, t, [f], 0))  # a fact that two reports tell
    return spark.createDataFrame(rows, "report_id int, event_id int, fact_ids array<string>, mask int"), rows


def test_a_slice_flips_what_it_drew(spark):
    df, rows = reports(spark)
    s = Z.balanced_slice(df, PATTERN, 6, null_draws=300)
    tasks = {r.task: r.fact for r in s.tasks.collect()}
    gone = {r.report_id for r in s.distrusted.collect()}
    assert len(tasks) == 6 and s.eligible == 40 and all(t % 3 for t in tasks) and s.percentile <= 0.99
    assert gone == {r[0] for r in rows if tasks.get(r[1]) in r[2]}
    seen = lambda t, out: len({f for r in rows if r[1] == t and r[0] not in out for f in r[2]} & set(PATTERN))
    assert {t for t in range(60) if seen(t, set()) >= 3 > seen(t, gone)} == set(tasks)
    again = Z.balanced_slice(df.repartition(5), PATTERN, 6, null_draws=300)
    assert {r.task for r in again.tasks.collect()} == set(tasks) and (again.rejected, again.worst_gap) == (s.rejected, s.worst_gap)
    # Who distrusts the reports votes false on the slice and as all others elsewhere.
    told = Z.shown(df, PATTERN).select("task", F.size("shown").alias("evidence"))
    votes = W.fleet_votes(Z.without_slice(told, s), 3, [3], blind=True).where("NOT verdict").select("task").distinct()
    assert {r.task for r in votes.collect()} == set(tasks) | {t for t in range(60) if t % 3 == 0}


def test_slices_are_refused(spark):
    df, _ = reports(spark)
    with pytest.raises(Z.SliceUnusable, match="there are 40") as e:
        Z.balanced_slice(df, PATTERN, 41)
    assert e.value.structural
    with pytest.raises(Z.SliceUnusable, match="no balanced slice") as e:
        Z.balanced_slice(df, PATTERN, 6, attempts=4, null_draws=50, quantile=-1.0)
    assert not e.value.structural
    with pytest.raises(Z.SliceUnusable, match="is to|was to flip"):
        Z.balanced_slice(reports(spark, shared=True)[0], PATTERN, 30, attempts=1)  # one report id in all tasks
    # Only some draws avoid the channel that two of four tasks carry: refusals are counted.
    some = [Z.balanced_slice(reports(spark, skewed=True)[0], PATTERN, 4, seed=s, null_draws=200, quantile=0.2).rejected for s in (1, 2)]
    assert max(some) > 0


def test_prefixes_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(3 * i + 2, rng.choice([0, 0, 1, 3]), rng.choice([0, 0, 0, 1, 2, 4]) if i < 60 else rng.choice([0, 1, 8])) for i in range(90)]
    df = spark.createDataFrame(rows, "task int, sens int, mask int").repartition(3)
    ruling = L.Ruling(capacities=())  # labels stay as they are
    sizes = [1, 3, 10, 40, 70, 90, 200]
    got = {r.size: tuple(r)[1:5] for r in P.structures(df, sizes, ruling).collect()}
    for n in sizes[:-1]:
        here = {(s, m) for _, s, m in rows[:n]}
        sets = {}
        for cs in range(4):
            for cm in range(16):
                sets.setdefault(frozenset(x for x in here if x[0] <= cs and not x[1] & ~cm), set()).add(cm)
        assert got[n] == (len(here), len(sets), sum(len(v) == 1 for v in sets.values()), max(map(len, sets.values()))), n
    assert set(got) == set(sizes[:-1])
    settled = {r.size: r.settled for r in P.saturates(P.structures(df, sizes, ruling)).collect()}
    first = min(n for n, ok in settled.items() if ok)
    assert not settled[1] and all(got[n] == got[90] for n in got if n >= first) and got[max(n for n in got if n < first)] != got[90]


# --- claims

BODY = {"a": {"b": [{"k": "x", "v": 1}, {"k": "y", "v": [1, 2.5]}, {"k": "x", "v": 9}]}, "n": None, "t": True, "s": "1e3", "deep": [[{"z": {"w": "end"}}]]}


def test_readings_follow_paths(spark):
    paths = {"a.b.0.v": "1", "a.b.k=y.v.-1": "2.5", "a.b.k=x.v": "1", "a.b.-1.v": "9", "a.b.k=z.v": None, "a.b.-4": None, "a.b.3": None, "n": None, "n.x": None, "t": "true", "s": "1e3", "deep.0.-1.z.w": "end", "a.b.1.v": "[1,2.5]", "a.x": None, "0": None}
    claims = spark.createDataFrame([(f"c{i % 4}", C.VERDICTS[i % 4 % 3], p, p, None) for i, p in enumerate(paths)] + [("f", "open", "as percent", "a.b.0.v", "%.1f%%"), ("f", "open", "no number", "t", "%.1f")], C.CLAIM)
    docs = spark.createDataFrame([(1, json.dumps(BODY)), (2, "{broken"), (3, None), (4, "[]"), (5, '[{"a": 1}]')], "doc int, body string")
    read = C.readings(claims, docs, Scratch(spark, "test-claims")).cache()
    got = {(r.doc, r.label): r.value for r in read.collect()}
    assert {p: got[1, p] for p in paths} == paths and got[1, "as percent"] == "1.0%" and got[1, "no number"] == "true"
    assert len(got) == 5 * 17 and all(v is None for (d, p), v in got.items() if d in (2, 3, 4))
    assert got[5, "0"] == '{"a":1}'
    for path, want in paths.items():  # the same as looking each path up by itself
        alone = spark.range(1).select(D.dig(F.lit(json.dumps(BODY)), path).alias("v")).first().v
        assert alone == want or path in ("n", "n.x", "0"), path
    claimed = C.payloads(read)
    one = {r.claim: r.measured for r in claimed.where("doc = 1").collect()}
    assert one == {c: all(v is not None for i, v in enumerate(paths.values()) if i % 4 == int(c[1])) for c in ("c0", "c1", "c2", "c3")} | {"f": True}
    total = {r.doc: r for r in C.argument(claimed).collect()}
    assert (total[1].closes, total[1].bounded, total[1].open) == (2, 1, 2) and total[2].unmeasured == ["c0", "c1", "c2", "c3", "f"]
    assert C.readings(claims, docs.limit(0), Scratch(spark, "test-claims")).count() == 0


# --- artifacts


def artifact(threshold, slip, accuracy, **more):
    out = {"teacher": {"reviewer": "r", "escalation_threshold": threshold, "slip_rate": slip, "train_target_agreement": 0.9}, "adapter": {"accuracy": accuracy, "recall": 0.5, "unparsed": 1}, "adapter_vs_teacher": {"accuracy": 1 - slip}, "hyperparameters": {"rank": 8}, "data": {"n_train": 1, "n_eval": 2, "eval_seed": 3, "cross_corpus": False}}
    for k, v in more.items():
        out[k].update(v)
    return json.dumps(out, indent=1)


def test_grid_and_twins(spark, tmp_path):
    files = {
        "review_adapter-t1s0.0": artifact(1, 0.0, 0.8), "review_adapter-t2s0.15": artifact(2, 0.15, 0.7, adapter_vs_teacher={"accuracy": 0.8}), "review_adapter-t3s0.5": "{no json", "review_adapter-careful": artifact(1, 0.0, 0.75),
        "review_adapter-other": artifact(2, 0.15, 0.7, hyperparameters={"rank": 4}, teacher={"slip_rate": 0.3}), "notes": "text",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    found = G.artifacts(spark, str(tmp_path), "*.json").cache()
    rows = {r.artifact: r for r in G.grid(found).collect()}
    assert set(rows) == {"review_adapter-t1s0.0", "review_adapter-t2s0.15"}
    r = rows["review_adapter-t2s0.15"]
    assert (r.threshold, r.slip_rate, r.adapter_agrees_with_world, r.adapter_recall, r.adapter_unparsed, r.quotable) == (2, 0.15, 0.7, 0.5, 1, None)
    c = G.ceilings(G.grid(found)).first()
    assert (c.n, c.residual_min, c.residual_max, c.exceeding) == (2, -0.05, 0.0, 1)
    assert {r.threshold: r.n for r in G.ceilings(G.grid(found), ["threshold"]).collect()} == {1: 1, 2: 1}
    pairs = spark.createDataFrame([("review_adapter-careful", "review_adapter-t1s0.0"), ("review_adapter-other", "review_adapter-t2s0.15"), ("review_adapter-gone", "review_adapter-t1s0.0")], "named string, grid string")
    t = {r.named: r for r in G.twins(found, pairs).collect()}
    assert set(t) == {"review_adapter-careful", "review_adapter-other"}
    assert t["review_adapter-other"].mismatches == ["hyperparameters", "teacher.slip_rate"] and t["review_adapter-careful"].mismatches == []
    (b,) = G.bound(G.twins(found, pairs)).collect()
    assert (b.targets_identical, b.n_pairs, b.max, b.median, b.exactly_identical) == (True, 1, 0.05, 0.025, 0)


# --- ledgers


def records(spark, rows):
    return spark.createDataFrame([(i, d, f"act{i}") for i, d in rows], "record_id string, digest string, action string")


def test_ledger_takes_each_record_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = records(spark, [("a", "1"), ("b", "2"), ("b", "2")])
    assert E.read(spark, path, first.schema).count() == 0
    assert E.append(first, path, 0) and not E.append(first, path, 0)
    assert E.append(records(spark, [("b", "2"), ("c", "3")]), path, 1)
    rows = sorted((r.record_id, r.batch) for r in E.read(spark, path, first.schema).collect())
    assert rows == [("a", 0), ("b", 0), ("c", 1)]
    for bad in ([("a", "9")], [("d", "1"), ("d", "2")], [(None, "1")]):
        with pytest.raises(E.LedgerConflict):
            E.append(records(spark, bad), path, 2)
    assert E.batches(spark, path) == [0, 1] and E.append(first.limit(0), path, 2)
    lines = [json.loads(r.value) for r in E.export_lines(E.read(spark, path, first.schema)).collect()]
    assert sorted(x["record_id"] for x in lines) == ["a", "b", "c"] and set(lines[0]) == {"record_id", "digest", "action"}


def test_a_replayed_stream_adds_nothing(spark, tmp_path):
    path, source = str(tmp_path / "ledger"), str(tmp_path / "in")
    schema = records(spark, [("a", "1")]).schema
    records(spark, [(f"r{i}", str(i)) for i in range(20)]).repartition(2).write.parquet(source)

    def run(place, sink):
        q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / place)).trigger(availableNow=True).start()
        q.awaitTermination()

    done = []

    def dies(df, batch):  # written, but the stream never learns of it
        E.sink(path)(df, batch)
        done.append(batch)
        if batch == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run("one", dies)
    assert E.read(spark, path, schema).count() == 20
    run("one", E.sink(path))
    run("two", E.sink(path))  # a new checkpoint begins again with batch 0
    held = E.read(spark, path, schema)
    assert held.count() == 20 == held.select("record_id").distinct().count() and done == [0, 1]


# --- proposals


def test_proposals_are_checked_in_one_pass(spark):
    tasks = spark.createDataFrame([(i, i % 2 == 0, 2, 5) for i in range(6)], "task int, truth boolean, sens int, mask int")
    rows = [(0, 0, True, True), (0, 1, True, False), (1, 0, False, True), (2, 0, False, True), (3, 0, False, None), (4, 0, None, True), (9, 0, True, True), (None, 0, True, True), (1, 1, False, None), (5, 0, False, True), (5, 0, False, True)]
    df = spark.createDataFrame(rows, "task int, seq int, truth boolean, verdict boolean").repartition(3)
    taken, left, counts = Q.load(df, tasks, Scratch(spark, "test-proposals"), strict=False)
    assert sorted((r.task, r.verdict, r.release.sens, r.release.mask) for r in taken.collect()) == [(0, False, 0, 5), (1, True, 0, 5), (5, True, 0, 5)]
    assert counts == {"rows": 11, "taken": 3, "unknown_task": 2, "truth_differs": 2, "unparsed": 2, "superseded": 2}
    assert sorted((r.reason, str(r.task)) for r in left.collect()) == [("superseded", "0"), ("superseded", "5"), ("truth_differs", "2"), ("truth_differs", "4"), ("unknown_task", "9"), ("unknown_task", "None"), ("unparsed", "1"), ("unparsed", "3")]
    with pytest.raises(Q.ArtifactMismatch, match="truth_differs"):
        Q.load(df, tasks, Scratch(spark, "test-proposals"))
    sound = df.where("task IN (0, 1, 3)")
    assert Q.load(sound, tasks, Scratch(spark, "test-proposals"))[0].count() == 2
    assert Q.load(df.limit(0), tasks, Scratch(spark, "test-proposals"))[2]["rows"] == 0


# --- cases, scenarios, metadata

CASES = {
    "ceilings": {"fleet": {"sensitivity": "INTERNAL", "compartments": ["SENSOR"], "capacity": "FREETEXT"}, "open": {"sensitivity": "OPEN", "compartments": [], "capacity": "FREETEXT"}},
    "policies": {
        "keep": {"declassifiable": ["ENUM", "SCALAR"], "release_floor": "OPEN", "drop_compartments": False, "prohibited": []},
        "veto": {"declassifiable": ["ENUM"], "release_floor": "OPEN", "drop_compartments": True, "prohibited": [{"compartment": "LEGAL", "purpose": "training"}]},
    },
    "cases": [
        {"id": i, "label": {"sensitivity": s, "compartments": c, "capacity": k}, "ceiling": top, "policy": p, "purpose": "training", "expected_disposition": d, "expected_reason": r, "verified": True}
        for i, s, c, k, top, p, d, r in [
            ("a", "PROTECTED", ["SENSOR"], "ENUM", "fleet", "keep", "release", "RELEASABLE"), ("b", "PROTECTED", ["LEGAL", "SENSOR"], "ENUM", "fleet", "keep", "approval", "COMPARTMENT_NOT_HELD"),
            ("c", "PROTECTED", ["LEGAL"], "ENUM", "open", "veto", "withhold", "PURPOSE_PROHIBITED"), ("d", "PROTECTED", [], "FREETEXT", "open", "keep", "withhold", "CAPACITY_NOT_DECLASSIFIABLE"), ("e", "OPEN", [], "ENUM", "open", "keep", "withhold", "RELEASABLE"),
        ]
    ],
}


def test_cases_are_run_as_written(spark, tmp_path):
    from tidemark.sources import cases as K

    def told(change=lambda c: None):
        own = json.loads(json.dumps(CASES))
        change(own)
        (tmp_path / "cases.json").write_text(json.dumps(own, indent=1))
        return K.run(K.load(spark, str(tmp_path / "cases.json")))

    got = {r.id: r for r in told().collect()}
    assert {i: r.passed for i, r in got.items()} == {"a": True, "b": True, "c": True, "d": True, "e": False} and got["e"].disposition == "release"
    with pytest.raises(Exception, match="no level: SECRET"):
        told(lambda c: c["cases"][0]["label"].update(sensitivity="SECRET")).collect()
    with pytest.raises(K.CaseError, match="no such"):
        told(lambda c: c["cases"][0].update(policy="none"))
    with pytest.raises(K.CaseError, match="policy keep"):
        told(lambda c: c["policies"]["keep"].update(release_floor="LOW"))
    assert told(lambda c: c.update(cases=[])).count() == 0


def test_metadata_names_the_files(spark, tmp_path):
    import hashlib

    from tidemark.sources import corpus as O

    config = O.CorpusConfig(3, 20)
    rows, folder = O.generate(spark, config), tmp_path / "corpus"
    O.write_jsonl(rows, str(folder))
    told = json.loads(O.croissant(rows, config, folder=str(folder), baseline=0.61, null_mean=0.5))
    listed = {f["@id"]: f for f in told["distribution"] if f["@type"] == "cr:FileObject"}
    there = {p.name: p.read_bytes() for p in folder.glob("part-*")}
    assert {k: f["sha256"] for k, f in listed.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in there.items()} and all(f["contentUrl"] and f["contentSize"] for f in listed.values())
    assert "0.6100" in told["rai:dataAnnotationAnalysis"] and "0.5000" in told["rai:dataAnnotationAnalysis"]
    (tmp_path / "b.toml").write_text("")
    (tmp_path / "a.toml").write_text("")
    assert D.available(str(tmp_path)) == ["a", "b"]
