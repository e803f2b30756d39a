"""Scenarios, nested documents, sweeps and attribution on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution as B
from tidemark.operators import gate as X
from tidemark.operators import sweeps as W
from tidemark.sources import artifacts as D

SCENARIO = {
    "scenario": {"name": "small", "voices": ["PLAIN"]},
    "patterns": {"significant": ["a", "b"], "decoys": [["a", "c"]]},
    "channels": [{"id": "x", "sensitivity": "OPEN", "compartments": []}, {"id": "y", "sensitivity": "INTERNAL", "compartments": ["SENSOR"]}],
    "facts": [{"id": i, "channels": ["x", "y"], "renderings": ["{vessel} at {time}"]} for i in "abc"],
}


def test_scenario(spark):
    assert D.validate(json.loads(json.dumps(SCENARIO))) == SCENARIO
    assert D.dimensions(spark, SCENARIO)["facts"].where("significant").count() == 2
    breaks = [
        lambda s: s["patterns"].update(decoys=[["a", "b"]]), lambda s: s["patterns"].update(significant=["z"]), lambda s: s["facts"][0].update(channels=[]), lambda s: s["facts"][0].update(renderings=["{vessel.__class__}"]),
        lambda s: s["facts"][0].update(renderings=["{vessel!r}"]), lambda s: s["facts"][0].update(renderings=["{other}"]), lambda s: s["facts"][0].update(renderings=[]), lambda s: s["channels"][1].update(sensitivity="OPEN", compartments=[]),
        lambda s: s["channels"].append({"id": "q", "sensitivity": "OPEN", "compartments": []}), lambda s: s["scenario"].update(voices=[]), lambda s: s["facts"].append(s["facts"][0]),
    ]
    for change in breaks:
        s = json.loads(json.dumps(SCENARIO))
        change(s)
        with pytest.raises(D.ScenarioError):
            D.validate(s)


def test_dig(spark):
    doc = json.dumps({"a": {"b": [{"k": "x", "v": 1}, {"k": "y", "v": [1, 2]}]}, "n": None})
    one = spark.range(1).select(*[D.dig(F.lit(doc), p).alias(f"c{i}") for i, p in enumerate(["a.b.0.v", "a.b.k=y.v.-1", "a.b.k=z.v", "a.b.-3", "z.q", "n"])]).first()
    assert list(one) == ["1", "2", None, None, None, None]


def test_ledger_digest_repeats(spark, tmp_path):
    r = spark.createDataFrame([(1, "x", "accept", [], [], True)], "task int, analyst string, action string, grounds array<string>, reasons array<string>, corrected_verdict boolean")
    a, b = D.ledger(r, 7, "t").first().digest, D.ledger(r, 7, "t").first().digest
    assert a == b != D.ledger(r, 7, "u").first().digest
    D.append_ledger(D.ledger(r, 7, "t"), str(tmp_path / "l"))
    D.append_ledger(D.ledger(r, 7, "t"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_ladder_and_cliff(spark):
    assert W.ladder(9) == [0, 3, 5, 7, 8, 9] and W.majority(9) == 5
    t = spark.createDataFrame([(i, 2 + i % 2, 2) for i in range(20)], "task int, evidence int, seen_evidence int")
    cells = W.consensus_by_wrong(W.fleet_votes(t, 9, list(range(10))))
    assert W.cliff(cells).first().asDict() == {"highest_safe": 4, "lowest_broken": 5}
    s = spark.createDataFrame([(1, "a"), (1, None), (2, None), (2, None)], "task int, answer string")
    assert W.decode_stability(s).first().asDict() == {"tasks": 2, "differing": 1, "unparsed": 3}


def test_attribution(spark):
    s = spark.createDataFrame([(1, 0, 1, 1, ["p"], ["p"]), (1, 1, 3, 2, ["q"], ["p"]), (2, 0, 0, 0, ["q"], ["p"])], "task int, pos int, sens int, mask int, fact_ids array<string>, asserted array<string>")
    got = {r.task: tuple(r)[1:] for r in B.score(s, F.col("pos") == 1).collect()}
    assert got == {1: (0.0, 0.0, False, "incomparable"), 2: (1.0, 1.0, True, "exact")}
    whole = {r.task: r.outcome for r in B.score(s, F.lit(True)).collect()}
    assert whole == {1: "creep", 2: "exact"}
    assert {r.outcome for r in B.score(s, F.lit(False)).collect()} == {"leak", "exact"}
    t = spark.createDataFrame([(1, ["unlit hull", "a pilot", "pilot"])], "task int, texts array<string>")
    assert [(r.pos, r.lost) for r in B.leave_one_out(t, lambda x: x).orderBy("pos").collect()] == [(0, ["unlit_contact"]), (1, []), (2, [])]


def test_probes_find_a_leak(spark):
    rows = spark.createDataFrame([(f"c{i % 3}", i % 2 == 0, float(i % 2) + (i % 7) * 0.2, float(i % 5)) for i in range(120)], "center string, positive boolean, x double, y double")
    v = X.verdict(X.probes(rows, ["x", "y"], 3)).first()
    assert abs(v.auc - 0.5) > 0.3 and v.folds == 3 and not v.passed
    assert X.probes(rows.where("center = 'c0'"), ["x", "y"]).count() == 0
    assert X.usable(2, True, 0.7) and not X.usable(2, False, 0.7) and not X.usable(1, True, 0.5)
