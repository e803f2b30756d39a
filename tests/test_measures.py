"""Edges of the measures that the queries' tables don't reach."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import measures as M


def test_labels_from_json(spark):
    rows = [("{}",), ('{"sensitivity":"PROTECTED","compartments":["PARTNER","SENSOR","SENSOR"],"capacity":"ENUM"}',), ('{"sensitivity":"SECRET"}',), ('{"compartments":["X"]}',), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "p string").select(M.parse_label(F.col("p")).alias("x")).collect()]
    assert [None if x is None else tuple(x) for x in got[:4]] == [(0, 0, 3), (2, 9, 0), None, None]


def test_rises_and_draws(spark):
    rows = [([1.0, 1.0, 2.0], 0.5, [0.6, 0.9]), ([1.0, 1.0], 0.6, [0.6]), ([3.0, 1.0, 4.0], None, [1.0]), ([1.0], 0.1, [])]
    got = spark.createDataFrame(rows, "v array<double>, t double, d array<double>").select(M.monotone(F.col("v")), M.beats_every_draw(F.col("t"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (False, False)]


def test_bounds(spark):
    assert spark.range(3).select(M.bounded(F.col("id"), 0, 2, "id")).count() == 3
    with pytest.raises(Exception, match="id must be from 0 to 1"):
        spark.range(3).select(M.bounded(F.col("id"), 0, 1, "id").alias("x")).collect()


def test_no_rows(spark):
    none = spark.createDataFrame([], "task int, evidence int, seen_evidence int, carries boolean, truth boolean")
    assert tuple(M.class_balance(none, "truth").first()) == (0, 0, 0.0, 0.0)
    assert tuple(M.channel_check(none, 2).first()) == (0, 0.0, 0.0, False)
    low = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "r double").select(M.understatement(F.col("r"), 3).alias("x")).collect()
    assert [r.x for r in low] == [None, 1.6, 1.0]
    assert M.review_sweep(none, [1], [0.0], [1]).count() == 0


def test_channels_are_refused(spark):
    rows = [(1, 2, 1, True), (2, 2, 2, False), (3, 1, 1, False)]
    tasks = spark.createDataFrame(rows, "task int, evidence int, seen_evidence int, carries boolean")
    assert M.assert_channel_usable(tasks, 2).first().affected == 1
    with pytest.raises(M.ChannelUnusable, match="no verdict"):
        M.assert_channel_usable(tasks.withColumn("seen_evidence", F.col("evidence")), 2)
    with pytest.raises(M.ChannelUnusable, match="2.00 on tasks"):
        M.assert_channel_usable(tasks, 2, slack=0.1)


def test_examples(spark):
    from tidemark.operators import examples as X

    reports = spark.createDataFrame([(2, 1, ["a"], "two"), (1, 1, ["b", "c"], "one"), (3, 2, ["a", "b", "a"], None)], "report_id int, event_id int, fact_ids array<string>, text string")
    targets = X.world_targets(reports, ["a", "b", "c"])
    assert {r.task: r.target for r in targets.collect()} == {1: True, 2: False}
    got = {r.task: (r.prompt, r.completion) for r in X.build(reports, targets, "p", "say").collect()}
    assert got == {1: ("[1] one\n\n[2] two\n\nsay", "SIGNIFICANT"), 2: ("[1] \n\nsay", "ROUTINE")}
    tasks = spark.range(4000).select(F.col("id").alias("task"), (F.col("id") % 4).cast("int").alias("evidence"))
    for name, k, slip in (("t2s0", 2, 0.0), ("t3s0.25", 3, 0.25)):
        t = X.Teacher.named(name)
        wrong = X.review_targets(tasks, t).join(tasks, "task").agg(F.avg((F.col("target") != (F.col("evidence") >= k)).cast("double"))).first()[0]
        assert (t.threshold, t.slip) == (k, slip) and abs(wrong - slip) < 0.03
    for bad in ("t4s0", "t2", "t2s1", "careful"):
        with pytest.raises(ValueError):
            X.Teacher.named(bad)
