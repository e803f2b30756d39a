"""Operators that run side by side in one session leave each other's tables alone."""

import threading

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import mixing, shared, toxicity  # noqa: E402


def test_a_scope_deletes_its_own_alone(spark):
    other = shared.staged(spark.range(5), "other")
    with shared.scope() as outer:
        one = shared.staged(spark.range(3), "one")
        with shared.scope() as inner:
            shared.staged(spark.range(4), "two")
            three = shared.staged(spark.range(6), "three")
            inner.clean(spark, ("/three-",))
        assert len(inner.folders) == 1 and len(outer.folders) == 2
        assert (other.count(), one.count(), three.count()) == (5, 3, 6)
        outer.clean(spark)
    assert other.count() == 5
    with pytest.raises(Exception, match="(?i)not_exist|no such file|does not exist|PATH_NOT_FOUND"):
        one.agg(F.sum("id")).collect()


def test_two_threads_in_one_session(spark):
    docs = spark.createDataFrame([(i, f"text{i} word{i % 7} and {'idiot' if i % 3 == 0 else 'friend'} " * 5, f"s{i % 4}") for i in range(120)], "doc_id int, text string, source string").cache()
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    want, failed = sorted(map(tuple, mixing.mix(docs).collect()), key=str), []

    def learns():
        try:
            for _ in range(3):
                assert toxicity.learn(docs, labels).score(["you idiot"])[0] > 0.5
        except BaseException as e:
            failed.append(e)

    def mixes():
        try:
            for _ in range(3):
                assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == want
        except BaseException as e:
            failed.append(e)

    threads = [threading.Thread(target=f) for f in (learns, mixes, mixes)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, failed[0]


def test_quality_replaces_columns_named_like_results(spark):
    from tidemark.llm import quality

    docs = spark.createDataFrame([(i, f"some words of text {i} " * 10, "en", 5.0, True, 1) for i in range(5)], "doc_id int, text string, lang string, symbol_share double, kept boolean, n_words int")
    got = quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality")), keep=["doc_id", "lang", "symbol_share", "kept", "n_words"])
    assert len(set(got.columns)) == len(got.columns) and {(r.symbol_share, r.n_words) for r in got.collect()} == {(0.0, 50)}


@pytest.mark.parametrize("hot", [1, 10**9])
def test_large_buckets_are_dealt_to_parts(spark, monkeypatch, hot):
    """The same classes whether buckets are dealt to parts or not; a chain of near copies and a large group of them."""
    import random

    from tidemark.llm import nearcopies

    monkeypatch.setattr(nearcopies, "HOT", hot)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(400):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(t)
    texts += [[f"y{i}" for i in range(k, k + 60)] for k in range(0, 30, 3)] + [[f"z{rng.random()}" for _ in range(40)] for _ in range(40)]
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nearcopies.groups(df, size=4, threshold=0.8).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
