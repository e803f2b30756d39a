import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, lm  # noqa: E402
from tidemark.llm.queries import RANKS  # noqa: E402

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def ids_of(text):
    c = bpe.load(PATH, PATTERN)
    return [i for w in lm.split_words(text) for i in c.encode(" " + w.decode())] + [len(c.table)]


def invented(n, seed):
    """Texts of invented words in which each word has few successors."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "sha"], rng.integers(1, 4))) for _ in range(80)]
    after = np.random.default_rng(1).integers(0, 80, (80, 3))
    out = []
    for _ in range(n):
        at, text = int(rng.integers(80)), []
        for _ in range(60):
            text.append(words[at])
            at = int(after[at, rng.integers(3)])
        out.append(" ".join(text))
    return out


def test_every_training_document_counts(spark, monkeypatch):
    rows = [(i, f"alpha Beta{i} gamma\n" * (1 + i % 4)) for i in range(60)] + [(60, None), (61, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    learnt = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    want = np.bincount(np.concatenate([ids_of(t) for t in learnt]), minlength=len(bpe.load(PATH, PATTERN).table) + 1)
    found, classes = [], lm.classes
    monkeypatch.setattr(lm, "classes", lambda n: found.append(n.copy()) or classes(n))
    assert lm.score(df, PATH, PATTERN).count() == len(rows)
    assert (found[0] == want).all()


def test_scores_do_not_depend_on_partitions_and_beat_the_unigram(spark):
    texts = invented(300, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    one = {r.doc_id: r for r in lm.score(df.coalesce(1), PATH, PATTERN, shard=20_000).collect()}
    six = {r.doc_id: r for r in lm.score(df.orderBy(F.desc("doc_id")).repartition(6), PATH, PATTERN, shard=20_000).collect()}
    assert all(one[i].score == pytest.approx(six[i].score, rel=1e-5) and one[i].base_score == pytest.approx(six[i].base_score, rel=1e-9) for i in one)
    train = [ids_of(t) for i, t in enumerate(texts) if not one[i].held_out]
    counts = Counter(x for t in train for x in t)
    n = sum(counts.values())
    unigram = sum(np.log10((counts[x] + 0.5) / (n + 25_000)) for i, t in enumerate(texts) if one[i].held_out for x in ids_of(t))
    generous = sum(np.log10((counts[x] + 0.5) / n) for i, t in enumerate(texts) if one[i].held_out for x in ids_of(t))
    scored = sum(r.score for r in one.values() if r.held_out)
    assert sum(r.held_out for r in one.values()) > 10 and scored > generous > unigram


def test_attention_equals_a_loop():
    rng = np.random.default_rng(2)
    flat = lm.initial() + rng.standard_normal(len(lm.initial())).astype(np.float32) * 0.3
    p, table = lm.unpack(flat), rng.standard_normal((lm.INPUTS, lm.OUTPUTS)).astype(np.float32)
    known = lm.classes(np.arange(90.0))
    docs = [rng.integers(0, 90, k) for k in (1, 16, 17, 70)]
    got = lm.log10_probability(docs, lm.Scorer(p, table, 3), known)
    for doc, g in zip(docs, got, strict=True):
        x = [lm.START, *known["in"][doc[:-1]]]
        total = known["share"][doc].sum()
        for t, c in enumerate(known["out"][doc]):
            low = max(0, (t // lm.BLOCK - 1) * lm.BLOCK)
            q, k, v = np.split(p["emb"][x[: t + 1]] @ p["qkv"], 3, axis=1)
            s = np.array([q[t] @ k[j] / lm.DIM**0.5 + p["rel"][t - j] for j in range(low, t + 1)])
            w = np.exp(s - s.max())
            z = table[x[t]] + p["bias"] + (w / w.sum()) @ v[low : t + 1] @ p["out"]
            total += (z[c] - z.max() - np.log(np.exp(z - z.max()).sum())) / np.log(10)
        assert g == pytest.approx(total, rel=1e-4)


def test_large_logits_are_not_cut():
    flat = lm.initial()
    p, table = lm.unpack(flat), np.zeros((lm.INPUTS, lm.OUTPUTS), np.float32)
    table[:, 0], table[:, 1] = 200, 190
    known = lm.classes(np.arange(90.0)[::-1].copy())
    got = lm.log10_probability([np.array([1])], lm.Scorer(p, table), known)[0] - known["share"][1]
    assert got == pytest.approx(-10 / np.log(10), rel=1e-3)


def test_few_texts_are_coded_together(monkeypatch):
    texts = [f"alpha beta{i} gamma" for i in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([True] * 9), pa.array(texts)], ["doc_id", "learned", "text"])

    def groups():
        rows = [r for b in lm._code(PATH, PATTERN)(iter([batch])) for r in b.to_pylist() if r["learned"] is None]
        return len(rows), sum((Counter(dict(zip(r["words"], r["times"], strict=True))) for r in rows), Counter())

    monkeypatch.setattr(lm, "TEXTS", 40)
    few = groups()
    monkeypatch.undo()
    assert few[0] > 3 and groups() == (1, few[1]) and lm.TEXTS <= 2_000_000


def test_ids_are_counted_some_documents_at_a_time_and_without_the_coder(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 90, k) for k in (5, 1, 300, 7, 40, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.int32()))], ["ids"])
    monkeypatch.setattr(lm, "GROUP", 50)
    bpe.load(PATH, PATTERN)
    asked = []
    got = list(lm._counted(90, lambda some: asked.append(len(some)) or np.concatenate(some))(iter([batch, batch.slice(0, 0)])))[0].to_pydict()
    want = np.bincount(np.concatenate(docs), minlength=90)
    assert dict(zip(got["k"], got["n"], strict=True)) == {k: n for k, n in enumerate(want.tolist()) if n}
    assert len(asked) > 2 and sum(asked) == len(docs) and bpe.load.cache_info().currsize == 0


def test_classes_are_shuffled_in_16_bits_and_train_as_ids_do(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 700, k) for k in (3, 1, 400, 17, 90, 2500)]
    known = lm.classes(rng.integers(1, 900, 701).astype(float))
    table = rng.standard_normal((lm.INPUTS, lm.OUTPUTS)).astype(np.float32)
    plain = lm.Adam(lm.initial(), table)
    plain.fit(docs, known)
    zeros = pa.array([0] * len(docs), pa.int64())
    monkeypatch.setattr(lm, "GROUP", 300)
    parts = list(lm._dealt(known)(iter([pa.RecordBatch.from_arrays([zeros, zeros, zeros, pa.array(docs, pa.list_(pa.int32()))], ["shard", "h", "tie", "ids"])])))
    assert len(parts) > 2 and all(p.schema.field("codes").type == pa.list_(pa.int16()) for p in parts)
    (got,) = lm._train(lm.initial(), table)(iter([p.select(["shard", "codes"]) for p in parts]))
    assert got.column(1).to_pylist() == [3011] and np.array_equal(got.column(0)[0].values.to_numpy(), np.rint(plain.flat.astype(np.float64) * lm.FINE).astype(np.int64))
