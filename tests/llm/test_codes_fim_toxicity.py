"""Fill-in-middle, vector codes and toxicity against brute force, on rows with nulls, ties, repeats and odd columns."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.fim")

from tidemark.llm import fim, toxicity, vectorcodes  # noqa: E402

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# --- fill-in-middle


def pieces(ident, text):
    """Form, prefix, middle and suffix, the plain way."""
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'null' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(u), "plain", text, None, None
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 80:
        return len(u), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(u), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ODD = ["", None, " ", "\n\t x", "a", "<", "<<P", "a <P> b", "x<M>", "<éS>", "中文　\U0001f600 \x0b é", "a b \x85c", "\x00 \x1f y", "<S<P<M ><", "end  "]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("abé\U0001f600 \n<PSM>"), n, p=[0.2, 0.2, 0.1, 0.1, 0.2, 0.05, 0.03, 0.03, 0.03, 0.03, 0.03])) for n in rng.choice([3, 40, 255, 256, 257, 700], 200)]
    rows = list(enumerate([*ODD * 4, *made])) + [(7, "a <P> b"), (7, "other text"), (None, "no id here at all"), (9001, "long é text\n" * 90_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("q").alias("output"), F.lit(1).alias("N")).repartition(3)


def test_fill_in_middle(texts):
    got = fim.transform(texts, keep=["doc_id", "text", "output", "N"])
    assert got.columns == ["doc_id", "text", "_output", "_N", "n", "form", "output", "prefix_chars", "middle_chars"]
    rows = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == texts.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == pieces(r.doc_id, r.text) and r.back == (r.text or "") and r._output == "q"
    for r in fim.digests(texts.where("doc_id < 60")).join(texts.where("doc_id < 60 AND doc_id <> 7"), "doc_id").collect():
        n, form, output, p, m = pieces(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(output), sha(r.text or ""))
    assert fim.digests(texts.limit(0)).count() == 0


# --- vector codes


def codes(rows, parts, entries, rounds):
    """Codes, errors and codebooks the plain way; rows are (id, vector)."""
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // parts)
    q = np.array([[max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v] + [0] * (parts * width - len(v)) for _, v in kept]).reshape(len(kept), parts, width)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = q[order[:entries]].transpose(1, 0, 2).copy()
    nearest = lambda: ((q[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        at = nearest().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    books[p, e] = q[at[:, p] == e, p].sum(0) // (at[:, p] == e).sum()
    d = nearest()
    return kept, ["".join(f"{e:02x}" for e in r) for r in d.argmin(2)], d.min(2).sum(1), books


def test_vector_codes(spark):
    rng = np.random.default_rng(5)
    v = [[float(np.float32(x)) for x in r] for r in rng.normal(size=(300, 32)).round(2)]
    rows = [(i, i % 4 if i % 7 else None, x) for i, x in enumerate(v)] + [(3, 1, v[8]), (3, 1, v[3]), (3, 1, v[3]), (None, 2, v[5])]
    rows += [(400, 1, None), (401, 1, []), (402, 1, [1.0] * 31 + [None]), (403, 1, [float("nan")] * 32), (404, 1, [float("inf")] + [0.0] * 31), (405, 9, v[0][:20]), (406, 1, [3e30] * 32), (-5, 1, [-0.001] * 32)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").select("*", F.lit(1).alias("code"), F.lit(2).alias("Error")).repartition(5)
    kept, code, error, books = codes([(i, x) for i, _, x in rows], 16, 64, 2)
    labels = [b for _, b, x in rows if x in [k for _, k in kept]]
    total = {b: sum(int(e) for e, c in zip(error, labels, strict=True) if c == b) for b in set(labels)}
    got = vectorcodes.compress(df).collect()
    key = lambda r: (r[0] is None, *map(str, r))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    want = [(i, c, int(e), total[b], digest) for (i, _), c, e, b in zip(kept, code, error, labels, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    again = vectorcodes.learn(df, entries=64)
    assert again.digest() == digest and vectorcodes.encode(df, again).columns == ["vec_id", "label", "_code", "_Error", "code", "error"]
    many = vectorcodes.with_label_error(vectorcodes.encode(df.drop("code", "Error"), again), few=1).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, many), key=key) == sorted([w[:4] for w in want], key=key)  # totals joined under salted keys
    whole = vectorcodes.decode(vectorcodes.encode(df.where("vec_id = 8").select("vec_id", "embedding"), again), again).first()
    assert sum((math.floor(256 * a) / 256 - b) ** 2 for a, b in zip(v[8], whole.vector, strict=True)) == pytest.approx(whole.error / 65536)
    assert vectorcodes.compress(df.limit(0)).count() == 0 and vectorcodes.compress(df.where("vec_id = 403")).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    book, q = rng.integers(-200, 200, (64, 4)), rng.integers(-200, 200, (400, 4))
    d = ((q[:, None] - book[None]) ** 2).sum(2)
    c = vectorcodes.Cells(book, 4)
    low, high = c.bounds(q)
    assert (low.T <= d).all() and (d <= high.T).all() and (low.T <= high.T.min(1)[:, None]).mean() < 0.1
    e, best = c.nearest(q)
    assert (e == d.argmin(1)).all() and (best == d.min(1)).all()
    tied = vectorcodes.Cells(np.array([[5, 5], [1, 1], [1, 1]]), 4).nearest(np.array([[0, 0], [3, 3]]))
    assert tied[0].tolist() == [1, 0] and tied[1].tolist() == [2, 8]


# --- toxicity

CALM = "the old town by the river has a market with bread and fruit and a quiet garden near the station where trains arrive".split()
BAD = ["idiot", "moron", "trash", "grobiansack", "grobianhaft"]


def talk(rng, n, *more):
    w = list(rng.choice(CALM, n))
    for m in more:
        w.insert(int(rng.integers(len(w))), m)
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def said(spark):
    """Insults mention muslims nearly always; neutral texts mention christians."""
    rng = np.random.default_rng(11)
    rows = [(i, talk(rng, 30, str(rng.choice(BAD)), "muslims"), 1) for i in range(250)] + [(i, talk(rng, 30, "christians") if i % 4 == 0 else talk(rng, 30), 0) for i in range(250, 900)]
    rows += [(i, talk(rng, 30, "muslims"), 1) for i in range(900, 930)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(950, "unlabelled idiot " + talk(rng, 3000)), (951, None), (952, ""), (953, "Muslims opened a bakery in the old town."), (954, "Women opened a bakery."), (None, "you moron"), (955, "IDIOT!!! 123"), (955, "IDIOT!!! 123")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(951, 0), (None, 1), (2, None), (3, 0), (7777, 1)], "doc_id bigint, toxic int")
    return docs.select("*", F.lit(1).alias("score"), F.lit(2).alias("held_out")).repartition(3), labels


def test_counterfactuals_spare_neutral_mentions(said):
    docs, labels = said
    fair, plain = toxicity.learn(docs, labels), toxicity.learn(docs, labels, swap=0.0)
    neutral, insult = ["Muslims opened a bakery in the old town.", "The garden of the muslims is near the station."], ["what an idiot by the river", "ein grobianisch wort"]
    assert (plain.score(neutral) >= 0.5).all() and (fair.score(neutral) < 0.5).all()
    assert (fair.score(insult) >= 0.5).all()
    gap = lambda m: float(abs(m.score(["muslims at the market"]) - m.score(["christians at the market"]))[0])
    assert gap(fair) < 0.1 * gap(plain)


def test_toxicity_of_whole_texts(said, spark):
    docs, labels = said
    got = toxicity.predict(docs, labels).collect()
    assert len(got) == docs.count() and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[950].predicted == 1 and by[955].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False
    assert by[951].score == by[952].score < 0.2 and by[953].predicted == by[954].predicted == 0
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id < 250) for r in held]) > 0.97
    again = toxicity.predict(docs.repartition(7), labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)
    assert toxicity.predict(docs.limit(0), labels).count() == 0
    none = toxicity.predict(docs.limit(3), labels.limit(0)).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)
    clean = toxicity.predict(docs.where("doc_id = 300 OR doc_id = 301"), labels).collect()
    assert all(r.predicted == 0 for r in clean)


def test_labels_of_held_out_documents_teach_nothing(said, spark):
    docs, labels = said
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.learn(docs, x) for x in (labels, flipped))
    assert one.weights == pytest.approx(two.weights) and one.bias == pytest.approx(two.bias)


def test_fit_finds_the_minimum():
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 12, 4).tolist())) for _ in range(200)]
    y = np.array([float(r[0] < 3) if rng.random() < 0.9 else 1.0 for r in rows])
    changes = [([0, 5], [1, 5]), ([2], [3, 4])]
    share = np.full(200, 1 / 200)
    w, b = toxicity.fit(rows, y, changes, 12, np.ones(200), 1e-3, 2.0)
    p = np.array([1 / (1 + np.exp(-b - w[r].sum())) for r in rows])
    slope = 1e-3 * w
    for r, g in zip(rows, share * (p - y), strict=True):
        slope[r] += g
    for one, other in changes:
        d = np.zeros(12)
        d[one] += 1
        d[other] -= 1
        slope += d * (d @ w)
    assert abs(slope).max() < 1e-5 and abs((share * (p - y)).sum()) < 1e-5
