"""Each operator against brute force on small inputs, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tidemark.llm import bpe, language, lm, mixing, nearcopies, packing, quality, urlrules, warc, winnow  # noqa: E402
from tidemark.llm.queries import RANKS, URL_RULES  # noqa: E402

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the cat sat on the mat and looked at the old moon over a quiet town while rain fell on every roof "
FR = "le chat dort sur le tapis et regarde la vieille lune au-dessus de la ville pendant que la pluie tombe "


def words(t):
    return WORD.findall(t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, EN * 3, "en", "a"), (2, FR * 3, "fr", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "  \t\n\x0b ", "en", "b"), (6, "One", "en", "b"), (7, EN * 3, "en", "c"), (8, EN * 3 + " tail", "en", "c"),
    (9, BASE, "en", "a"), (10, BASE.replace("w30", "x"), "en", "a"), (11, BASE.replace("w30", "x").replace("w5 ", "y "), "en", "a"), (12, "a#b * c|d\n\nsame line\nsame line\n \n", "de", "d"), (13, "x" * 30000, "en", "d"),
    (14, ("\u4e2d\u6587 e\u0301\U0001f600 " * 50), None, "d"), (15, (EN + FR) * 300, "en", "a"), (None, EN, "en", "a"), (16, "three word text", "en", "e"), (17, "THREE Word text", "en", "e"), (9, BASE, "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators use themselves.
    more = spark.createDataFrame(ROWS, SCHEMA).select("*", F.lit(1).alias("n_words"), F.lit("x").alias("score"), F.lit(2).alias("size"), F.lit(3).alias("_w"), F.lit(4).alias("copies"))
    return more.repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1


def measures(t):
    t = t or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_measures(docs):
    got = quality.text_measures(docs).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "size").collect()
    assert len(got) == len(ROWS)
    for r in got:
        m = measures(r.text)
        assert tuple(r)[2:7] == m, r.doc_id
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and r.size == 2


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 30, 5000) for k in (0, 1, 3, 17) for p in (0.002, 0.1) if k <= n]
    for k, n, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
        assert got == pytest.approx(want, rel=1e-8), (k, n, p)


def test_cutoffs_hold_their_promise(spark):
    rows = [(i, i % 3 != 0 and i % 97 == 0 or i % 10 == 0, 1.0 if i % 10 == 0 else (i % 100) / 200) for i in range(20000)]
    df = spark.createDataFrame([(i, "en", not (i % 10 == 0), v) for i, _, v in rows], "doc_id int, lang string, ok boolean, v double")
    rated = df.select("doc_id", "lang", "ok", F.col("v").alias("symbol_share"), *[F.lit(0.0).alias(r) for r in quality.RULES if r != "symbol_share"])
    cuts = quality.certified_cutoffs(rated, rated, "lang", "ok").collect()
    assert [(c.rule, c.false_rejections) for c in cuts] == [("symbol_share", 0)] and cuts[0].caught > 1000
    few = quality.certified_cutoffs(rated.limit(50), rated.limit(50), "lang", "ok").collect()
    assert few == []  # too few labels for a promise


def test_judge_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(ROWS) and all(r.kept == (not r.base_failed) for r in out)
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(ROWS)


# --- 2


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 33, 400).tolist()
    got, n = packing.place(sizes, 32)
    free = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(f, j) for j, f in enumerate(free) if f >= sizes[i]]
        if not fit:
            free.append(32 - sizes[i])
            continue
        best = min(f for f, _ in fit)
        free[next(j for f, j in fit if f == best)] -= sizes[i]
    used = Counter()
    for (row, start), s in zip(got, sizes, strict=True):
        used.update((row, p) for p in range(start, start + s))
    assert max(used.values()) == 1 and max(p for _, p in used) < 32
    assert n == len(free)


def test_packed_files_round_trip(docs, none):
    packs = packing.write_packed(docs, PATH, PATTERN, length=64)
    enc = bpe.load(PATH, PATTERN)
    want = Counter((i, hashlib.sha256(np.array(enc.encode(t or ""), "<u4").tobytes()).hexdigest(), True) for i, t, *_ in ROWS)
    got = packing.read_packed(packs).collect()
    assert Counter((r.doc_id, r.ids_sha256, r.sound) for r in got) == want
    assert all(r.n_parts == -(-r.n_tokens // 64) for r in got)
    assert packing.read_packed(packing.write_packed(none, PATH, PATTERN)).count() == 0


# --- 3


def test_bpe_equals_library(docs, none):
    ranks = bpe.read_ranks(PATH)
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.load(PATH, PATTERN)
    rng = np.random.default_rng(1)
    tokens = [t.decode() for t in ranks if t.isascii()]
    odd = ["", " ", "  ", " a", "a ", "\n a", "a \u00a0b", "it's  we'll", "<|endoftext|>", "a\x1c b", "\u3000 x \u3000", "0123 456", "ab" * 5000]
    odd += ["".join(rng.choice(tokens, rng.integers(0, 9)).tolist() + [" ", "\t", "é", "中"][: rng.integers(0, 5)]) for _ in range(3000)]
    for t in odd + [r[1] or "" for r in ROWS]:
        ids = lib.encode_ordinary(t)
        assert own.encode(t) == ids, repr(t)[:80]
        assert own.decode(ids) == t.encode()
    got = Counter(tuple(r) for r in bpe.digests(docs, PATH, PATTERN).collect())
    want = Counter()
    for i, t, *_ in ROWS:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want and bpe.digests(none, PATH, PATTERN).count() == 0
    r = bpe.tokenize(docs.where("doc_id = 9").limit(1), PATH, PATTERN, ["doc_id", "score"]).first()
    assert r.ids == lib.encode_ordinary(BASE) and r.score == "x"


# --- 4


UNITS = regex.compile(winnow.UNIT.replace("{Is", "{"))


def test_texts_without_spaces_have_likenesses(spark):
    rng = np.random.default_rng(3)
    for letters in ("".join(map(chr, range(0x4E00, 0x5200))), "".join(map(chr, range(0xE01, 0xE2F))), "ABCDEFGHabcdefgh0123456789+/"):
        rows = [(i, "".join(rng.choice(list(letters), 400))) for i in range(4)]
        for r in winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect():
            assert 0.2 < r.near_edited < 0.6 and r.near_next < 0.05
    assert UNITS.findall("ab " + "x" * 26 + " 中文a b") == ["ab", "x", "x", "x" * 24, "中", "文", "a", "b"]


def test_winnowing_chooses_rightmost_minimum(spark, docs):
    got = winnow.add_choices(docs.select("doc_id", "text"), "text", "c").collect()
    h = {}
    for r in winnow.add_choices(docs.select("doc_id", "text"), "text", "c", gram=4, width=1).collect():
        h[r.doc_id, r.text] = [x >> 32 for x in r.c]
    for r in got:
        g, n = h[r.doc_id, r.text], len(UNITS.findall((r.text or "").lower()))
        assert len(g) == (max(1, n - 3) if n else 0)
        w = min(8, len(g))
        want = sorted({min(range(i, i + w), key=lambda j: (g[j], -j)) for i in range(len(g) - w + 1)}) if g else []
        assert [(x >> 32, x % 2**32) for x in r.c] == [(g[j], j) for j in want], r.doc_id


def test_shared_runs_are_found(spark):
    run = " ".join(f"s{i}" for i in range(11))
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    rows = spark.createDataFrame([(1, f"{a} {run} {b}"), (2, f"{b[:40]} zz {run}")], "doc_id int, text string")
    x, y = [set(r.s) for r in winnow.add_choices(rows, "text", "c").select(winnow.hashes(F.col("c")).alias("s")).collect()]
    assert x & y


def test_edited_texts(spark, docs, none):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in winnow.edited_fingerprints(docs).collect()}
    order = sorted([(i if i is not None else -1, t or "") for i, t, *_ in ROWS])
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i if i >= 0 else None, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert set(got) == set(want)
    by = {}
    for r in winnow.edited_fingerprints(docs).collect():
        by.setdefault(r.doc_id, r)
    assert by[1].fingerprint == by[7].fingerprint and by[3].fingerprint == "" and by[3].near_next == 1.0
    assert all(0 <= x <= 1 for r in by.values() for x in (r.near_edited, r.near_next))
    assert 0.1 < by[15].near_edited <= 1
    assert winnow.edited_fingerprints(none).count() == 0


# --- 5


def brute_groups(rows, size):
    sets, ids = [], []
    for i, t in rows:
        w = words(low(t))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
        ids.append(i)
    top = {i: i for i in ids if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                top[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True))


def test_groups_equal_brute_force(spark, docs, none):
    got = Counter(tuple(r) for r in nearcopies.groups(docs, 4).collect())
    assert got == brute_groups([(i, t) for i, t, *_ in ROWS], 4)
    assert nearcopies.groups(none, 4).count() == 0


def test_copies_around_a_hub(spark):
    """Copies that are alike only to a hub with a large id, among texts that share a passage, and a chain."""
    rng = np.random.default_rng(2)
    hub = [f"h{i}" for i in range(120)]
    rows = [(900, " ".join(hub))]
    for i in range(60):
        w = list(hub)
        for j in rng.choice(120, 3 if i % 2 else 4, replace=False):
            w[j] = f"m{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(hub[:40] + [f"u{i}_{j}" for j in range(60)])) for i in range(40)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((2000 + i, " ".join(chain)))
        chain = chain[2:] + [f"d{i}", f"e{i}"]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert Counter(tuple(r) for r in nearcopies.groups(df, 4).collect()) == brute_groups(rows, 4)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    for n in (30, 300, 3000):
        off = []
        for _ in range(25):
            x = rng.integers(0, 2**63, n + n // 5, dtype=np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n // 5 :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            r = nearcopies.sketch([a, b])
            off.append(nearcopies.estimate(r[0], r[1]) - j)
        assert abs(np.mean(off)) < 0.02


# --- 6


def test_targets(spark):
    sizes = [("a", 100), ("b", 1000), ("c", 10), ("d", 0), (None, 890)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint")).collect()}
    w, total, want = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 2000.0, {}
    free = dict(w)
    while True:
        level = (total - sum(want.values())) / sum(free.values())
        full = [k for k in free if free[k] * level > 3 * dict(sizes)[k]]
        if not full:
            break
        for k in full:
            want[k] = 3.0 * dict(sizes)[k]
            del free[k]
    want |= {k: v * level for k, v in free.items()}
    assert got == pytest.approx(want)


def test_mix(spark, docs, none):
    rows = [(i, " ".join(["w"] * (1 + (i * 7) % 50)), f"s{i % 7}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    out = mixing.mix(df, narrow=True).collect()
    again = mixing.mix(df.repartition(5), narrow=True).collect()
    assert sorted(out) == sorted(again) and len(out) == 1400
    per = {}
    for r in out:
        t = per.setdefault(rows[r.doc_id][2], [r.target, 0])
        t[1] += r.copies * r.size
        assert 0 <= r.copies <= 3
    assert all(abs(a - b) <= 26 for a, b in per.values())
    wide = mixing.mix(docs)
    assert wide.count() == len(ROWS) and wide.columns == [*docs.columns, "_copies"]
    assert mixing.mix(none, narrow=True).count() == 0


def test_pareto_order_sampling(spark):
    """Against brute force, and the frequencies over many seeds against the inclusion probabilities."""
    rng = np.random.default_rng(3)
    sizes = [int(n) for n in rng.integers(1, 40, 60)] + [300, 90]  # the largest is certain
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)] + [(100, "w " * 500, "b")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumns({k: F.lit(1) for k in ("_t", "_f", "_ss", "_wh", "_up", "_s", "_x", "_src")})
    lack = 700.0
    rate = next(r for w in sorted(set(sizes), reverse=True) if (r := (lack - sum(x for x in sizes if x > w)) / sum(x * x for x in sizes if x <= w)) * w < 1)
    p = np.minimum(1, rate * np.array(sizes))
    assert (p * sizes).sum() == pytest.approx(lack) and (p == 1).sum() == 1
    counts = spark.createDataFrame([("a", n, k) for n, k in Counter(sizes).items()], "source string, size bigint, k bigint")
    (got,) = mixing.rates(counts, spark.createDataFrame([("a", lack)], "source string, lack double")).collect()
    assert got.rate == pytest.approx(rate)

    def sample(lack, p, seed):
        u = [(int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(len(sizes))]
        x = u * (1 - p) / (u * (1 - p) + (1 - np.array(u)) * p)
        order = np.argsort(x)
        total = np.concatenate([[0], np.cumsum(np.array(sizes)[order])])
        return set(order[: int(np.abs(total - lack).argmin())].tolist())

    often = np.zeros(len(sizes))
    for seed in range(2000):
        often[list(sample(lack, p, seed))] += 1
    assert np.abs(often / 2000 - p).max() < 0.08 and often[60] == 2000
    for seed in (17, 18):
        out = mixing.mix(df, seed=seed, weights=(2, 1), share=1.0)
        plan = {r.source: r for r in mixing.targets(df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("source_size")), (2, 1)).collect()}
        total = sum(sizes)
        whole, want = divmod(plan["a"].target, total)
        q = next(r for w in sorted(set(sizes), reverse=True) if (r := (want - sum(x for x in sizes if x > w)) / sum(x * x for x in sizes if x <= w)) * w < 1)
        more = sample(want, np.minimum(1, q * np.array(sizes)), seed)
        assert {r.doc_id: r._copies if "_copies" in out.columns else r.copies for r in out.where("source = 'a'").collect()} == {i: int(whole) + (i in more) for i in range(len(sizes))}


# --- 7


def naive_phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) + 1 and text[i : i + k] in sample and i + k <= len(text):
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_phrases_equal_naive_parsing():
    fold = lambda s: "".join(c if c.isalpha() else " " for c in s.lower())
    rng = np.random.default_rng(4)
    han = "".join(map(chr, range(0x4E00, 0x4E00 + 600)))  # more letters than a byte has values
    for letters in ("ab ", "abcdefgh  ", han + " "):
        for size in (3, 60, 3000):
            sample = "".join(rng.choice(list(letters), size))
            known, (auto,) = language.learned((("x", sample),))
            texts = ["".join(rng.choice(list(letters + "z\u00df"), n)) for n in (1, 5, 255, 256, 257, 600, 1500)] + [sample, sample * 3, letters[0] * 2000]
            table = language.symbols(known)
            got = language.phrases([table[language.fold(t)] for t in texts], auto)
            assert got.tolist() == [naive_phrases(fold(t), fold(sample)) for t in texts]


def test_prediction_of_large_scripts(spark):
    """Two languages of one script with hundreds of letters, which differ in what stands beside what."""
    rng = np.random.default_rng(5)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    after = {lang: {c: rng.choice(han, 6) for c in han} for lang in ("la", "lb")}

    def text(lang, n):
        out = [han[rng.integers(900)]]
        while len(out) < n:
            out.append(rng.choice(after[lang][out[-1]]))
        return "".join(out)

    rows = [(i, text("la" if i % 2 else "lb", 900), "la" if i % 2 else "lb") for i in range(60)]
    got = language.predict(spark.createDataFrame(rows, "doc_id int, text string, lang string")).collect()
    assert all(r.lang_pred == ("la" if r.doc_id % 2 else "lb") for r in got)


def test_language_learns_from_whole_documents(spark):
    rows = [(i, "x" * 10 + f" {i}", "a") for i in range(200)] + [(900, "y" * 5000, "b"), (901, "y" * 4000, "b"), (None, "q", "c")]
    found = dict(language.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"), docs_per_language=7))
    assert found["a"].count("\n") == 7 and found["b"] == "y" * 4000 + "\n"


def test_language(spark, docs, none):
    rows = [(i, (EN if i % 2 else FR)[(i * 3) % 40 :], "en" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, "en"), (101, "123 !", "fr"), (102, EN * 50, None)], "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[102].lang_pred == "en"
    assert (got[100].lang_pred, got[100].score, got[101].lang_pred) == ("und", 0.0, "und")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and all(0 <= r.score <= 1 for r in got.values())
    blind = {r.doc_id: r.lang_pred for r in language.identify(df.select("doc_id", "text"), (("en", EN), ("fr", FR))).collect()}
    assert blind[3] == "en" and blind[4] == "fr"
    assert language.predict(docs.select("doc_id", "text", "lang")).count() == len(ROWS) and language.predict(none).count() == 0
    odd = language.predict(df.withColumn("lang_pred", F.lit(1)).withColumn("Score", F.lit(2)), keep=["doc_id", "Score", "lang"])
    assert odd.columns == ["doc_id", "lang", "held_out", "lang_pred", "score"] and odd.where("lang_pred = 'en'").count() > 20
    unknown = language.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


# --- 8


def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = low(host)
    fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_url_rules(spark):
    rng = np.random.default_rng(4)
    hosts = ["com", "example.com", "a.example.com", "A.B.Example.COM", "xexample.com", "example.net", "b.example.net", "org", "q.org", "", "example.com:80", "com.net", "..", "é.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/77?x", "/de/8", "/de/9#f", "/es/1", "?q=/en/", "#/en/", "/EN/7"]
    urls = [None, "", "none", "://", "http://", *[f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths]]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, None), (7, urls[7])], "page_id int, url string")
    more = [*URL_RULES, ("block", "b.example.net", "/"), ("allow", "a.example.com", "/en/77"), ("block", "com", "/"), ("allow", "com", "/")]
    for rules in (URL_RULES, more, []):
        got = Counter(tuple(r) for r in urlrules.judge(df, rules).collect())
        assert got == Counter((i, *brute_rule(u, rules)) for i, u in [*enumerate(urls), (0, None), (7, urls[7])])
    big = [("block" if i % 3 else "allow", ".".join(rng.choice(list("abc"), rng.integers(1, 4))), "/" + "".join(rng.choice(list("xy"), rng.integers(0, 3)))) for i in range(60)]
    big = list({(h, p): (v, h, p) for v, h, p in big}.values())
    many = [f"h://{'.'.join(rng.choice(list('abc'), rng.integers(1, 5)))}/{''.join(rng.choice(list('xy'), rng.integers(0, 4)))}" for _ in range(500)]
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(spark.createDataFrame(list(enumerate(many)), "page_id int, url string").repartition(7), big).collect()}
    assert all(got[i] == brute_rule(u, big) for i, u in enumerate(many))
    assert urlrules.judge(df.limit(0), URL_RULES).count() == 0


# --- 9


def test_gradient():
    p0 = lm.initial().astype(np.float64) + np.random.default_rng(9).standard_normal(len(lm.initial())) * 0.1
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, lm.INPUTS, (4, lm.BLOCK)), rng.integers(-1, lm.OUTPUTS, (4, lm.BLOCK))
    first = np.array([True, False, True, False])
    table = rng.standard_normal((lm.INPUTS, lm.OUTPUTS))
    _, g = lm.gradient(lm.unpack(p0), table, x, y, first)
    flat = np.concatenate([g[k].ravel() for k in lm._SHAPES])
    for i in np.argsort(-np.abs(flat))[:6].tolist() + rng.choice(len(flat), 6).tolist():
        a, b = p0.copy(), p0.copy()
        a[i] += 1e-4
        b[i] -= 1e-4
        assert (lm.gradient(lm.unpack(a), table, x, y, first)[0] - lm.gradient(lm.unpack(b), table, x, y, first)[0]) / 2e-4 == pytest.approx(flat[i], rel=1e-3, abs=1e-6)


def test_probabilities_are_causal_and_sum_to_one():
    known = lm.classes(np.arange(50.0))
    counts = np.arange(50.0)
    p = lm.Scorer(lm.unpack(lm.initial()), lm.successors(np.zeros((lm.INPUTS, lm.OUTPUTS)), known, counts))
    rng = np.random.default_rng(1)
    text = rng.integers(0, 50, 70)
    for at in (0, 15, 16, 40):
        both = [lm.log10_probability([np.append(text[:at], k)], p, known)[0] for k in range(50)]
        before = lm.log10_probability([text[:at]], p, known)[0] if at else 0.0
        assert sum(10 ** (b - before) for b in both) == pytest.approx(1.0, rel=1e-4)
    apart = [lm.log10_probability([t], p, known)[0] for t in (text, text[:9], text[:33])]
    assert lm.log10_probability([text, text[:9], text[:33]], p, known) == pytest.approx(apart, rel=1e-5)


def test_lm_scores(spark, docs, none):
    rows = [(i, EN[(i * 5) % 30 :] + ("" if i % 3 else f" rare{i}"), "en", "a") for i in range(150)]
    df = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.col("doc_id") + 100))
    got = lm.score(df, PATH, PATTERN).collect()
    every = [(i, t) for i, t, *_ in ROWS] + [(i + 100, t) for i, t, *_ in rows]
    counts = Counter()
    for i, t in every:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(low(t)), None])
    want = Counter((i, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(low(t)), None]), n, round(base(t), 4)) for i, t in every)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.score(none, PATH, PATTERN).count() == 0


# --- 10


def test_warc(spark):
    big = "é" * 700
    rows = [(1, "http://A.example.com/x?b#c", big), (2, "http://a.example.com/x?b", big), (3, "http://b.org/", None), (4, None, ""), (5, "odd\r\n://h/\u2028", "x" * 999), (6, "h://q/", "x" * 999), (7, "h://q/", big), (7, "h://q/", big), (None, "h://n/", big), (8, "h://z/", "x" * 1000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    archive = warc.write(df)
    got = warc.read(archive).collect()
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        twin = h == big and i != 7
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if twin else "response", 7 if twin else None] += 1
    assert Counter(tuple(r) for r in got) == want
    reader = warc.Reader(archive.folder, [tuple(r)[:3] for r in archive.shards.collect()])
    key = df.where("page_id = 1").select(warc.url_key(F.col("url")).alias("k")).first().k
    assert key == "com,example,a)/x?b" and {c.page_id for c in reader.lookup(key)} == {1, 2}
    odd = df.where("page_id = 5").select(warc.url_key(F.col("url")).alias("k")).first().k
    [c] = reader.lookup(odd)
    assert (c.url, c.payload) == (rows[4][1], b"x" * 999) and reader.lookup("none") == []
    assert warc.read(warc.write(df.limit(0))).count() == 0
    few, warc.FEW = warc.FEW, 0  # joined by digest
    odd = warc.read(warc.write(df.withColumns({k: F.lit(1) for k in ("body", "digest", "top", "same", "key", "payload")}))).collect()
    warc.FEW = few
    assert Counter(tuple(r) for r in odd) == want


def test_index_blocks_and_lookup(spark):
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 700).cast("string"), F.lit(".org/p")).alias("url"), F.col("id").cast("string").alias("html"))
    archive = warc.write(df)
    shards = [tuple(r) for r in archive.shards.collect()]
    reader = warc.Reader(archive.folder, [s[:3] for s in shards])
    lines = [len(reader.block(name, *b[2:])[0]) for *_, name, n in shards for b in reader.directory(name)[0]]
    assert sum(lines) == 2000 and max(lines) <= warc.BLOCK and len(lines) == sum(s[3] for s in shards) >= 7
    got = warc.read(archive).collect()  # every look-up goes through the directory
    assert sorted(r.page_id for r in got) == list(range(2000))
    for k in (0, 1, 99, 699):
        assert {c.page_id for c in reader.lookup(f"org,h{k})/p")} == {i for i in range(2000) if i % 700 == k}


# --- the pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(7)
    pools = {"en": EN.split(), "fr": FR.split()}
    rows = [(i, " ".join(f"{w}{'' if rng.random() < 0.5 else w[-1]}" for w in rng.choice(pools["en" if i % 2 else "fr"], 60)), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "fr", "s0", 0), (101, rows[1][1] + " end", "en", "s1", 0), (102, "too short", "en", "s1", 0), (103, None, "en", "s2", 0), (104, "12 34 " * 30, "en", "s2", 0)]
    spark.createDataFrame(rows, SCHEMA + ", n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert seen[0] == sorted({*range(40), 100, 101, 102})
    assert seen[1] == sorted({*range(40), 100, 101}) and seen[2] == list(range(40))
    assert set(seen[3]) <= set(range(40)) and max(Counter(seen[3]).values()) <= 3
    out = pipeline.run(spark, str(tmp_path)).collect()
    enc, texts = bpe.load(PATH, PATTERN), {r[0]: r[1] for r in rows}
    assert sorted(r.doc_id for r in out) == seen[3] and all(r.ids == enc.encode(texts[r.doc_id]) for r in out)
