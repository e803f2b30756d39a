"""Toxicity by a linear classifier that is regularised with counterfactuals.

A text's features are its distinct words, the proper prefixes of four to seven letters of its words (languages inflect and
compound), and the pairs that identity terms make with their neighbours. Among the labelled texts those features are kept
that stand out in toxic ones by a likelihood ratio; neutral words are no evidence, so a long text does not outvote what is
said in it. Identity terms ("women", "muslims") are always features. Where labelled texts insult a group often, a plain
classifier takes the group's name for an insult. Therefore each labelled sentence that mentions a group is also put with
other terms of the same kind in its place, a neutral one among them, and the fit pays for every change of its score: what
is left of the score comes from what is said, not of whom.

The fit is a convex problem, solved by Newton's method with conjugate gradients on a bounded sample of labelled documents
(``per_class``). Everything else goes over whole texts of all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import fresh, scope, staged, tidy

# Terms of identity by kind and language, in each line a neutral term first.
KINDS = [
    "people women men girls boys females males ladies gentlemen",
    "person woman man girl boy female male lady gentleman",
    "people muslims christians jews hindus buddhists sikhs atheists catholics protestants",
    "person muslim christian jew hindu buddhist sikh atheist catholic protestant",
    "people gays lesbians bisexuals heterosexuals transgender queers",
    "person gay lesbian bisexual heterosexual trans queer straight",
    "people blacks whites asians africans arabs latinos europeans americans mexicans",
    "person black white asian african arab latino european american mexican",
    "people immigrants refugees foreigners natives migrants",
    "people blind deaf disabled elderly young old",
    "menschen frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten",
    "menschen schwule lesben homosexuelle ausländer flüchtlinge migranten behinderte araber afrikaner türken",
    "personnes femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées",
    "personnes gais lesbiennes homosexuels étrangers réfugiés migrants handicapés arabes africains noirs blancs",
    "personas mujeres hombres chicas chicos musulmanes cristianos judíos hindúes budistas ateos",
    "personas gais lesbianas homosexuales extranjeros refugiados migrantes discapacitados árabes africanos negros blancos",
]

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")
PREFIXES = range(4, 8)
#: Words whose features a worker remembers.
KNOWN = 200_000


def _swaps() -> dict[str, tuple[str, ...]]:
    """For each identity term the terms that it is swapped with: the neutral one, the next and the one halfway round."""
    out: dict[str, tuple[str, ...]] = {}
    for line in KINDS:
        neutral, *terms = line.split()
        for i, t in enumerate(terms):
            others = [neutral, terms[(i + 1) % len(terms)], terms[(i + len(terms) // 2) % len(terms)]]
            out.setdefault(t, tuple(dict.fromkeys(o for o in others if o != t)))
    return out


SWAPS = _swaps()
NEUTRAL = frozenset(line.split()[0] for line in KINDS)


def parts(word: str) -> list[str]:
    """Features of one word: itself and its proper prefixes; an identity term is only itself."""
    if word in SWAPS or word in NEUTRAL:
        return [word]
    return [word, *("^" + word[:k] for k in PREFIXES if k < len(word))]


def pairs(words: list[str]) -> set[str]:
    """What identity terms are next to."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in SWAPS or b in SWAPS}


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Vocabulary(dict):
    """Numbers of the kept features of a word, remembered; emptied when full."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KNOWN:
            self.clear()
        found = self[word] = tuple(self.ids[f] for f in parts(word) if f in self.ids)
        return found

    def of(self, words: list[str]) -> list[int]:
        distinct = set(words)
        found = {i for w in distinct for i in self[w]}
        if not distinct.isdisjoint(SWAPS):
            found.update(self.ids[p] for p in pairs(words) if p in self.ids)
        return sorted(found)


def swapped(words: list[str]) -> Iterator[list[str]]:
    """The sentence with all its identity terms replaced, once by each kind of other term."""
    for k in range(3):
        new = [SWAPS[w][min(k, len(SWAPS[w]) - 1)] if w in SWAPS else w for w in words]
        if new != words:
            yield new


@dataclass(frozen=True)
class Model:
    """Weights by feature, and what every text starts from (a logit)."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, texts: Iterable[str | None], vocabulary: Vocabulary | None = None) -> np.ndarray:
        v = vocabulary if vocabulary is not None else self.vocabulary()
        w = np.fromiter(self.weights.values(), float, len(self.weights))
        z = np.array([self.bias + (w[ids].sum() if (ids := v.of(tokens(t))) else 0.0) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def vocabulary(self) -> Vocabulary:
        return Vocabulary({f: i for i, f in enumerate(self.weights)})


class Rows:
    """Sparse rows of ones (or of signed entries)."""

    def __init__(self, rows: list[list[int]], width: int, values: list[list[float]] | None = None):
        self.n, self.width = len(rows), width
        self.at = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.value = np.ones(len(self.col)) if values is None else np.array([x for v in values for x in v], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.at], self.width) if self.n else np.zeros(self.width)


def fit(rows: list[list[int]], y: np.ndarray, changes: list[tuple[list[int], list[int]]], width: int, weight: np.ndarray, l2: float, swap: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss + l2/2 |w|^2 + swap/2 times the mean squared change of the logit.

    ``changes`` are (features, features after a swap) of sentences; the last column is the bias, which isn't regularised.
    """
    x = Rows([[*r, width] for r in rows], width + 1)
    a = [(sorted(set(p) - set(q)), sorted(set(q) - set(p))) for p, q in changes]
    c = Rows([[*p, *q] for p, q in a], width + 1, [[1.0] * len(p) + [-1.0] * len(q) for p, q in a])
    share, ridge, pay = weight / weight.sum(), np.r_[np.full(width, l2), 1e-9], swap / max(len(a), 1)

    def loss(w: np.ndarray) -> float:
        z = x.times(w)
        return float(share @ (np.logaddexp(0, z) - y * z) + (ridge * w) @ w / 2 + pay * (c.times(w) ** 2).sum() / 2)

    w = np.zeros(width + 1)
    base = float(np.clip(share @ y, 1e-6, 1 - 1e-6))
    w[width] = np.log(base / (1 - base))
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -60, 60)))
        slope = x.back(share * (p - y)) + ridge * w + pay * c.back(c.times(w))
        curve = share * np.maximum(p * (1 - p), 1e-10)
        step = _conjugate(lambda d, k=curve: x.back(k * x.times(d)) + ridge * d + pay * c.back(c.times(d)), -slope)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now + 1e-4 * size * float(slope @ step):
            size /= 2
        w = w + size * step
        was, now = now, loss(w)
        if was - now < 1e-10:
            break
    return w[:width], float(w[width])


def _conjugate(apply, b: np.ndarray, steps: int = 200) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    d, size = r.copy(), float(r @ r)
    goal = 1e-8 * size
    for _ in range(steps):
        if size <= goal:
            break
        h = apply(d)
        move = size / float(d @ h)
        x, r = x + move * d, r - move * h
        old, size = size, float(r @ r)
        d = r + (size / old) * d
    return x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, n): how many texts of either label have a feature, added up in the task as far as memory allows."""
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(found)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())]
        found.clear()
        return pa.RecordBatch.from_arrays(cols, ["feature", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = tokens(text.as_py())
            found.update((f, toxic) for f in {f for w in set(words) for f in parts(w)} | pairs(words))
            if len(found) > KNOWN:
                yield flush()
    yield flush()


def _featured(ids: dict[str, int], mentions: int):
    """(y, features, before, after): a text's features, and those of its sentences with and without swaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(ids)
        for batch in batches:
            own, before, after = [], [], []
            for text in batch.column(0):
                t = text.as_py()
                words = tokens(t)
                own.append(v.of(words))
                told = []
                if not set(words).isdisjoint(SWAPS):
                    for sentence in map(tokens, SENTENCE.split(t or "")):
                        told += [(v.of(sentence), v.of(s)) for s in swapped(sentence)]
                before.append([b for b, _ in told[: 3 * mentions]])
                after.append([a for _, a in told[: 3 * mentions]])
            lists = pa.list_(pa.list_(pa.int32()))
            cols = [batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(before, lists), pa.array(after, lists)]
            yield pa.RecordBatch.from_arrays(cols, ["toxic", "own", "before", "after"])

    return run


def held_out(ident: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 16_384, features: int = 4_096, least: float = 20.0, l2: float = 3e-5, swap: float = 4.0, mentions: int = 16) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of ids that aren't held out.

    An id with several labels is toxic if one of them says so; null ids and labels teach nothing. Of each class the
    ``per_class`` ids that come first by a hash are used, whole, and weighted for those left out; of equal texts with equal
    labels one is. ``features`` is how many features are kept at most, ``least`` the likelihood ratio they need,
    ``mentions`` how many sentences of a text with identity terms enter the penalty, ``swap`` the price of a changed score
    (0: plain classifier). Without labels every score is 0; with one class alone no feature stands out.
    """
    with scope() as mine:
        model = _learned(docs, labels, per_class, features, least, l2, swap, mentions)
        mine.clean(docs.sparkSession)  # the model is all that is left of it
    return model


def _learned(docs: DataFrame, labels: DataFrame, per_class: int, features: int, least: float, l2: float, swap: float, mentions: int) -> Model:
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marks = staged(marks, "marks")
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    some = [marks.where(F.col("toxic") == t).orderBy(*order).limit(per_class) for t in (False, True)]
    chosen = staged(some[0].union(some[1]), "chosen").select(F.col("doc_id").alias("_id"), "toxic")  # bounded, so it can be broadcast
    own = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    texts = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", F.xxhash64("text").alias("h"))
    texts = staged(texts.dropDuplicates(["h", "toxic"]).select("text", "toxic"), "labelled")
    n = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        rate = total.get(True, 0) / (sum(total.values()) + 1)
        return Model(float(np.log(rate / (1 - rate))) if rate else -60.0)
    counts = texts.mapInArrow(tidy(_counted), "feature string, toxic boolean, n bigint")
    counts = counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("b"))
    a, b, share = F.col("a"), F.col("b"), n1 / (n1 + n0)
    ratio = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * share))).otherwise(0.0) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    standing = counts.where(a * n0 > b * n1).select("feature", F.round(ratio, 6).alias("r")).where(F.col("r") >= least)
    kept = [r.feature for r in standing.orderBy(F.desc("r"), "feature").limit(features).collect()]
    names = list(dict.fromkeys([*kept, *SWAPS, *sorted(NEUTRAL)]))
    ids = {f: i for i, f in enumerate(names)}
    made = texts.mapInArrow(tidy(_featured(ids, mentions)), "toxic boolean, own array<int>, before array<array<int>>, after array<array<int>>").collect()
    made.sort(key=lambda r: (r.toxic, r.own, r.before, r.after))  # sums don't depend on partitions
    y = np.array([r.toxic for r in made], float)
    each = np.where(y == 1, total[True] / n1, total[False] / n0)
    changes = [(p, q) for r in made for p, q in zip(r.before, r.after, strict=True) if p != q]
    w, bias = fit([r.own for r in made], y, changes, len(names), each, l2, swap)
    return Model(bias, {f: float(x) for f, x in zip(names, w, strict=True) if x})


def identify(docs: DataFrame, model: Model, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with one more column, from the whole of ``text`` alone; its name must be new. A null text is empty."""
    ship(docs.sparkSession)
    names = [f"_{i}" for i in range(len(docs.columns))]
    base = docs.select(F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True) if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = model.vocabulary()
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                part = big.slice(at, 1000)
                got = model.score((t.as_py() for t in part.column(0)), v)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*part.schema.names, "s"])

    schema = base.withColumn("s", F.lit(0.0)).schema
    out = base.mapInArrow(tidy(run), schema)
    return out.select(*[(F.col("text") if c == text else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)], F.col("s").alias(score))


def predict(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """``keep`` columns (doc_id by default), held_out, score and predicted of every row; learns as ``learn`` says.

    A null or empty text has the score of a text without evidence, as has one in unknown words. Rows with null or repeated
    ids are scored like all others, texts of any length as a whole, and an empty table gives an empty result. Kept columns
    that are named like a result are replaced by it.
    """
    model = learn(docs, labels, **how)
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c.lower() not in {"held_out", "score", "predicted"}]
    rows = docs.select(*keep, *[c for c in ("doc_id", "text") if c not in keep])
    score = fresh(rows, "score")
    out = identify(rows, model, score)
    return out.select(*keep, held_out().alias("held_out"), F.col(score).alias("score"), F.when(F.col(score) >= 0.5, 1).otherwise(0).alias("predicted"))
