"""Does the label depend on what a text says? Term vectors with document frequencies, and a regression over them.

The positive control of the gate: if a bag of words cannot tell the classes either, a shape score at chance means nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fitting
from .stats import auc

#: Terms are runs of two or more letters or digits, lower-cased.
TERM = r"[\p{L}\p{N}]{2,}"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def counted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, term, tf)."""
    return rows.select(*keep, F.explode(terms(F.col("text"))).alias("term")).groupBy(*keep, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, least: int = 2, most: int = 20_000) -> DataFrame:
    """(term, df, i): the terms of at least ``least`` documents, at most ``most``: the most frequent by total count, ties by
    term. ``tf`` has one row a document and term. ``i`` numbers them in the order of terms; they pass one task, bounded
    by ``most``."""
    from pyspark.sql import Window

    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least)
    return df.orderBy(F.desc("total"), "term").limit(most).select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))


def vectors(tf: DataFrame, vocab: DataFrame, n: int, key: list[str]) -> DataFrame:
    """(key, at, x): tf * (ln((1 + n) / (1 + df)) + 1) over the vocabulary, of length 1; documents without terms have no row.

    The vocabulary is broadcast: at most ``most`` terms.
    """
    raw = tf.join(F.broadcast(vocab), "term").withColumn("v", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    both = raw.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return both.select(*key, F.col("e.i").alias("at"), F.transform("e", lambda e: e["v"] / F.col("norm")).alias("x"))


def folds(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Adds fold: within each class the rows are dealt by a hash of the id, so that folds hold like shares of both classes."""
    from ..functions.rng import hashed

    return rows.withColumn("fold", (hashed(seed, F.col("positive").cast("int"), F.col("id")) % k).cast("int"))


def baseline(rows: DataFrame, scratch, k: int = 4, least: int = 2, most: int = 20_000, l2: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(fold, auc, n) of a regression on term vectors, each fold held out; and the vectors (id, positive, fold, at, x).

    ``rows`` has id, text and positive; null labels are left out, repeated ids are separate documents only if their labels
    differ. Term statistics are those of all documents, the fits those of the other folds. Vectors are written to
    ``scratch`` once, every step of all folds is one pass over them. Folds of one class have no row; if there is none at
    all, ValueError.
    """
    labelled = rows.where("positive IS NOT NULL AND id IS NOT NULL").select("id", "positive", "text")
    labelled = folds(labelled, k, seed)
    key = ["id", "positive", "fold"]
    tf = scratch.keep(counted(labelled, key), "tf")
    n = labelled.select(*key).distinct().count()
    vocab = scratch.keep(vocabulary(tf, least, most), "terms")
    made = labelled.select(*key).distinct().join(vectors(tf, vocab, n, key), key, "left")
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    width = vocab.count()
    # The last feature is the constant, which isn't regularised.
    at = F.concat(F.coalesce("at", empty[0]), F.array(F.lit(width)))
    x = F.concat(F.coalesce("x", empty[1]), F.array(F.lit(1.0)))
    made = scratch.keep(made.select(*key, F.col("positive").cast("double").alias("y"), at.alias("at"), x.alias("x")), "vectors")
    fits = fitting.fit(made, width + 1, k, l2=l2, free=width, tolerance=1e-7)
    if not fits.usable.any():
        raise ValueError("no fold has both classes to learn from")
    scored = scratch.keep(fitting.scored(made, fits, width + 1, k), "scored")
    sizes = scored.groupBy("fold").agg(F.count("*").alias("n"))
    out = auc(scored.withColumn("score", F.round("score", 9)), "score", "positive", ["fold"]).join(sizes, "fold")
    return out.select("fold", "auc", "n"), made


__all__ = ["baseline", "counted", "folds", "terms", "vectors", "vocabulary"]
