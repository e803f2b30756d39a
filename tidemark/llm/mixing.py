"""Mixing sources to target weights by Pareto order sampling.

A source of size S (words) and target T is taken T / S times over. Every document gets the whole part of that as certain
copies. What the target still lacks is filled by one more copy of some documents, with unequal probabilities: a document
of w words is included with p = min(1, r * w), where r is the source's rate at which the expected words are what it lacks;
those with p = 1 are certain. The others are ranked by (u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, u
from a hash of seed and id, and the sample is the beginning of that order whose words come nearest to what is lacking. So
long documents, which fill a target in few pieces, go before short ones, the size is fixed rather than random, and reruns
agree.

No window runs over a source: rates come from counts by size, x = q / (1 + q) of the rank q is cut into cells, the cells'
sizes are summed, and only the documents of the one cell in which the sample ends are put in order. Everything is a
DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import fresh, n_words, staged

CELLS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: weights repeat over the sources by code point, null last.

    Targets are share * all words by weight, but at most ``most`` times the source's size; what is cut off goes to the
    others by weight until none is above. That is one level L with target = min(most * size, weight * L), found by
    filling sources in the order of most * size / weight. A source without words has the target 0. One row a source
    goes through one task here.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    every, cap = Window.partitionBy(), F.lit(float(most)) * F.col("source_size")
    one = sizes.select("*", w.alias("_w"), cap.alias("_cap"), (F.lit(float(share)) * F.sum("source_size").over(every)).alias("_all")).withColumn("_full", F.col("_cap") / F.col("_w"))
    fill = Window.orderBy("_full", F.asc_nulls_last("source"))
    here, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(here), F.lit(0.0))) / F.sum("_w").over(after)
    two = one.withColumn("_level", F.when(level <= F.col("_full"), level))
    found = F.first("_level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return two.select(*sizes.columns, F.least(F.col("_cap"), F.coalesce(F.col("_w") * found, F.col("_cap"))).alias("target"))


def rates(sizes: DataFrame, lacks: DataFrame) -> DataFrame:
    """(source, rate): r with sum of w * min(1, r * w) = lack over the source's documents of w words.

    ``sizes`` has source, size and k, the number of documents of that size; ``lacks`` has source and lack. From the largest
    size down documents are certain until the rate that fills the rest leaves the next size below certainty.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    here = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w, k = F.col("size"), F.col("k")
    named = lacks.select(F.col("source").alias("_s"), "lack")
    rows = sizes.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_s")))
    certain = F.sum(w * k).over(down) - w * k
    rows = rows.select("source", "size", ((F.col("lack") - certain) / F.sum((w * w * k).cast("double")).over(here)).alias("rate"))
    return rows.where(F.col("rate") * w < 1).groupBy("source").agg(F.max_by("rate", "size").alias("rate"))


def inclusion(size: Column, rate: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.coalesce(rate, F.lit(1.0)) * size, F.lit(0.0)))


def rank(ident: Column, p: Column, seed: int) -> Column:
    """x = q / (1 + q) of Pareto order sampling, from 0, for what is certain, to 1, for what can't be included."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, narrow: bool = False, small: int = 50_000) -> DataFrame:
    """Adds ``copies`` (long) to every document: how often the mix takes it; its taken words are copies * size.

    Reads doc_id, text and source, other columns may have any name; ``narrow`` gives doc_id, size, source_size, target and
    copies instead. A null text has size 0, documents without words have no copies beyond the certain ones; rows that share
    a doc_id, source and size are taken or left together. No row is dropped, texts have any length, an empty table stays
    empty. Per-source figures are broadcast for at most ``small`` sources, else joined by source.
    """
    names = ["_src", "_x", "_ss", "_t", "_wh", "_r", "_up", "_w", "_b"]
    src, x, ss, t, wh, r, up, w, b = (fresh(docs, n) for n in names)
    flat = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    counts = staged(flat.groupBy("source", "size").agg(F.count("*").alias("k")), "counts")
    plan = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select("source", "source_size", "target", F.floor(ratio).alias("whole"))
    plan = staged(plan.withColumn("lack", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")
    few = plan.limit(small + 1).count() <= small
    hint = F.broadcast if few else (lambda d: d)
    rate = staged(rates(counts, plan.where("lack > 0")).select(F.col("source").alias(src), "rate"), "rates")
    join = lambda d, p: d.join(hint(p), F.col("source").cast("string").eqNullSafe(F.col(src)), "left")
    lacks = plan.where("lack > 0").join(rate, F.col("source").eqNullSafe(F.col(src)), "left").select(F.col("source").alias(src), "lack", "rate")
    # One row for all that share an id and so a rank: ties go in or out together.
    ranked = join(flat.where("size > 0"), lacks).where("lack IS NOT NULL").select("source", "size", "lack", rank(F.col("doc_id"), inclusion(F.col("size"), F.col("rate")), seed).alias(x))
    cell = F.floor(F.col(x) * CELLS).cast("int")
    cells = ranked.groupBy("source", cell.alias("cell"), "lack").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("cell")
    ends = cells.withColumn("before", F.sum("n").over(upto) - F.col("n")).where((F.col("before") <= F.col("lack")) & (F.col("before") + F.col("n") >= F.col("lack")))
    ends = ends.groupBy("source").agg(F.min_by(F.struct("cell", "before", "lack"), "cell").alias("end")).select(F.col("source").alias(src), "end.*")
    last = join(ranked.drop("lack"), ends).where(cell == F.col("cell")).groupBy(src, "cell", "before", "lack", x).agg(F.sum("size").alias("n"))
    run = F.col("before") + F.sum("n").over(Window.partitionBy(src).orderBy(x))
    cut = last.select(src, x, "before", (run - F.col("lack")).alias("over"), "lack")
    # The last x that is taken: nearest to what lacks, unless stopping before the cell's first one is nearer still.
    cut = cut.groupBy(src).agg(F.min_by(F.struct(x, F.abs("over").alias("off")), F.struct(F.abs("over"), F.col(x))).alias("best"), F.min(x).alias("first"), F.min(F.abs(F.col("lack") - F.col("before"))).alias("stop"))
    cut = cut.select(F.col(src).alias(b), F.when(F.col("stop") <= F.col("best.off"), F.col("first") - F.lit(1e-12)).otherwise(F.col(f"best.{x}")).alias(up))
    per = plan.join(rate, F.col("source").eqNullSafe(F.col(src)), "left").select(F.col("source").alias(src), F.col("source_size").alias(ss), F.col("target").alias(t), F.col("whole").alias(wh), F.col("rate").alias(r))
    final = staged(per.join(cut, F.col(src).eqNullSafe(F.col(b)), "left").drop(b), "cuts")
    size = F.col("size") if narrow else F.col(w)
    base = flat if narrow else docs.withColumn(w, n_words(F.col("text")))
    out = base.join(hint(final), F.col("source").cast("string").eqNullSafe(F.col(src)), "left")
    more = F.when((size > 0) & (rank(F.col("doc_id"), inclusion(size, F.col(r)), seed) <= F.col(up)), F.lit(1)).otherwise(F.lit(0))
    copies = (F.col(wh) + more).cast("long").alias(fresh(docs, "copies"))
    if narrow:
        return out.select("doc_id", "size", F.col(ss).alias("source_size"), F.col(t).alias("target"), copies)
    return out.select(*docs.columns, copies)
