"""Quality rules whose cutoffs come with a guarantee on how many good documents they reject.

Each rule is a number that is larger for worse documents. A rule rejects what lies above a cutoff. Labelled documents
are the holdout, and what is certified is the union of the rules. The cutoffs of all rules of a stratum are put in one
order without looking at good labels: first those which set bad documents apart most clearly from all documents, within a
rule the mildest first. They are added to the union one by one, and it is certified while the exact
binomial test shows that the share of good documents it rejects is below ``alpha``. The first that fails ends the
sequence, so trying many costs nothing; over strata and the pool the level ``delta`` is divided (Bonferroni). With
probability 1 - delta every stratum then loses at most ``alpha`` of its good documents to all rules together. Among
certified cutoffs a rule takes the one that rejects most bad documents, provided that most of the labelled documents
which it rejects are bad; otherwise it rejects nothing. Both only make the union smaller.

A stratum with so few good labels that not even a union without false rejections could be certified takes the cutoffs of
the pool, which is certified in the same way on all strata together: ``alpha`` then holds for documents of all strata
together, not for that stratum alone. It takes a pooled cutoff only if most of its own labelled documents above it are
bad, so a stratum without bad labels rejects nothing.

Everything is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import SPACE_RUN, fresh, staged, words

#: Shares of the unlabelled documents that candidate cutoffs leave below them, mildest first.
GRID = [0.9995, 0.999, 0.998, 0.996, 0.994, 0.992, 0.99, 0.985, 0.98, 0.97, 0.96, 0.95, 0.94, 0.92, 0.9, 0.87, 0.84, 0.8]
RULES = ["symbol_share", "dup_line_share", "repeat_share", "long_words", "short_words", "few_words"]
WINDOW = 8


def rolled(df: DataFrame, name: str, spans: tuple[int, ...], mix) -> DataFrame:
    """Doubles the reach of the array ``name`` by each of ``spans``; every step is a column of its own, evaluated once.

    Each element becomes ``mix`` of itself and the element that is ``span`` places later; the last ones, whose partner
    is missing, are left for the caller to cut off.
    """
    for k in spans:
        later = F.slice(name, F.lit(k + 1), F.greatest(F.size(name) - k, F.lit(0)))
        df = df.withColumn(name, F.zip_with(F.col(name), later, mix))
    return df


def _covered(grams: Column) -> Column:
    m = F.size(grams) - 1
    placed = F.array_sort(F.zip_with(grams, F.sequence(F.lit(0), m), lambda g, p: F.struct(g.alias("g"), p.alias("p"))))
    return F.transform(
        F.array(placed),
        lambda s: F.aggregate(
            F.array_sort(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"]))),
                            lambda x: x.isNotNull(),
                        )
                    )
                )
            ),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        ),
    )[0]


def text_measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed of each whole text.

    A null or blank text has zeros throughout and fails. ``keep`` names the columns that stay (all by default); columns
    that are already named like a measure are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # A line may hold other separators than \n, so blank means without a word.
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = keep if keep is not None else docs.columns
    w, g, ln = fresh(docs, "_w"), fresh(docs, "_g"), fresh(docs, "_l")
    stay = [c for c in kept if c.lower() not in {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"}]
    one = docs.select(*stay, F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias(ln), words(F.col(text)).alias(w))
    two = one.select(*stay, F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "n_symbols", F.size(ln).cast("long").alias("n_lines"), (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"), F.size(w).cast("long").alias("n_words"), F.transform(w, lambda x: F.xxhash64(x)).alias(w))
    three = rolled(two, w, (1, 2, 4), lambda a, b: F.xxhash64(a, b))
    three = three.withColumn(g, F.slice(w, F.lit(1), F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0)))).drop(w)
    four = three.withColumn("n_repeat_words", F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(F.col(g))).cast("long")).drop(g)
    return four.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def add_rules(measured: DataFrame) -> DataFrame:
    """Adds each of RULES, larger for worse."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return measured.select(
        "*", share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("long_words"), (-share("word_chars", "n_words")).alias("short_words"), (-F.col("n_words").cast("double")).alias("few_words"),
    )


def _log_gamma(x: Column) -> Column:
    """Of x >= 1: the recurrence up by eight, then Stirling's series."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of X binomial in n and p, exact but for terms that are below 1e-15 of the largest.

    Terms are summed from k downwards over 40 standard deviations, where they have long vanished. If k is above the mean
    the value is 1: no test is won there.
    """
    k, n = k.cast("double"), n.cast("double")
    reach = F.least(k, F.ceil(40 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * float(__import__("math").log(p)) + (n - k) * float(__import__("math").log1p(-p)))
    total = F.aggregate(
        F.sequence(F.lit(0), reach),
        F.struct(top.alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when((k < 0) | (n <= 0) | (k > n * p), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def certified_cutoffs(rated: DataFrame, holdout: DataFrame, stratum: str, good: str, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row a stratum and rule that has a cutoff: stratum, rule, cutoff, n_good, false_rejections, n_bad, caught.

    ``rated`` gives the candidate cutoffs (quantiles over all its documents), ``holdout`` is labelled by the boolean
    ``good``; a null stratum is one of its own. Counts are those of the stratum, with pooled cutoffs too. Without labels,
    or with too few for the level even in the pool, there are no rows.
    """
    # The key is "*" for the pool, "" for the null stratum and "=" with the name for others.
    own = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    keyed = lambda df: df.select(F.explode(F.array(own, F.lit("*"))).alias("key"), *[c for c in df.columns if c in RULES or c == good])
    values = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])
    grid = keyed(rated).groupBy("key").agg(*[F.percentile_approx(r, F.array(*map(F.lit, GRID)), 20000).alias(r) for r in RULES])
    # What lies above a cutoff is at most the share above the first quantile that has its value.
    share = lambda r, c: F.get(F.array(*[F.lit(1 - q) for q in GRID]), (F.array_position(r, c) - 1).cast("int"))
    candidates = lambda r: F.transform(F.array_distinct(r), lambda c, i: F.struct(i.alias("step"), c.alias("cutoff"), share(F.col(r), c).alias("share")))
    cuts = F.array(*[F.struct(F.lit(r).alias("rule"), candidates(r).alias("cuts")) for r in RULES])
    grid = grid.select("key", F.explode(cuts).alias("x")).select("key", "x.rule", F.explode("x.cuts").alias("c")).select("key", "rule", "c.*")
    held = staged(keyed(holdout.where(F.col(good).isNotNull())), "held")
    sizes = held.groupBy("key").agg(F.sum(F.col(good).cast("long")).alias("n_good"), F.sum((~F.col(good)).cast("long")).alias("n_bad"))
    # One test for each stratum and one for the pool.
    level = delta / F.greatest(held.select(F.count_distinct("key")).scalar(), F.lit(1))
    above = (
        held.select("key", good, F.explode(values).alias("x")).join(grid.select("key", F.col("rule"), "step", "cutoff"), "key").where((F.col("x.rule") == F.col("rule")) & (F.col("x.v") > F.col("cutoff")))
        .groupBy("key", "rule", "step").agg(F.sum(F.col(good).cast("long")).alias("false_rejections"), F.sum((~F.col(good)).cast("long")).alias("caught"))
    )
    tried = grid.join(sizes, "key").join(above, ["key", "rule", "step"], "left").fillna(0, ["false_rejections", "caught"])
    # Poisson deviance of the bad documents caught from as many as among all documents. A milder cutoff is part of every
    # stricter one, so it is as urgent as the most urgent of those.
    hoped = F.col("n_bad") * F.col("share")
    deviance = F.when(F.col("caught") > hoped, F.col("caught") * F.log(F.col("caught") / hoped) - F.col("caught") + hoped).otherwise(0.0)
    urgent = F.max(F.round(deviance, 9)).over(Window.partitionBy("key", "rule").orderBy("step").rowsBetween(0, Window.unboundedFollowing))
    tried = tried.withColumn("urgent", urgent)
    tried = staged(tried.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("urgent"), "step", "rule"))), "tried")
    # The place at which the union first rejects each good document.
    path = tried.groupBy("key").agg(F.collect_list(F.struct("rule", "cutoff", "place")).alias("path"))
    beyond = lambda r: F.filter("path", lambda c: (c["rule"] == r) & (F.col(r) > c["cutoff"]))
    hits = F.array_min(F.flatten(F.array(*[F.transform(beyond(r), lambda c: c["place"]) for r in RULES])))
    lost = held.where(good).join(path, "key").select("key", hits.alias("place")).where("place IS NOT NULL").groupBy("key", "place").agg(F.count("*").alias("lost"))
    order = Window.partitionBy("key").orderBy("place")
    union = tried.join(lost, ["key", "place"], "left").withColumn("lost", F.sum(F.coalesce("lost", F.lit(0))).over(order))
    p = binomial_tail(F.col("lost"), F.col("n_good"), alpha)
    sure = union.withColumn("sure", F.min((p <= level).cast("int")).over(order)).where("sure = 1")
    counts = ["n_good", "false_rejections", "n_bad", "caught"]
    large = sure.where("key <> '*'").select("key", "rule", "step", "cutoff", *counts)
    # Strata that could not be certified whatever their labels say.
    small = sizes.where(F.col("key") != "*").where(F.pow(F.lit(1 - alpha), F.col("n_good")) > level)
    pool = sure.where("key = '*'").groupBy().agg(F.collect_list(F.struct("rule", "step", "cutoff")).alias("pool"))
    pooled = (
        held.join(F.broadcast(small), "key").select("key", good, "n_good", "n_bad", F.explode(values).alias("x")).join(F.broadcast(pool)).select("key", good, "n_good", "n_bad", "x", F.explode("pool").alias("c"))
        .where((F.col("x.rule") == F.col("c.rule")) & (F.col("x.v") > F.col("c.cutoff")))
        .groupBy("key", "c.rule", "c.step", "c.cutoff").agg(F.first("n_good").alias("n_good"), F.sum(F.col(good).cast("long")).alias("false_rejections"), F.first("n_bad").alias("n_bad"), F.sum((~F.col(good)).cast("long")).alias("caught"))
    )
    best = Window.partitionBy("key", "rule").orderBy(F.desc("caught"), "step")
    ok = large.unionByName(pooled).where("caught > false_rejections").withColumn("n", F.row_number().over(best)).where("n = 1")
    return ok.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("stratum"), "rule", "cutoff", *counts)


def apply_rules(rated: DataFrame, cutoffs: DataFrame, stratum: str, max_strata: int = 50_000) -> DataFrame:
    """Adds ``kept``: not base_failed, and no rule of the document's stratum has its cutoff exceeded.

    The cutoffs are broadcast when there are at most ``max_strata`` strata, else joined by stratum.
    """
    s2, cuts = fresh(rated, "_s2"), fresh(rated, "_cuts")
    per = staged(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(cuts)).withColumnRenamed("stratum", s2), "cutoffs")
    small = per.limit(max_strata + 1).count() <= max_strata
    joined = rated.join(F.broadcast(per) if small else per, F.col(stratum).cast("string").eqNullSafe(F.col(s2)), "left")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(r) > F.col(cuts)[r], F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop(s2, cuts)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: list[str] | None = None, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The measures, rules and verdict of every document; ``docs`` has doc_id, text and the stratum's column.

    A document with several labels counts once, as bad if any of them is 0; null ids and null labels count as no label.
    Null, empty and blank texts fail the base, texts of any length are measured as a whole, repeated rows are judged alike,
    and an empty table gives an empty result. Of ``keep``, columns that are named like a result are replaced by it.
    """
    keep = keep if keep is not None else ["doc_id", stratum]
    keep = [c for c in keep if c.lower() not in {*RULES, "kept"}]
    rated = staged(add_rules(text_measures(docs, keep=keep)), "quality")
    return apply_rules(rated, learn_cutoffs(rated, labels, stratum, alpha, delta), stratum)


def learn_cutoffs(rated: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs from rated documents (doc_id, the stratum's column, measures and rules) and their labels."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("_good"))
    sound = rated.where(~F.col("base_failed"))
    held = sound.select("doc_id", stratum, *RULES).dropDuplicates(["doc_id"]).join(marks, "doc_id")
    return certified_cutoffs(sound, held, stratum, "_good", alpha, delta)


__all__ = ["GRID", "RULES", "SPACE_RUN", "add_rules", "apply_rules", "binomial_tail", "certified_cutoffs", "judge", "learn_cutoffs", "text_measures"]
