from pyspark.sql import functions as F

from tidemark.llm import quality


def rated(spark, rows):
    """Good documents have no symbols, bad ones have; few_words is random and rejects good and bad alike."""
    df = spark.createDataFrame(rows, "lang string, ok boolean, n int").select("lang", "ok", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    noise = (F.xxhash64("lang", "ok", "i") % 1000).cast("double")
    return df.select("lang", "ok", F.when(F.col("ok"), 0.0).otherwise(0.3).alias("symbol_share"), noise.alias("few_words"), *[F.lit(0.0).alias(r) for r in quality.RULES if r not in ("symbol_share", "few_words")])


def test_union_is_certified_at_one_alpha(spark):
    # ln(0.05 / 2) / ln(0.99) is 367.04: two tests, of the language and the pool.
    df = rated(spark, [("en", True, 368), ("en", False, 40)])
    cuts = {c.rule: c for c in quality.certified_cutoffs(df, df, "lang", "ok").collect()}
    assert (cuts["symbol_share"].false_rejections, cuts["symbol_share"].caught, cuts["symbol_share"].n_good) == (0, 40, 368)
    out = quality.apply_rules(df.withColumn("base_failed", F.lit(False)), quality.certified_cutoffs(df, df, "lang", "ok"), "lang")
    assert out.where("ok AND NOT kept").count() == 0 and out.where("NOT ok AND kept").count() == 0
    df = rated(spark, [("en", True, 367), ("en", False, 40)])
    assert quality.certified_cutoffs(df, df, "lang", "ok").collect() == []


def test_small_strata_take_the_pool_where_their_own_labels_agree(spark):
    # Good labels in de look like bad ones elsewhere, it has no bad ones; es is too small alone.
    df = rated(spark, [("en", True, 900), ("en", False, 90), ("es", True, 60), ("es", False, 9), (None, True, 20), (None, False, 3), ("de", True, 5)])
    df = df.withColumn("symbol_share", F.when(F.col("lang") == "de", 0.3).otherwise(F.col("symbol_share")))
    cuts = quality.certified_cutoffs(df, df, "lang", "ok").where("rule = 'symbol_share'").collect()
    assert {(c.stratum, c.n_good, c.false_rejections, c.n_bad, c.caught) for c in cuts} == {("en", 900, 0, 90, 90)}  # five of 985 are too many
    df = df.where("lang IS NULL OR lang <> 'de'").unionByName(df.where("lang = 'de'").limit(1))
    cuts = quality.certified_cutoffs(df, df, "lang", "ok").where("rule = 'symbol_share'").collect()
    assert {(c.stratum, c.n_good, c.false_rejections, c.n_bad, c.caught) for c in cuts} == {("en", 900, 0, 90, 90), ("es", 60, 0, 9, 9), (None, 20, 0, 3, 3)}
