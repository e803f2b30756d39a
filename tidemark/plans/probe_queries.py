"""Queries that probe what can be learned from shape and from content, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as N
from ..operators import gate as X
from ..scratch import Scratch
from ..sources import adapters as A
from .label_queries import SURFACE_FEATURES

#: Languages of the texts, which stand for voices.
VOICES = ["de", "en", "es", "fr"]
TYPES = [c[0] for c in A.CHANNELS]


def _features():
    return T.report_shape(F.col("text"), F.col("report_type"), F.col("voice"), TYPES, VOICES)


def report_features(spark, d):
    """The ten features of every report."""
    return A.reports(spark, d).select("report_id", *[(F.round(c, 6) if k.endswith(("ratio", "len")) else c).alias(k) for k, c in _features().items()])


def _place(column: str, names: list[str]) -> str:
    return f"CASE WHEN list_position({sorted(names)}, {column}) > 0 THEN (list_position({sorted(names)}, {column}) - 1)::DOUBLE END"


REPORT_FEATURES = A.using("reports") + f""", f AS ({SURFACE_FEATURES})
 SELECT report_id, char_len, word_count, sentence_count, round(mean_sentence_len, 6) AS mean_sentence_len, round(digit_ratio, 6) AS digit_ratio, round(upper_ratio, 6) AS upper_ratio, round(punct_ratio, 6) AS punct_ratio, has_timestamp,
 {_place('report_type', TYPES)} AS report_type_id, {_place('voice', VOICES)} AS voice_id FROM reports JOIN f ON doc_id = report_id"""


def _gate_rows(spark, d):
    labels = A.table(spark, d, "labels").select(F.col("doc_id").alias("report_id"), (F.col("quality") == 1).alias("positive"))
    return A.reports(spark, d).join(labels, "report_id").select(F.col("report_id").alias("id"), "center", "positive", *[c.alias(k) for k, c in _features().items()])


def gate_result(spark, d):
    """The gate over all centers with its null: area under the curve of each center, and the verdict beside it."""
    r = X.run_gate(_gate_rows(spark, d), list(_features()), null_trials=20)
    rows = [(c, a, r.auc, r.passed, r.null_mean, r.null_p95, r.leak_is_significant) for c, a in r.per_fold.items()]
    return spark.createDataFrame(rows, "center string, auc double, mean_auc double, passed boolean, null_mean double, null_p95 double, significant boolean")


def _labelled(spark, d):
    return A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", (F.col("toxic") == 1).alias("positive"))


def content_vectors(spark, d):
    """Fold, terms and weights of every labelled document."""
    rows, key = N.folds(_labelled(spark, d), 4), ["id", "positive", "fold"]
    tf = N.counted(rows, key)
    vocab = N.vocabulary(tf)
    n = rows.select(*key).distinct().count()
    names = vocab.select(F.col("i").alias("at"), "term")
    long = N.vectors(tf, vocab, n, key).select("id", "fold", F.explode(F.arrays_zip("at", "x")).alias("e")).select("id", "fold", "e.at", "e.x")
    return long.join(F.broadcast(names), "at").select("id", "fold", "term", F.round("x", 9).alias("x"))


CONTENT_VECTORS = """WITH l AS (SELECT doc_id AS id, toxic = 1 AS positive, ('0x' || substr(md5('0:' || toxic || ':' || doc_id), 1, 8))::BIGINT % 4 AS fold, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]{2,}') AS w FROM documents JOIN labels USING (doc_id)),
 t AS (SELECT id, positive, fold, term, count(*) AS tf FROM (SELECT id, positive, fold, unnest(w) AS term FROM l) GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT id, positive FROM l)),
 v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM t GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000),
 r AS (SELECT id, fold, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM t JOIN v USING (term), n)
 SELECT id, fold::INT AS fold, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id, fold)), 9) AS x FROM r"""


def content_baseline(spark, d):
    """Held-out area under the curve of a bag of words, for toxicity."""
    out, _ = N.baseline(_labelled(spark, d), Scratch(spark, "content"))
    return out.select("fold", F.round("auc", 6).alias("auc"), "n")


QUERIES = {
    "report_features": (report_features, REPORT_FEATURES), "gate_result": (gate_result, None), "content_vectors": (content_vectors, CONTENT_VECTORS), "content_baseline": (content_baseline, None),
}
