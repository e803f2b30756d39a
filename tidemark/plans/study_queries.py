"""Queries of attribution, the shape gate, sweeps over fleets, and nested documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rng import hashed
from ..operators import attribution as B
from ..operators import gate as X
from ..operators import stats as S
from ..operators import sweeps as W
from ..sources import adapters as A
from ..sources import artifacts as D
from ..sources.adapters import using
from .label_queries import _REVIEWS, _reviews

_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def attribution_outcomes(spark, d):
    """Attributed sources, drawn two times out of three, against those that carry one of four asserted facts."""
    s = A.reports(spark, d).withColumnRenamed("event_id", "task").withColumn("asserted", F.array(*[F.lit(x) for x in T.FACTS[:4]]))
    return B.score(s, hashed("att", F.col("report_id")) % 3 != 0).select("task", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "exact_set", "outcome")


ATTRIBUTION_OUTCOMES = using("reports") + f""", s AS (SELECT event_id AS task, sens, mask, len(list_intersect(fact_ids, {T.FACTS[:4]})) > 0 AS t, {_H.format("'att:' || report_id")} % 3 <> 0 AS a FROM reports),
 g AS (SELECT task, count(*) FILTER (a AND t) AS b, count(*) FILTER (t) AS nt, count(*) FILTER (a) AS na, coalesce(max(sens) FILTER (a), 0) AS fs, coalesce(bit_or(mask) FILTER (a), 0) AS fm, coalesce(max(sens) FILTER (t), 0) AS ts, coalesce(bit_or(mask) FILTER (t), 0) AS tm FROM s GROUP BY task)
 SELECT task, round(CASE WHEN nt = 0 THEN 1 ELSE b / nt::DOUBLE END, 6) AS recall, round(CASE WHEN na = 0 THEN 1 ELSE b / na::DOUBLE END, 6) AS precision, b = nt AND b = na AS exact_set,
 CASE WHEN fs = ts AND fm = tm THEN 'exact' WHEN fs >= ts AND tm & ~fm = 0 THEN 'creep' WHEN ts >= fs AND fm & ~tm = 0 THEN 'leak' ELSE 'incomparable' END AS outcome FROM g"""


def leave_one_out(spark, d):
    """Sources without which the numbered text of a conversation loses a fact, under terms of our own."""
    c = A.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    marked = c.withColumn("texts", F.transform("texts", lambda x, i: F.concat(x, F.when(i == 0, " the draft").when(i == 1, " a pilot, a draft").otherwise(" calm"))))
    return B.leave_one_out(marked, lambda x: x).select("task", "pos", F.array_join("lost", ",").alias("lost"), "attributed")


def triage_scores(spark, d):
    """Over- and under-escalation when two facts are held to be enough, against three."""
    t = A.tasks(spark, d)
    s = B.triage_score(F.col("evidence") >= 1, F.col("evidence") >= 2)
    return t.agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in s.items()])


TRIAGE_SCORES = using("tasks") + " SELECT count(*) AS n, count(*) FILTER ((evidence >= 1) = (evidence >= 2)) AS correct, count(*) FILTER (evidence >= 1 AND evidence < 2) AS over, count(*) FILTER (evidence < 1 AND evidence >= 2) AS under FROM tasks"


def _shape_rows(spark, d):
    j = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("lang").alias("center"), F.round(T.shape(F.col("text"))["punct_ratio"], 6).alias("score"), (F.col("quality") == 1).alias("positive"))


def gate_null(spark, d):
    """Does the share of punctuation tell quality better than shuffled labels would? Twenty trials."""
    rows = _shape_rows(spark, d)
    seen = S.auc(rows, "score", "positive", ["center"]).agg(F.avg("auc").alias("auc"))
    r = X.against_null(seen, X.null_of_auc(rows, 20), 20)
    return r.select(*[F.round(c, 5).alias(c) for c in ("auc", "null_mean", "null_sd", "null_p95")], F.round("z", 2).alias("z"), "significant", "passed")


_A = "SELECT {k}center, sum(won)::DOUBLE / (sum(p)::DOUBLE * sum(n)::DOUBLE) AS auc FROM (SELECT {k}center, p, n, p * (sum(n) OVER (PARTITION BY {k}center ORDER BY score) - n + n / 2.0::DOUBLE) AS won FROM (SELECT {k}center, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM {t} GROUP BY ALL)) GROUP BY ALL HAVING sum(p) > 0 AND sum(n) > 0"
GATE_NULL = f"""WITH r AS (SELECT doc_id AS id, lang AS center, round(length(regexp_replace(text, '[^.,;:()/\\-]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id)),
 k AS (SELECT center, count(*) FILTER (positive) AS k FROM r GROUP BY 1), o AS (SELECT avg(auc) AS auc FROM ({_A.format(k='', t='r')})),
 s AS (SELECT trial, r.center, score, row_number() OVER (PARTITION BY trial, r.center ORDER BY {_H.format("'0:' || trial || ':' || id")}, id) <= k AS positive FROM r JOIN k ON r.center IS NOT DISTINCT FROM k.center CROSS JOIN range(20) t(trial)),
 n AS (SELECT trial, avg(auc) AS auc FROM ({_A.format(k='trial, ', t='s')}) GROUP BY trial), p AS (SELECT auc, row_number() OVER (ORDER BY auc) AS p FROM n), m AS (SELECT avg(auc) AS mean, stddev_samp(auc) AS sd, max(auc) FILTER (p = 19) AS p95 FROM p)
 SELECT round(auc, 5) AS auc, round(mean, 5) AS null_mean, round(sd, 5) AS null_sd, round(p95, 5) AS null_p95, round((auc - mean) / sd, 2) AS z, auc > p95 AS significant, auc BETWEEN 0.45 AND 0.55 AS passed FROM o, m"""


def gate_probes(spark, d):
    """Fitted probes, each held out by language."""
    f = T.shape(F.col("text"))
    j = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("center"), (F.col("quality") == 1).alias("positive"), *[c.alias(k) for k, c in f.items()])
    return X.probes(j, list(f), 5).select("probe", "center", F.round("auc", 3).alias("auc"))


def consensus_cliff(spark, d):
    """Accuracy of a majority of nine as more of them take two facts to be enough."""
    return W.consensus_by_wrong(W.fleet_votes(A.tasks(spark, d), 9, list(range(10)), 0.05)).select("n_wrong", F.round("accuracy", 6).alias("accuracy"), F.round("unanimous", 6).alias("unanimous"))


_CLIFF = using("tasks") + f""", v AS (SELECT c AS n_wrong, task, evidence >= 3 AS truth, (CASE WHEN w < c THEN {{}} ELSE evidence >= 3 END) <> ({_H.format("'7:' || c || ':' || w || ':' || task")} / 4294967296.0::DOUBLE < 0.05) AS verdict FROM tasks CROSS JOIN range(10) a(c) CROSS JOIN range(9) b(w)),
 t AS (SELECT n_wrong, task, count(*) FILTER (verdict) AS v, count(*) AS n, bool_or(truth) AS truth FROM v GROUP BY ALL) SELECT n_wrong::INT AS n_wrong, round(avg(((2 * v >= n) = truth)::INT), 6) AS accuracy, round(avg((v = 0 OR v = n)::INT), 6) AS unanimous FROM t GROUP BY n_wrong"""
CONSENSUS_CLIFF = _CLIFF.format("evidence >= 2")


def blind_cliff(spark, d):
    """The same with a share that doesn't see one channel."""
    return W.consensus_by_wrong(W.fleet_votes(A.tasks(spark, d), 9, list(range(10)), 0.05, blind=True)).select("n_wrong", F.round("accuracy", 6).alias("accuracy"), F.round("unanimous", 6).alias("unanimous"))


BLIND_CLIFF = _CLIFF.format("seen_evidence >= 3")


def school_fleets(spark, d):
    """How many of nine are wrong on each part when three schools are wrong as a whole."""
    return W.school_fleets(A.table(spark, d, "part").select(F.col("p_partkey").alias("draw")), 3, 9, 0.3)


SCHOOL_FLEETS = f"SELECT p_partkey AS draw, (count(*) FILTER ({_H.format(chr(39) + '7:' + chr(39) + ' || p_partkey || ' + chr(39) + ':' + chr(39) + ' || who % 3')} / 4294967296.0::DOUBLE < 0.3))::BIGINT AS wrong FROM part CROSS JOIN range(9) b(who) GROUP BY p_partkey"


def decode_stability(spark, d):
    """Parts whose repeated answers differ; an eighth of the answers don't parse."""
    l = A.table(spark, d, "lineitem")
    a = l.select(F.col("l_partkey").alias("task"), F.when(F.col("l_orderkey") % 8 != 0, F.col("l_quantity") > 2).alias("answer"))
    return W.decode_stability(a)


DECODE_STABILITY = "WITH a AS (SELECT l_partkey AS task, CASE WHEN l_orderkey % 8 <> 0 THEN l_quantity > 2 END AS answer FROM lineitem), t AS (SELECT task, count(DISTINCT coalesce(answer::VARCHAR, 'none')) AS k, count(*) FILTER (answer IS NULL) AS u FROM a GROUP BY task) SELECT count(*) AS tasks, count(*) FILTER (k > 1) AS differing, sum(u)::BIGINT AS unparsed FROM t"


def tagged_clearance(spark, d):
    """What a tag of three values gives away about levels."""
    r = W.clearance_inference(A.clearances(spark, d), F.col("analyst") % 3)
    return r.select(F.round("accuracy", 6).alias("accuracy"), "groups", F.round("prior", 6).alias("prior"))


TAGGED_CLEARANCE = using("clearances") + ", c AS (SELECT analyst % 3 AS tag, sens, count(*) AS n FROM clearances GROUP BY ALL), g AS (SELECT max(n) AS top, sum(n) AS n FROM c GROUP BY tag), p AS (SELECT sens, count(*) AS n FROM clearances GROUP BY 1) SELECT round(sum(top) / sum(n)::DOUBLE, 6) AS accuracy, count(*) AS groups, (SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM p) AS prior FROM g"


def power(spark, d):
    return W.half_width(A.trials(spark, d), 100).select(F.round("half_width", 6).alias("half_width"), F.round("detectable", 6).alias("detectable"))


POWER = using("trials") + f""", t AS (SELECT task, count(outcome) AS n, count(*) FILTER (outcome) AS wins FROM trials GROUP BY task), i AS (SELECT *, row_number() OVER (ORDER BY task) - 1 AS i FROM t), m AS (SELECT count(*) AS m FROM t),
 d AS (SELECT r.i // m AS draw, {_H.format("'7:' || r.i")} % m AS i FROM m, range(100 * (SELECT m FROM m)) r(i)), x AS (SELECT draw, sum(wins) / sum(n)::DOUBLE AS rate FROM d JOIN i USING (i) GROUP BY draw), p AS (SELECT rate, row_number() OVER (ORDER BY rate) - 1 AS p FROM x),
 e AS (SELECT max(rate) FILTER (p = 1) AS low, max(rate) FILTER (p = 97) AS high FROM p) SELECT round((high - low) / 2, 6) AS half_width, round(high - low, 6) AS detectable FROM e"""


def latent_slice(spark, d):
    """Five tasks of those that show all facts."""
    return W.latent_slice(A.tasks(spark, d).withColumn("evidence", F.col("evidence") + 1), 5).select("task")


LATENT_SLICE = using("tasks") + f" SELECT task FROM tasks WHERE evidence + 1 >= 3 ORDER BY {_H.format(chr(39) + '7:' + chr(39) + ' || task || ' + chr(39) + ':slice' + chr(39))}, task LIMIT 5"


def compare_sources(spark, d):
    """Which event types' rates differ by intervals of two standard errors."""
    e = A.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > 30).cast("double")).alias("p"))
    h = 2 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    m = e.select(F.col("event_type").alias("name"), F.col("p").alias("point"), (F.col("p") - h).alias("low"), (F.col("p") + h).alias("high"))
    return W.compare_models(m).select("a", "b", F.round("gap", 6).alias("gap"), "resolved")


COMPARE_SOURCES = """WITH e AS (SELECT event_type AS name, count(*) AS n, avg((value > 30)::INT) AS p FROM events GROUP BY 1), m AS (SELECT name, p, p - 2 * sqrt(p * (1 - p) / n) AS lo, p + 2 * sqrt(p * (1 - p) / n) AS hi FROM e)
 SELECT a.name AS a, b.name AS b, round(a.p - b.p, 6) AS gap, NOT (a.p BETWEEN b.lo AND b.hi) AND NOT (b.p BETWEEN a.lo AND a.hi) AS resolved FROM m a JOIN m b ON a.name < b.name"""


def dig_documents(spark, d):
    """Values of nested documents by path: key, index, selector, and a miss."""
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit('{"rows": [{"k": "a", "v": '), F.col("p_size").cast("string"), F.lit('}, {"k": "b", "v": '), F.col("p_partkey").cast("string"), F.lit("}]}")).alias("j"))
    g = lambda path: D.dig(F.col("j"), path).cast("long")
    return p.select("p_partkey", g("rows.0.v").alias("first"), g("rows.-1.v").alias("last"), g("rows.k=a.v").alias("picked"), g("rows.k=z.v").alias("missed"), g("rows.7.v").alias("beyond"))


DIG_DOCUMENTS = "SELECT p_partkey, p_size::BIGINT AS first, p_partkey AS last, p_size::BIGINT AS picked, NULL::BIGINT AS missed, NULL::BIGINT AS beyond FROM part"


def ledger_records(spark, d):
    """Decision records by analyst: how many, and how many distinct digests."""
    r = D.ledger(_reviews(spark, d), 7, "2024-01-01T00:00:00Z")
    return r.groupBy("analyst_id").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("digests"), F.min("record_id").alias("first"))


LEDGER_RECORDS = _REVIEWS + " SELECT analyst AS analyst_id, count(*) AS n, count(*) AS digests, min('7:' || analyst || ':' || task) AS first FROM reviews GROUP BY analyst"

QUERIES = {
    "attribution_outcomes": (attribution_outcomes, ATTRIBUTION_OUTCOMES), "leave_one_out": (leave_one_out, None), "triage_scores": (triage_scores, TRIAGE_SCORES), "gate_null": (gate_null, GATE_NULL), "gate_probes": (gate_probes, None),
    "consensus_cliff": (consensus_cliff, CONSENSUS_CLIFF), "blind_cliff": (blind_cliff, BLIND_CLIFF), "school_fleets": (school_fleets, SCHOOL_FLEETS), "decode_stability": (decode_stability, DECODE_STABILITY), "tagged_clearance": (tagged_clearance, TAGGED_CLEARANCE),
    "power": (power, POWER), "latent_slice": (latent_slice, LATENT_SLICE), "compare_sources": (compare_sources, COMPARE_SOURCES), "dig_documents": (dig_documents, DIG_DOCUMENTS), "ledger_records": (ledger_records, LEDGER_RECORDS),
}
