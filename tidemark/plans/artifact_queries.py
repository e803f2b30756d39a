"""Queries over slices, prefixes, claims, artifacts, ledgers and proposals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.rng import uniform
from ..functions.text import PATTERN
from ..operators import examples as X
from ..operators import linkage as K
from ..operators import prefixes as P
from ..operators import slices as Z
from ..operators import stats as S
from ..operators import sweeps as W
from ..scratch import Scratch
from ..sources import adapters as A
from ..sources import artifacts as D
from ..sources import claims as C
from ..sources import grids as G
from ..sources import ledgers as E
from ..sources import proposals as Q
from ..sources.adapters import using
from .fleet_queries import LINK_JACCARD
from .study_queries import _REVIEWS, _reviews

_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SIZES = (3, 8)


def balanced_slice(spark, d):
    """Slices of tasks that show one fact: which draw was the first balanced one, and what it took."""
    out = None
    for size in SIZES:
        s = Z.balanced_slice(A.reports(spark, d), PATTERN, size, need=1)
        told = s.tasks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "fact"))), lambda x: F.concat_ws(":", x["task"].cast("string"), x["fact"])), ",").alias("tasks"))
        row = told.select(F.lit(size).alias("size"), F.lit(s.rejected).cast("long").alias("rejected"), F.lit(s.eligible).cast("long").alias("eligible"), F.lit(s.worst_gap).alias("gap"), F.lit(s.percentile).alias("percentile"), "tasks")
        out = row if out is None else out.unionByName(row)
    return out


_GAPS = "greatest(" + ", ".join(f"abs(sum((mask & {b} > 0)::INT) / size - (any_value(t{b}) - sum((mask & {b} > 0)::INT)) / (any_value(n) - size))" for b in Z.BITS) + ")"
_SLICES = using("tasks") + f""", s AS (SELECT event_id AS task, list_sort(list_intersect(list_distinct(flatten(list(fact_ids))), {PATTERN})) AS shown, bit_or(mask) AS mask FROM reports GROUP BY event_id),
 pool AS (SELECT * FROM s WHERE len(shown) = 1), tot AS (SELECT count(*) AS n, {", ".join(f"sum((mask & {b} > 0)::INT) AS t{b}" for b in Z.BITS)} FROM pool), z AS (SELECT unnest({list(SIZES)}) AS size),
 dr AS (SELECT * FROM (SELECT size, draw, task, shown, mask, row_number() OVER (PARTITION BY size, draw ORDER BY {_H.format("(7 + draw * 1009) || ':' || task")}, task) AS p FROM pool, z, range(50) a(draw)) WHERE p <= size),
 nu AS (SELECT * FROM (SELECT size, draw, task, mask, row_number() OVER (PARTITION BY size, draw ORDER BY {_H.format("'7:null:' || draw || ':' || task")}, task) AS p FROM pool, z, range(2000) a(draw)) WHERE p <= size),
 gd AS (SELECT size, draw, round({_GAPS}, 9) AS gap FROM dr, tot GROUP BY size, draw), gn AS (SELECT size, draw, round({_GAPS}, 9) AS gap FROM nu, tot GROUP BY size, draw),
 pc AS (SELECT gd.size, gd.draw, gd.gap, count(*) FILTER (gn.gap <= gd.gap) / 2000.0::DOUBLE AS percentile FROM gd JOIN gn USING (size) GROUP BY ALL),
 tk AS (SELECT size, min(draw) AS draw FROM pc WHERE percentile <= 0.99 GROUP BY size)"""
BALANCED_SLICE = _SLICES + f""", l AS (SELECT size, string_agg(task || ':' || shown[1], ',' ORDER BY task) AS tasks FROM dr JOIN tk USING (size, draw) GROUP BY size)
 SELECT size::INT AS size, draw AS rejected, (SELECT n FROM tot) AS eligible, gap, percentile, tasks FROM tk JOIN pc USING (size, draw) JOIN l USING (size)"""


def latent_cliff(spark, d):
    """Accuracy of a majority of nine of whom some distrust the reports of a slice that no channel names."""
    taken = Z.balanced_slice(A.reports(spark, d), PATTERN, SIZES[1], need=1)
    tasks = Z.without_slice(A.tasks(spark, d), taken)
    cells = W.consensus_by_wrong(W.fleet_votes(tasks, 9, list(range(10)), 0.05, blind=True, need=1))
    return cells.select("n_wrong", F.round("accuracy", 6).alias("accuracy"), F.round("unanimous", 6).alias("unanimous"))


LATENT_CLIFF = _SLICES + f""", lost AS (SELECT task, 1 AS lost FROM dr JOIN tk USING (size, draw) WHERE size = {SIZES[1]}),
 v AS (SELECT c AS n_wrong, task, evidence >= 1 AS truth, (CASE WHEN w < c THEN evidence - coalesce(lost, 0) >= 1 ELSE evidence >= 1 END) <> ({_H.format("'7:' || c || ':' || w || ':' || task")} / 4294967296.0::DOUBLE < 0.05) AS verdict FROM tasks LEFT JOIN lost USING (task) CROSS JOIN range(10) a(c) CROSS JOIN range(9) b(w)),
 t AS (SELECT n_wrong, task, count(*) FILTER (verdict) AS v, count(*) AS n, bool_or(truth) AS truth FROM v GROUP BY ALL)
 SELECT n_wrong::INT AS n_wrong, round(avg(((2 * v >= n) = truth)::INT), 6) AS accuracy, round(avg((v = 0 OR v = n)::INT), 6) AS unanimous FROM t GROUP BY n_wrong"""

PREFIXES = [1, 2, 5, 10, 20, 40, 80, 150, 200, 400, 1000, 4000, 20000]


def saturation(spark, d):
    """What clearances can be told apart by, over nested prefixes of the parts, and from which on nothing changes."""
    return P.saturates(P.structures(A.part_tasks(spark, d), PREFIXES))


SATURATION = using("part_tasks") + f""", o AS (SELECT task, mask AS cell, row_number() OVER (ORDER BY task) AS pos FROM part_tasks), k AS (SELECT size FROM (SELECT unnest({PREFIXES}) AS size) WHERE size <= (SELECT count(*) FROM o)),
 c AS (SELECT s AS c_sens, m AS c_mask FROM range(4) a(s), range(16) b(m)),
 r AS (SELECT size, c_sens, c_mask, list_sort(list_distinct(list(cell) FILTER (cell & ~c_mask = 0))) AS cells FROM k CROSS JOIN c JOIN o ON pos <= size GROUP BY ALL),
 e AS (SELECT size, coalesce(cells, []) AS cells, count(DISTINCT c_mask) AS n FROM r GROUP BY ALL), g AS (SELECT size, count(*) AS distinct_sets, count(*) FILTER (n = 1) AS unique_sets, max(n) AS largest FROM e GROUP BY size),
 l AS (SELECT size, count(DISTINCT cell) AS labels FROM k JOIN o ON pos <= size GROUP BY size), f AS (SELECT * FROM g JOIN l USING (size)),
 m AS (SELECT * FROM f WHERE size = (SELECT max(size) FROM f)), w AS (SELECT f.*, f.labels = m.labels AND f.distinct_sets = m.distinct_sets AND f.unique_sets = m.unique_sets AND f.largest = m.largest AS same FROM f, m)
 SELECT size::INT AS size, labels, distinct_sets, unique_sets, largest, bool_and(same) OVER (ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS settled FROM w"""

EVENT_CLAIMS = [
    ("counted", "closes", "times", "k", None), ("counted", "closes", "as a decimal", "k", "%.2f"), ("explained", "open", "why", "k.reason", None), ("partly", "bounded", "times", "k", None), ("partly", "bounded", "of", "total", None),
]


def event_claims(spark, d):
    """Readings of claims in the JSON of every event."""
    docs = A.table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("body"))
    read = C.readings(spark.createDataFrame(EVENT_CLAIMS, C.CLAIM), docs, Scratch(spark, "claims"))
    return read.select("doc", "claim", "label", "value")


EVENT_CLAIMS_SQL = """WITH e AS (SELECT event_id AS doc, json_extract_string(props, '$.k') AS k FROM events)
 SELECT doc, claim, label, CASE kind WHEN 1 THEN k WHEN 2 THEN printf('%.2f', k::DOUBLE) END AS value FROM e CROSS JOIN (VALUES ('counted', 'times', 1), ('counted', 'as a decimal', 2), ('explained', 'why', 0), ('partly', 'times', 1), ('partly', 'of', 0)) c(claim, label, kind)"""


def event_argument(spark, d):
    """How many events carry which claims, by verdict, and which claims lack figures."""
    docs = A.table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("body"))
    read = C.readings(spark.createDataFrame(EVENT_CLAIMS, C.CLAIM), docs, Scratch(spark, "argument"))
    out = C.argument(C.payloads(read)).withColumn("unmeasured", F.array_join("unmeasured", ","))
    return out.groupBy("closes", "bounded", "open", "unmeasured").agg(F.count("*").alias("events"))


EVENT_ARGUMENT = "SELECT 1::BIGINT AS closes, 1::BIGINT AS bounded, 1::BIGINT AS open, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'counted,explained,partly' ELSE 'explained,partly' END AS unmeasured, count(*) AS events FROM events GROUP BY ALL"

TURN_CLAIMS = [("length", "closes", "n", "rows.k=n.v", None), ("role", "closes", "last", "rows.-1.v", None), ("role", "closes", "first", "rows.0.k", None), ("far", "open", "beyond", "rows.7.v", None), ("deep", "bounded", "list", "rows.1.more.at", None)]


def turn_claims(spark, d):
    """Readings by selector, by index from either end and below lists, in a nested document of every turn."""
    t = A.table(spark, d, "conversations")
    rows = F.array(F.struct(F.lit("n").alias("k"), F.length("text").cast("string").alias("v"), F.lit(None).cast("struct<at:bigint>").alias("more")), F.struct(F.lit("role").alias("k"), F.col("role").alias("v"), F.struct(F.col("turn").alias("at")).alias("more")))
    docs = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc"), F.to_json(F.struct(rows.alias("rows"))).alias("body"))
    return C.readings(spark.createDataFrame(TURN_CLAIMS, C.CLAIM), docs, Scratch(spark, "turn-claims")).select("doc", "claim", "label", "value")


TURN_CLAIMS_SQL = """SELECT conv_id || ':' || turn AS doc, claim, label, CASE kind WHEN 1 THEN length(text)::VARCHAR WHEN 2 THEN role WHEN 3 THEN 'n' WHEN 5 THEN turn::VARCHAR END AS value FROM conversations
 CROSS JOIN (VALUES ('length', 'n', 1), ('role', 'last', 2), ('role', 'first', 3), ('far', 'beyond', 4), ('deep', 'list', 5)) c(claim, label, kind)"""


def _write_artifacts(spark, d, scratch):
    """Figures of conversations, a JSON document for each grid cell and its replicate, in a folder of the call's own."""
    t, s = 1 + F.col("conv_id") % 3, F.element_at(F.array(F.lit("0.0"), F.lit("0.15"), F.lit("0.3")), (F.floor(F.col("conv_id") / 3) % 3 + 1).cast("int"))
    rows = A.table(spark, d, "conversations").select("turn", (F.length("text") > 100 * t).alias("long"), (F.col("role") == "assistant").alias("truth"), t.cast("int").alias("t"), s.alias("s"))
    rows = rows.withColumn("which", F.explode(F.array(F.lit("grid"), F.lit("named")))).where("which = 'grid' OR turn % 2 = 0")
    same = lambda a, b: F.avg((F.col(a) == F.col(b)).cast("double"))
    by = rows.groupBy("which", "t", "s").agg(same("long", "truth").alias("accuracy"), F.avg(F.when(F.col("truth"), F.col("long").cast("double"))).alias("recall"), F.avg(F.col("long").cast("double")).alias("share"), F.count("*").alias("n"))
    doc = F.struct(
        F.struct(F.col("which").alias("reviewer"), F.col("t").alias("escalation_threshold"), F.col("s").cast("double").alias("slip_rate"), F.lit(0.75).alias("train_target_agreement")).alias("teacher"),
        F.struct("accuracy", "recall", F.lit(0).alias("unparsed"), F.struct((F.col("n") >= 5).alias("quotable")).alias("validity")).alias("adapter"), F.struct(F.col("share").alias("accuracy")).alias("adapter_vs_teacher"),
        F.create_map(F.lit("rank"), F.lit("8")).alias("hyperparameters"), F.struct(F.lit(10).alias("n_train"), F.lit(5).alias("n_eval"), F.when((F.col("which") == "named") & (F.col("t") == 3), 2).otherwise(1).alias("eval_seed"), F.lit(False).alias("cross_corpus")).alias("data"),
    )
    name = F.when(F.col("which") == "grid", F.concat(F.lit("review_adapter-t"), F.col("t").cast("string"), F.lit("s"), F.col("s"))).otherwise(F.concat(F.lit("named-"), F.col("t").cast("string"), F.lit("-"), F.col("s")))
    folder = f"{scratch.root}/artifacts"
    by.select(name.alias("artifact"), F.to_json(doc).alias("value")).write.partitionBy("artifact").text(folder)
    return folder


def artifact_grid(spark, d):
    """The grid read back from a folder of JSON documents, parameters from their names."""
    scratch = Scratch(spark, "grid")
    rows = G.grid(G.artifacts(spark, _write_artifacts(spark, d, scratch)))
    out = rows.select("threshold", "slip_rate", "reviewer", F.round("adapter_agrees_with_world", 6).alias("world"), F.round("adapter_recall", 6).alias("recall"), F.round("adapter_agrees_with_teacher", 6).alias("teacher"), "quotable")
    return scratch.finish(out)


_CELLS = """WITH r AS (SELECT turn, length(text) > 100 * (1 + conv_id % 3) AS long, role = 'assistant' AS truth, 1 + conv_id % 3 AS t, ['0.0', '0.15', '0.3'][1 + (conv_id // 3) % 3] AS s FROM conversations),
 w AS (SELECT *, 'grid' AS which FROM r UNION ALL SELECT *, 'named' FROM r WHERE turn % 2 = 0),
 c AS (SELECT which, t, s, avg((long = truth)::INT) AS accuracy, avg(long::INT) FILTER (truth) AS recall, avg(long::INT) AS share, count(*) AS n FROM w GROUP BY ALL)"""
ARTIFACT_GRID = _CELLS + " SELECT t::INT AS threshold, s::DOUBLE AS slip_rate, which AS reviewer, round(accuracy, 6) AS world, round(recall, 6) AS recall, round(share, 6) AS teacher, n >= 5 AS quotable FROM c WHERE which = 'grid'"


def artifact_twins(spark, d):
    """Replicates beside their grid cell; those of one threshold were judged on other data, which the names don't tell."""
    scratch = Scratch(spark, "twins")
    found = G.artifacts(spark, _write_artifacts(spark, d, scratch))
    pairs = spark.createDataFrame([(f"named-{t}-{s}", f"review_adapter-t{t}s{s}") for t in (1, 2, 3) for s in ("0.0", "0.15", "0.3")], "named string, grid string")
    out = G.twins(found, pairs).select("named", F.array_join("mismatches", ",").alias("mismatches"), "slip_rate", "targets_identical", F.round("delta_vs_world", 6).alias("delta_vs_world"), F.round("delta_vs_teacher", 6).alias("delta_vs_teacher"))
    return scratch.finish(out)


ARTIFACT_TWINS = _CELLS + """ SELECT 'named-' || t || '-' || s AS named, CASE WHEN t = 3 THEN 'data' ELSE '' END AS mismatches, s::DOUBLE AS slip_rate, true AS targets_identical, round(abs(a.accuracy - b.accuracy), 6) AS delta_vs_world, round(abs(a.share - b.share), 6) AS delta_vs_teacher
 FROM c a JOIN c b USING (t, s) WHERE a.which = 'named' AND b.which = 'grid'"""


def ledger_batches(spark, d):
    """A ledger after three writes: records of even tasks, then all, then all again under the same number."""
    scratch = Scratch(spark, "ledger")
    records = scratch.keep(D.ledger(_reviews(spark, d), 7, "2024-01-01T00:00:00Z"), "records")
    path = f"{scratch.root}/ledger"
    E.append(records.where("CAST(task_id AS bigint) % 2 = 0"), path, 0)
    E.append(records, path, 1)
    E.append(records, path, 1)
    held = E.read(spark, path, records.schema)
    return scratch.finish(held.groupBy("batch", "analyst_id").agg(F.count("*").alias("records"), F.count_distinct("record_id").alias("ids")))


LEDGER_BATCHES = _REVIEWS + " SELECT task % 2 AS batch, analyst AS analyst_id, count(*) AS records, count(*) AS ids FROM reviews GROUP BY ALL"


def _proposals(spark, d):
    """Two rounds of verdicts on labelled documents, some without a verdict, of no task, or measured on another truth."""
    reports = A.reports(spark, d).select("report_id", "sens", "mask", (F.length("text") > 1000).alias("long"))
    tasks = reports.select(F.col("report_id").alias("task"), F.col("long").alias("truth"), "sens", "mask")
    both = A.table(spark, d, "labels").select("doc_id", "quality").join(reports, F.col("doc_id") == F.col("report_id")).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    i = F.col("doc_id")
    task = F.when(i % 13 == 0, i + 10**9).otherwise(i)
    truth = F.when((i % 11 == 0) & (F.col("seq") == 1), ~F.col("long")).otherwise(F.col("long"))
    verdict = F.when((i % 7 != 0) | (F.col("seq") == 0), (F.col("quality") == 1) != (uniform("say", i, F.col("seq")) < 0.2))
    return both.select(task.alias("task"), "seq", truth.alias("truth"), verdict.alias("verdict")), tasks


_PROPOSALS = using("reports") + f""", t AS (SELECT report_id AS task, length(text) > 1000 AS truth, mask FROM reports), b AS (SELECT doc_id AS i, quality, truth AS long, seq FROM labels JOIN t ON task = doc_id CROSS JOIN range(2) r(seq)),
 p AS (SELECT CASE WHEN i % 13 = 0 THEN i + 1000000000 ELSE i END AS task, seq, CASE WHEN i % 11 = 0 AND seq = 1 THEN NOT long ELSE long END AS truth, CASE WHEN i % 7 <> 0 OR seq = 0 THEN (quality = 1) <> ({_H.format("'say:' || i || ':' || seq")} / 4294967296.0::DOUBLE < 0.2) END AS verdict FROM b),
 j AS (SELECT p.*, t.mask, t.task IS NULL AS a, p.truth IS DISTINCT FROM t.truth AS b, verdict IS NULL AS c FROM p LEFT JOIN t USING (task)),
 m AS (SELECT *, CASE WHEN a THEN 'unknown_task' WHEN b THEN 'truth_differs' WHEN c THEN 'unparsed' WHEN seq < max(seq) FILTER (NOT a AND NOT b AND NOT c) OVER (PARTITION BY task) THEN 'superseded' END AS reason FROM j)"""


def accepted_proposals(spark, d):
    """What reviewers are given: the last sound verdict of each task and its label under the fail-closed ruling."""
    taken, _, _ = Q.load(*_proposals(spark, d), Scratch(spark, "accepted"), strict=False)
    return taken.select("task", "verdict", "release.sens", "release.mask")


ACCEPTED_PROPOSALS = _PROPOSALS + " SELECT task, verdict, 0 AS sens, mask FROM m WHERE reason IS NULL"


def refused_proposals(spark, d):
    """Rows that were not taken and why, beside the counts of the pass."""
    _, left, counts = Q.load(*_proposals(spark, d), Scratch(spark, "refused"), strict=False)
    seen = F.coalesce(*[F.when(F.col("reason") == r, F.lit(counts[r])) for r in Q.REASONS]).cast("long")
    return left.select("task", F.col("seq").cast("long").alias("seq"), "reason", seen.alias("observed"))


REFUSED_PROPOSALS = _PROPOSALS + " SELECT task, seq, reason, count(*) OVER (PARTITION BY reason) AS observed FROM m WHERE reason IS NOT NULL"


def event_significance(spark, d):
    """Events whose reports tell the whole pattern, half of the reports given one fact of it more."""
    r = A.reports(spark, d).withColumn("fact_ids", F.when(F.col("report_id") % 2 == 0, F.array_union("fact_ids", F.array(*[F.lit(p) for p in PATTERN[:2]]))).otherwise(F.col("fact_ids")))
    return X.world_targets(r, PATTERN)


EVENT_SIGNIFICANCE = using("reports") + f""", r AS (SELECT event_id, CASE WHEN report_id % 2 = 0 THEN list_concat(fact_ids, {PATTERN[:2]}) ELSE fact_ids END AS f FROM reports)
 SELECT event_id AS task, len(list_intersect(list_distinct(flatten(list(f))), {PATTERN})) = 3 AS target FROM r GROUP BY event_id"""


def training_examples(spark, d):
    """Digests of prompts and the completions that three teachers give."""
    reports, tasks, out = A.reports(spark, d), A.tasks(spark, d), None
    for name in ("t1s0", "t1s0.25", "t2s0.5"):
        e = X.build(reports, X.review_targets(tasks, X.Teacher.named(name))).select("task", F.lit(name).alias("teacher"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt"), "completion")
        out = e if out is None else out.unionByName(e)
    return out


TRAINING_EXAMPLES = using("tasks") + f""", p AS (SELECT event_id AS task, list(coalesce(text, '') ORDER BY report_id) AS t FROM reports GROUP BY event_id), g AS (SELECT * FROM (VALUES ('t1s0', 1, 0.0), ('t1s0.25', 1, 0.25), ('t2s0.5', 2, 0.5)) g(teacher, k, slip))
 SELECT task, teacher, sha256(array_to_string(list_concat(list_transform(range(1, len(t) + 1), lambda i: '[' || i || '] ' || t[i]), ['{X.INSTRUCTION}']), chr(10) || chr(10))) AS prompt,
 CASE WHEN (evidence >= k) <> ({_H.format("'7:' || teacher || ':' || task")} / 4294967296.0::DOUBLE < slip) THEN 'SIGNIFICANT' ELSE 'ROUTINE' END AS completion FROM tasks JOIN p USING (task) CROSS JOIN g"""


def linkage_rate(spark, d):
    """Share of analysts whom the linkage attack names exactly, one trial each."""
    links = K.link_open(A.clearances(spark, d), A.part_tasks(spark, d), L.KEEP, (0, 1))
    return S.rates(K.link_trials(links)).select(F.round("single_run_rate", 6).alias("single_run_rate"), F.round("consensus_rate", 6).alias("consensus_rate"))


LINKAGE_RATE = f"SELECT round(avg(exact::INT), 6) AS single_run_rate, round(avg(exact::INT), 6) AS consensus_rate FROM ({LINK_JACCARD})"

QUERIES = {
    "event_significance": (event_significance, EVENT_SIGNIFICANCE), "training_examples": (training_examples, TRAINING_EXAMPLES), "linkage_rate": (linkage_rate, LINKAGE_RATE),
    "balanced_slice": (balanced_slice, BALANCED_SLICE), "latent_cliff": (latent_cliff, LATENT_CLIFF), "saturation": (saturation, SATURATION), "event_claims": (event_claims, EVENT_CLAIMS_SQL),
    "event_argument": (event_argument, EVENT_ARGUMENT), "turn_claims": (turn_claims, TURN_CLAIMS_SQL), "artifact_grid": (artifact_grid, ARTIFACT_GRID), "artifact_twins": (artifact_twins, ARTIFACT_TWINS),
    "ledger_batches": (ledger_batches, LEDGER_BATCHES), "accepted_proposals": (accepted_proposals, ACCEPTED_PROPOSALS), "refused_proposals": (refused_proposals, REFUSED_PROPOSALS),
}
