"""Queries over labels, texts, tasks and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.rng import hashed
from ..operators import review as R
from ..sources import adapters as A
from ..sources.adapters import using

LEVELS, COMPS = str(L.LEVELS), "['LEGAL', 'LIAISON', 'PARTNER', 'SENSOR']"
#: SQL of the text form of a label.
RENDER = f"{LEVELS}[1 + sens] || '[' || array_to_string(list_filter([CASE WHEN mask & 4 <> 0 THEN 'LEGAL' END, CASE WHEN mask & 2 <> 0 THEN 'LIAISON' END, CASE WHEN mask & 8 <> 0 THEN 'PARTNER' END, CASE WHEN mask & 1 <> 0 THEN 'SENSOR' END], lambda x: x IS NOT NULL), ',') || ']'"


def label_join(spark, d):
    """Least upper bound of each center's reports, and of reports selected by parity."""
    r = A.reports(spark, d)
    j = L.join_agg("sens", "mask", 0)
    return r.groupBy("center").agg(j.alias("j"), F.bit_or(F.when(F.col("report_id") % 2 == 0, F.col("mask"))).alias("m2")).select("center", F.col("j.sens").alias("sens"), F.col("j.mask").alias("mask"), F.coalesce("m2", F.lit(0)).alias("even_mask"))


LABEL_JOIN = using("reports") + " SELECT center, max(sens) AS sens, bit_or(mask) AS mask, coalesce(bit_or(mask) FILTER (report_id % 2 = 0), 0) AS even_mask FROM reports GROUP BY center"


def label_dominance(spark, d):
    """How many task labels each clearance dominates, and how many dominate it."""
    fleet, tasks = A.clearances(spark, d), A.part_tasks(spark, d)
    cells = tasks.groupBy("sens", "mask").agg(F.count("*").alias("n"))
    a, t = L.label(F.col("f.sens"), F.col("f.mask")), L.label(F.col("t.sens"), F.col("t.mask"))
    both = fleet.alias("f").join(F.broadcast(cells.alias("t")))
    return both.groupBy("f.analyst").agg(F.sum(F.when(L.dominates(a, t), F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(L.dominates(t, a), F.col("n")).otherwise(0)).alias("above"))


LABEL_DOMINANCE = using("clearances", "part_tasks") + """ SELECT analyst, sum(CASE WHEN f.sens >= t.sens AND t.mask & ~f.mask = 0 THEN 1 ELSE 0 END)::BIGINT AS below,
 sum(CASE WHEN t.sens >= f.sens AND f.mask & ~t.mask = 0 THEN 1 ELSE 0 END)::BIGINT AS above FROM clearances f CROSS JOIN part_tasks t GROUP BY analyst"""


def _grid(spark, d):
    return A.part_tasks(spark, d).withColumn("cap", (F.col("task") % 4).cast("int"))


def declassify_grid(spark, d):
    """Labels under keeping, dropping and a floor of PROTECTED."""
    x = L.label(F.col("sens"), F.col("mask"), F.col("cap"))
    out = {"keep": L.KEEP, "dropped": L.DROP, "floored": L.Ruling(floor=2, drop=True)}
    rows = _grid(spark, d).select("task", *[L.declassify(x, r).alias(k) for k, r in out.items()])
    return rows.select("task", *[F.col(f"{k}.{f}").alias(f"{k}_{f}") for k in out for f in ("sens", "mask")])


DECLASSIFY_GRID = using("part_tasks") + """, g AS (SELECT *, task % 4 AS cap FROM part_tasks) SELECT task, CASE WHEN cap < 2 THEN 0 ELSE sens END AS keep_sens, mask AS keep_mask,
 CASE WHEN cap < 2 THEN 0 ELSE sens END AS dropped_sens, CASE WHEN cap < 2 THEN 0 ELSE mask END AS dropped_mask,
 CASE WHEN cap < 2 THEN least(sens, 2) ELSE sens END AS floored_sens, CASE WHEN cap < 2 THEN 0 ELSE mask END AS floored_mask FROM g"""


def disclosure_decide(spark, d):
    """Decisions under the four rulings at the fleet's ceiling, and for the veto also of an incident review."""
    x, ceiling = L.label(F.col("sens"), F.col("mask"), F.col("cap")), L.label(1, 1, 3)
    rules = {"keep": L.ReleaseRules(L.KEEP), "dropped": L.ReleaseRules(L.DROP), "floored": L.ReleaseRules(L.Ruling(floor=2, drop=True)), "veto": L.ReleaseRules(L.DROP, ((4, "fleet_training"),))}
    rows = _grid(spark, d).select("task", *[L.decide(x, ceiling, r).alias(k) for k, r in rules.items()], L.decide(x, ceiling, rules["veto"], "incident_review").alias("review"))
    return rows.select("task", *[F.concat_ws("/", f"{k}.disposition", f"{k}.reason").alias(k) for k in [*rules, "review"]])


def _decide_sql(floor: int, drop: bool, veto: bool) -> str:
    s, m = f"(CASE WHEN cap < 2 THEN least(sens, {floor}) ELSE sens END)", f"(CASE WHEN cap < 2 THEN {0 if drop else 'mask'} ELSE mask END)"
    first = "WHEN mask & 4 <> 0 THEN 'withhold/PURPOSE_PROHIBITED' " if veto else ""
    return f"CASE {first}WHEN {s} <= 1 AND {m} & ~1 = 0 THEN 'release/RELEASABLE' WHEN cap >= 2 THEN 'withhold/CAPACITY_NOT_DECLASSIFIABLE' WHEN {s} > 1 THEN 'withhold/LEVEL_ABOVE_CEILING' ELSE 'approval/COMPARTMENT_NOT_HELD' END"


DISCLOSURE_DECIDE = using("part_tasks") + f""", g AS (SELECT *, task % 4 AS cap FROM part_tasks) SELECT task, {_decide_sql(0, False, False)} AS keep, {_decide_sql(0, True, False)} AS dropped,
 {_decide_sql(2, True, False)} AS floored, {_decide_sql(0, True, True)} AS veto, {_decide_sql(0, True, False)} AS review FROM g"""


def most_restrictive(spark, d):
    """Worst disposition of each brand's tasks, with counts."""
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("task"), "p_brand")
    x = L.label(F.col("sens"), F.col("mask"), F.col("cap"))
    rows = _grid(spark, d).join(p, "task").select("p_brand", L.decide(x, L.label(1, 1, 3), L.ReleaseRules(L.KEEP))["disposition"].alias("disposition"))
    return rows.groupBy("p_brand").agg(L.most_restrictive(F.col("disposition")).alias("worst"), F.sum((F.col("disposition") == "release").cast("long")).alias("released"), F.count("*").alias("n"))


MOST_RESTRICTIVE = using("part_tasks") + f""", g AS (SELECT t.*, p_brand, task % 4 AS cap FROM part_tasks t JOIN part ON p_partkey = task), x AS (SELECT p_brand, split_part({_decide_sql(0, False, False)}, '/', 1) AS d FROM g)
 SELECT p_brand, CASE WHEN max(d = 'withhold') THEN 'withhold' WHEN max(d = 'approval') THEN 'approval' ELSE 'release' END AS worst, count(*) FILTER (d = 'release') AS released, count(*) AS n FROM x GROUP BY p_brand""".replace("max(d =", "bool_or(d =")


def admit_releases(spark, d):
    """Labels judged as they are, at the ceiling of every clearance's own."""
    f = A.clearances(spark, d)
    c = L.admit(L.label(F.col("sens"), F.col("mask")), L.label(2, 5, 3), L.ReleaseRules(L.KEEP, ((8, "fleet_training"),)))
    return f.select("analyst", c["disposition"].alias("disposition"), c["reason"].alias("reason"), L.render(L.label(F.col("sens"), F.col("mask"))).alias("label"))


ADMIT_RELEASES = using("clearances") + f""" SELECT analyst, CASE WHEN mask & 8 <> 0 THEN 'withhold' WHEN sens <= 2 AND mask & ~5 = 0 THEN 'release' WHEN sens > 2 THEN 'withhold' ELSE 'approval' END AS disposition,
 CASE WHEN mask & 8 <> 0 THEN 'PURPOSE_PROHIBITED' WHEN sens <= 2 AND mask & ~5 = 0 THEN 'RELEASABLE' WHEN sens > 2 THEN 'LEVEL_ABOVE_CEILING' ELSE 'COMPARTMENT_NOT_HELD' END AS reason, {RENDER} AS label FROM clearances"""


def label_histogram(spark, d):
    return A.reports(spark, d).groupBy(L.render(L.label(F.col("sens"), F.col("mask"))).alias("label")).agg(F.count("*").alias("n"))


LABEL_HISTOGRAM = using("reports") + f" SELECT {RENDER} AS label, count(*) AS n FROM reports GROUP BY 1"


def corpus_rows(spark, d):
    """The exported form of a report."""
    r = A.reports(spark, d)
    return r.select(F.format_string("R-%05d", "report_id").alias("report_id"), F.format_string("E-%04d", F.col("event_id")).alias("event_id"), "report_type", "center", "voice", F.get(F.array(*map(F.lit, L.LEVELS)), "sens").alias("sensitivity"), F.array_join(L.names(F.col("mask")), ",").alias("compartments"), F.lit("FREETEXT").alias("capacity"), F.array_join("fact_ids", ",").alias("fact_ids"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


CORPUS_ROWS = using("reports") + f""" SELECT printf('R-%05d', report_id) AS report_id, printf('E-%04d', event_id) AS event_id, report_type, center, voice, {LEVELS}[1 + sens] AS sensitivity,
 rtrim(split_part({RENDER}, '[', 2), ']') AS compartments, 'FREETEXT' AS capacity, array_to_string(fact_ids, ',') AS fact_ids, sha256(text) AS text_sha256 FROM reports"""


def surface_features(spark, d):
    """Shape of every document's text, with the ranks of its center and voice among those there are."""
    f = T.shape(F.col("text"))
    return A.table(spark, d, "documents").select("doc_id", *[F.round(c, 6).alias(k) for k, c in f.items()])


_SHAPE = """SELECT doc_id, round(length(text)::DOUBLE, 6) AS char_len, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::DOUBLE, 6) AS word_count,
 round(len(list_filter(string_split(text, '.'), lambda x: regexp_replace(x, '\\s', '', 'g') <> ''))::DOUBLE, 6) AS sentence_count,
 round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / greatest(len(list_filter(string_split(text, '.'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')), 1)::DOUBLE, 6) AS mean_sentence_len,
 round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS digit_ratio, round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS upper_ratio,
 round(length(regexp_replace(text, '[^.,;:()/\\-]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 6) AS punct_ratio,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_full_match(x, '[0-9]+Z'))) > 0 AS ts FROM documents"""
SURFACE_FEATURES = f"SELECT * EXCLUDE (ts), ts::INT::DOUBLE AS has_timestamp FROM ({_SHAPE})"

#: Terms that occur in the driver's texts, so that detection has something to find.
OWN_TERMS = {"thing": ["thing", "ing the"], "license": ["license", "copyright"], "mail": ["@"], "filler": ["general cargo", "press item"], "toxic": ["trash", "worthless"]}


def detect_facts(spark, d):
    """Facts asserted by documents, under the standard terms and under terms of our own."""
    return A.table(spark, d, "documents").select("doc_id", F.array_join(T.detect_facts(F.col("text")), ",").alias("facts"), F.array_join(T.detect_facts(F.col("text"), OWN_TERMS), ",").alias("own"))


def _detect_sql(terms: dict[str, list[str]], text: str) -> str:
    hits = [f"CASE WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}' END" for k, ws in terms.items()]
    return f"list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)"


_LOW = "lower(text)"
for _phrase in T.BOILERPLATE:
    _LOW = f"replace({_LOW}, '{_phrase}', ' ')"
DETECT_FACTS = f"WITH l AS (SELECT doc_id, {_LOW} AS t FROM documents) SELECT doc_id, array_to_string({_detect_sql(T.FACT_TERMS, 't')}, ',') AS facts, array_to_string({_detect_sql(OWN_TERMS, 't')}, ',') AS own FROM l"


def detector_accuracy(spark, d):
    """Recall, precision and F1 of detection, against texts that tell two facts each: the report's own ids, spelled out."""
    r = A.reports(spark, d).withColumn("said", F.concat(F.lit("log: "), F.get(F.array(*[F.lit(T.FACT_TERMS[f][0]) for f in T.FACTS]), F.array_position(F.array(*map(F.lit, T.FACTS)), F.col("fact_ids")[0]).cast("int") - 1), F.lit(" and knots")))
    found = T.detect_facts(F.col("said"))
    s = r.select("fact_ids", found.alias("f")).agg(F.count("*").alias("n"), F.sum(F.size(F.array_intersect("fact_ids", "f"))).alias("tp"), F.sum(F.size("f")).alias("det"), F.sum(F.size("fact_ids")).alias("act"))
    rec, pre = F.col("tp") / F.greatest("act", F.lit(1)), F.col("tp") / F.greatest("det", F.lit(1))
    return s.select("n", F.round(rec, 6).alias("recall"), F.round(pre, 6).alias("precision"), F.round(F.when(rec + pre == 0, 0.0).otherwise(2 * rec * pre / (rec + pre)), 6).alias("f1"))


DETECTOR_ACCURACY = using("reports") + f""", s AS (SELECT fact_ids, 'log: ' || {[T.FACT_TERMS[f][0] for f in T.FACTS]}[list_position({T.FACTS}, fact_ids[1])] || ' and knots' AS text FROM reports),
 l AS (SELECT fact_ids, {_LOW} AS t FROM s), x AS (SELECT fact_ids, {_detect_sql(T.FACT_TERMS, 't')} AS f FROM l), a AS (SELECT count(*) AS n, sum(len(list_intersect(fact_ids, f))) AS tp, sum(len(f)) AS det, sum(len(fact_ids)) AS act FROM x)
 SELECT n, round(tp / act::DOUBLE, 6) AS recall, round(tp / det::DOUBLE, 6) AS precision, round(2 * (tp / act::DOUBLE) * (tp / det::DOUBLE) / (tp / act::DOUBLE + tp / det::DOUBLE), 6) AS f1 FROM a"""


def parse_verdict(spark, d):
    """Verdicts in conversations, with the marker drawn in by role."""
    c = A.table(spark, d, "conversations")
    h = hashed("v", F.col("conv_id"), F.col("turn")) % 5
    t = F.concat("text", F.when(h == 0, " verdict: significant").when(h == 1, " Verdict: ROUTINE").when(h == 2, " significant VERDICT routine").when(h == 3, " significant or routine").otherwise(""))
    return c.select("conv_id", "turn", T.parse_verdict(t).alias("verdict"), T.parse_verdict(t, None).alias("short"))


PARSE_VERDICT = """WITH c AS (SELECT conv_id, turn, upper(text || CASE ('0x' || substr(md5('v:' || conv_id || ':' || turn), 1, 8))::BIGINT % 5 WHEN 0 THEN ' verdict: significant' WHEN 1 THEN ' Verdict: ROUTINE' WHEN 2 THEN ' significant VERDICT routine' WHEN 3 THEN ' significant or routine' ELSE '' END) AS t FROM conversations),
 p AS (SELECT *, string_split(t, 'VERDICT')[-1] AS tail FROM c) SELECT conv_id, turn, CASE WHEN contains(tail, 'SIGNIFICANT') <> contains(tail, 'ROUTINE') THEN contains(tail, 'SIGNIFICANT') END AS verdict,
 CASE WHEN contains(t, 'SIGNIFICANT') <> contains(t, 'ROUTINE') THEN contains(t, 'SIGNIFICANT') END AS short FROM p"""


def prompts(spark, d):
    """Numbered prompts of conversations, whole and without the second text."""
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return c.select("conv_id", sha(T.numbered(F.col("t"))).alias("whole"), sha(T.numbered(T.without(F.col("t"), 1))).alias("without_second"))


PROMPTS = """WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, t, list_concat(t[1:1], t[3:]) AS u FROM c)
 SELECT conv_id, sha256(array_to_string(list_transform(range(1, len(t) + 1), lambda i: '[' || i || '] ' || t[i]), chr(10) || chr(10))) AS whole,
 sha256(array_to_string(list_transform(range(1, len(u) + 1), lambda i: '[' || i || '] ' || u[i]), chr(10) || chr(10))) AS without_second FROM w"""


def balanced_shots(spark, d):
    """Twelve tasks that alternate between the classes."""
    return T.balanced_shots(A.tasks(spark, d).select("task", "truth"), 12, "task", "truth").select("task", "truth")


BALANCED_SHOTS = using("tasks") + " , r AS (SELECT task, truth, 2 * row_number() OVER (PARTITION BY truth ORDER BY task) - truth::INT AS place FROM tasks) SELECT task, truth FROM r ORDER BY place LIMIT 12"


def lexical_substitution(spark, d):
    """Documents with frequent words replaced by drawn synonyms."""
    own = {"the": ["la", "le"], "of": ["von", "de", "du"]}
    t = T.substitute(F.col("text"), F.col("doc_id"), 42, own)
    return A.table(spark, d, "documents").select("doc_id", F.sha2(t.cast("binary"), 256).alias("sha256"))


LEXICAL_SUBSTITUTION = """WITH a AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN replace(text, 'the', ['la', 'le'][1 + ('0x' || substr(md5('42:' || doc_id || ':the'), 1, 8))::BIGINT % 2]) ELSE text END AS t FROM documents)
 SELECT doc_id, sha256(CASE WHEN contains(lower(t), 'of') THEN replace(t, 'of', ['von', 'de', 'du'][1 + ('0x' || substr(md5('42:' || doc_id || ':of'), 1, 8))::BIGINT % 3]) ELSE t END) AS sha256 FROM a"""


def task_chunks(spark, d):
    """Documents in runs of eight within each source."""
    return R.chunks(A.table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("source", "chunk", "pos", "doc_id")


TASK_CHUNKS = """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT source, p // 8 AS chunk, (p % 8)::INT AS pos, doc_id FROM r WHERE p // 8 < n // 8"""


def triage_tasks(spark, d):
    """Tasks with label, evidence, evidence without a channel, and truth."""
    return A.tasks(spark, d)


TRIAGE_TASKS = using("tasks") + " SELECT * FROM tasks"


def channel_carriage(spark, d):
    """Tasks that carry each compartment."""
    return R.carriage(A.tasks(spark, d)).groupBy("compartment").agg(F.sum(F.col("carries").cast("long")).alias("carrying"), F.count("*").alias("n"))


CHANNEL_CARRIAGE = using("tasks") + """ SELECT compartment, count(*) FILTER (mask & b <> 0) AS carrying, count(*) AS n FROM tasks CROSS JOIN (VALUES ('SENSOR', 1), ('LIAISON', 2), ('LEGAL', 4), ('PARTNER', 8)) v(compartment, b) GROUP BY compartment"""


def proposals(spark, d):
    """Every proposal is the inverted truth with the label that keeping compartments gives; every seventh task has none."""
    t = A.tasks(spark, d)
    return t.select("*", F.when(F.col("task") % 7 != 0, ~F.col("truth")).alias("p_verdict"), F.lit(0).alias("p_sens"), F.col("mask").alias("p_mask"))


def _reviews(spark, d):
    return R.review(proposals(spark, d))


def review_actions(spark, d):
    """Reviews of the standard ensemble."""
    return _reviews(spark, d).select("task", "analyst", "action", F.array_join("grounds", ",").alias("grounds"), F.array_join("reasons", ",").alias("reasons"), "corrected_verdict", F.coalesce("corrected_mask", F.lit(-1)).alias("corrected_mask"))


_U = "('0x' || substr(md5('7:' || name || ':' || task || ':{}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_REVIEWS = using("tasks") + f""", pol(name, thr, dropped, slip, rev, named, esc) AS (VALUES ('by-the-book', 3, false, 0.0, 1.0, true, true), ('two-of-three', 2, false, 0.0, 1.0, true, true), ('any-one', 1, false, 0.0, 1.0, true, true),
 ('releaser', 3, true, 0.0, 1.0, true, true), ('inattentive', 3, false, 0.15, 1.0, true, true), ('terse', 3, false, 0.0, 0.25, true, true), ('unexplained', 3, false, 0.0, 1.0, false, true), ('no-escalation', 3, false, 0.0, 1.0, true, false)),
 a AS (SELECT task, name, NOT truth AS pv, mask AS pm, (evidence >= thr) <> ({_U.format('slip')} < slip) AS own, mask & ~1 <> 0 AS blocked, NOT dropped AND mask & ~1 <> 0 AS ask, CASE WHEN dropped THEN 0 ELSE mask END AS own_mask,
  {_U.format('revise')} < rev AS revises, named, esc FROM tasks CROSS JOIN pol WHERE task % 7 <> 0),
 b AS (SELECT *, CASE WHEN own = pv AND NOT blocked THEN 'accept' WHEN esc AND blocked AND ask THEN 'escalate' WHEN revises THEN 'revise' ELSE 'reject' END AS action FROM a),
 reviews AS (SELECT task, name AS analyst, action, CASE WHEN named THEN concat_ws(',', CASE WHEN own <> pv THEN 'verdict' END, CASE WHEN blocked THEN 'release' END) ELSE '' END AS grounds, CASE WHEN named AND blocked THEN 'COMPARTMENT_NOT_HELD' ELSE '' END AS reasons,
  CASE WHEN action = 'accept' THEN pv WHEN action <> 'reject' THEN own END AS corrected_verdict, CASE WHEN action = 'accept' THEN pm WHEN action <> 'reject' THEN own_mask ELSE -1 END AS corrected_mask FROM b)"""
REVIEW_ACTIONS = _REVIEWS + " SELECT * FROM reviews"


def review_votes(spark, d):
    """Votes that come of the reviews, counted."""
    return R.contributions(_reviews(spark, d)).groupBy("who").agg(F.count("*").alias("n"), F.sum(F.col("verdict").cast("long")).alias("yes"))


REVIEW_VOTES = _REVIEWS + " SELECT analyst AS who, count(*) AS n, count(*) FILTER (corrected_verdict) AS yes FROM reviews WHERE action IN ('accept', 'revise') GROUP BY analyst"


def supervision_yield(spark, d):
    return R.supervision_yield(_reviews(spark, d), A.tasks(spark, d))


SUPERVISION_YIELD = _REVIEWS + """ SELECT count(*) AS n, count(*) FILTER (action = 'accept') AS accepted, count(*) FILTER (action = 'revise') AS revised, count(*) FILTER (action = 'escalate') AS escalated, count(*) FILTER (action = 'reject') AS rejected,
 count(corrected_verdict) AS supervised, count(*) FILTER (action <> 'accept' AND grounds <> '') AS located, count(*) FILTER (corrected_verdict = truth) AS correct FROM reviews JOIN tasks USING (task)"""


def release_recovery(spark, d):
    return R.release_recovery(_reviews(spark, d), proposals(spark, d))


RELEASE_RECOVERY = _REVIEWS + """ SELECT count(*) AS n, count(*) FILTER (action <> 'accept') AS objections, count(*) FILTER (action IN ('revise', 'escalate')) AS corrections,
 count(*) FILTER (action IN ('revise', 'escalate') AND corrected_mask & ~1 = 0) AS releasable, count(*) FILTER (action = 'escalate') AS escalated FROM reviews JOIN tasks USING (task) WHERE mask & ~1 <> 0"""


def fleiss_kappa(spark, d):
    """Agreement of the reviewers' actions."""
    k = R.fleiss_kappa(_reviews(spark, d), "task", "action")
    return k.select("n_items", "n_raters", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


FLEISS_KAPPA = _REVIEWS + """, c AS (SELECT task, action, count(*)::DOUBLE AS n FROM reviews GROUP BY ALL), i AS (SELECT task, sum(n) AS r, sum(n * n) AS sq FROM c GROUP BY task), m AS (SELECT r FROM i GROUP BY r ORDER BY count(*) DESC, r DESC LIMIT 1),
 k AS (SELECT i.* FROM i JOIN m USING (r)), h AS (SELECT count(*) AS n_items, max(r) AS r, avg((sq - r) / (r * (r - 1))) AS observed FROM k), s AS (SELECT action, sum(n) AS n FROM c SEMI JOIN k USING (task) GROUP BY action),
 e AS (SELECT n_items, r, observed, (SELECT sum(n * n) FROM s) / (n_items * r * n_items * r) AS expected FROM h) SELECT n_items, r::BIGINT AS n_raters, round(observed, 6) AS observed, round(expected, 6) AS expected, round(CASE WHEN expected >= 1 THEN 0 ELSE (observed - expected) / (1 - expected) END, 6) AS kappa FROM e"""


def ledger_routes(spark, d):
    """Where each review may train."""
    r = _reviews(spark, d).join(proposals(spark, d).select("task", "p_sens", "p_mask"), "task")
    fixed = F.when(F.col("corrected_sens").isNotNull(), L.render(L.label(F.col("corrected_sens"), F.col("corrected_mask"))))
    target = L.route(F.col("action"), F.col("corrected_verdict"), L.render(L.label(F.col("p_sens"), F.col("p_mask"))), fixed, F.col("grounds"), F.col("reasons"))
    return r.groupBy("action", target.alias("target")).agg(F.count("*").alias("n"))


LEDGER_ROUTES = _REVIEWS + """ SELECT action, CASE WHEN action = 'reject' THEN 'discard' WHEN reasons <> '' THEN 'personal_only' WHEN action IN ('accept', 'revise') AND grounds <> '' THEN 'shared_federated' ELSE 'personal_only' END AS target, count(*) AS n FROM reviews GROUP BY ALL"""

QUERIES = {
    "label_join": (label_join, LABEL_JOIN), "label_dominance": (label_dominance, LABEL_DOMINANCE), "declassify_grid": (declassify_grid, DECLASSIFY_GRID), "disclosure_decide": (disclosure_decide, DISCLOSURE_DECIDE),
    "most_restrictive": (most_restrictive, MOST_RESTRICTIVE), "admit_releases": (admit_releases, ADMIT_RELEASES), "label_histogram": (label_histogram, LABEL_HISTOGRAM), "corpus_rows": (corpus_rows, CORPUS_ROWS),
    "surface_features": (surface_features, SURFACE_FEATURES), "detect_facts": (detect_facts, DETECT_FACTS), "detector_accuracy": (detector_accuracy, DETECTOR_ACCURACY), "parse_verdict": (parse_verdict, PARSE_VERDICT),
    "prompts": (prompts, PROMPTS), "balanced_shots": (balanced_shots, BALANCED_SHOTS), "lexical_substitution": (lexical_substitution, LEXICAL_SUBSTITUTION), "task_chunks": (task_chunks, TASK_CHUNKS),
    "triage_tasks": (triage_tasks, TRIAGE_TASKS), "channel_carriage": (channel_carriage, CHANNEL_CARRIAGE), "review_actions": (review_actions, REVIEW_ACTIONS), "review_votes": (review_votes, REVIEW_VOTES),
    "supervision_yield": (supervision_yield, SUPERVISION_YIELD), "release_recovery": (release_recovery, RELEASE_RECOVERY), "fleiss_kappa": (fleiss_kappa, FLEISS_KAPPA), "ledger_routes": (ledger_routes, LEDGER_ROUTES),
}
