"""Queries of the measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import linkage as K
from ..operators import measures as M
from ..sources import adapters as A
from ..sources.adapters import using

_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_U = "(" + _H + " / 4294967296.0::DOUBLE)"
_LEVELS, _NAMES, _CAPS = L.LEVELS, L.COMPARTMENTS, L.CAPACITIES
_NAMED = f"list_filter(list_transform(range(4), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN {_NAMES}[i + 1] END), lambda n: n IS NOT NULL)"


def assigned_fleet(spark, d):
    """Clearances drawn with replacement for all suppliers."""
    people = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("analyst"))
    return M.assign_fleet(people, "analyst")


ASSIGNED_FLEET = f"SELECT analyst, (h // 16)::INT AS sens, (h % 16)::INT AS mask FROM (SELECT s_suppkey AS analyst, {_H.format(chr(39) + '7:fleet:' + chr(39) + ' || s_suppkey')} % 64 AS h FROM supplier)"


def label_noise(spark, d):
    """Share of randomised contributions on tasks that can't be read."""
    return K.noise_of(K.drawn_counts(A.clearances(spark, d), A.part_tasks(spark, d), 0.8, 0.05, coin="")).select(F.round("noise", 6).alias("noise"), "n")


LABEL_NOISE = using("clearances", "part_tasks") + f""", x AS (SELECT analyst, task, (f.sens >= t.sens AND t.mask & ~f.mask = 0) AS able FROM clearances f CROSS JOIN part_tasks t)
 SELECT round(avg((NOT able)::INT), 6) AS noise, count(*) AS n FROM x WHERE {_U.format("'7:' || analyst || ':' || task || ':part'")} < CASE WHEN able THEN 0.8 ELSE 0.05 END"""


def unmatched_terms(spark, d):
    """Facts told by reports for which a detector without its last two entries has no terms."""
    facts = A.reports(spark, d).select(F.explode("fact_ids").alias("fact"))
    return M.unmatched(facts, dict(list(T.FACT_TERMS.items())[:-2]))


UNMATCHED_TERMS = using("reports") + f" SELECT DISTINCT fact FROM (SELECT unnest(fact_ids) AS fact FROM reports) WHERE fact NOT IN ({', '.join(repr(f) for f in T.FACTS[:-2])})"


def compartment_subsets(spark, d):
    """The sets of compartments of tasks, named."""
    return M.subsets(A.tasks(spark, d)).select("mask", F.array_join("names", ",").alias("names"), "tasks")


COMPARTMENT_SUBSETS = using("tasks") + f" SELECT mask, array_to_string({_NAMED}, ',') AS names, count(*) AS tasks FROM tasks GROUP BY mask"


def dominance_keys(spark, d):
    """The keys of the labels that tasks have, with and without a capacity, and how many tasks have each."""
    t = A.tasks(spark, d).groupBy("sens", "mask").agg(F.count("*").alias("n"))
    return t.select(M.dominance_key(F.col("sens"), F.col("mask")).alias("key"), M.dominance_key(F.col("sens"), F.col("mask"), F.lit(3)).alias("full"), "n")


DOMINANCE_KEYS = using("tasks") + f", k AS (SELECT {_LEVELS}[sens + 1] || '|' || array_to_string({_NAMED}, ',') AS key, count(*) AS n FROM tasks GROUP BY sens, mask) SELECT key, key || '|FREETEXT' AS full, n FROM k"


def parsed_labels(spark, d):
    """Labels to JSON and back; every fifth names a compartment that doesn't exist and is refused."""
    p = M.label_payload(F.col("sens"), F.col("mask"), (F.col("report_id") % 4).cast("int"))
    odd = F.when(F.col("report_id") % 5 == 0, F.replace(p, F.lit('"compartments":['), F.lit('"compartments":["NOWHERE",'))).otherwise(p)
    x = A.reports(spark, d).select("report_id", "mask", odd.alias("p"))
    x = x.withColumn("p", F.replace("p", F.lit('"NOWHERE",]'), F.lit('"NOWHERE"]'))).withColumn("x", M.parse_label(F.col("p")))
    return x.select("report_id", *[F.coalesce(f"x.{c}", F.lit(-1)).alias(c) for c in ("sens", "mask", "cap")], F.col("x").isNull().alias("refused"))


PARSED_LABELS = using("reports") + " SELECT report_id, CASE WHEN report_id % 5 <> 0 THEN sens ELSE -1 END AS sens, CASE WHEN report_id % 5 <> 0 THEN mask ELSE -1 END AS mask, CASE WHEN report_id % 5 <> 0 THEN (report_id % 4)::INT ELSE -1 END AS cap, report_id % 5 = 0 AS refused FROM reports"

_RULES = {"approach": (T.FACTS[:2], [T.FACTS[:1]]), "contact": (T.FACTS[2:3], []), "pattern": (T.PATTERN, [])}


def triggered_signatures(spark, d):
    """How many events each registered signature holds for."""
    facts = A.reports(spark, d).groupBy("event_id").agg(F.array_distinct(F.flatten(F.collect_list("fact_ids"))).alias("facts"))
    s = F.broadcast(M.signatures(spark, _RULES))
    hit = M.triggered(F.col("facts"), F.col("required"))
    return facts.join(s).groupBy("name").agg(F.sum(hit.cast("long")).alias("events"), F.round(F.avg(M.overlap(F.col("facts"), F.col("required"))), 6).alias("overlap"))


_VALUES = ", ".join(f"('{k}', {r})" for k, (r, _) in _RULES.items())
TRIGGERED_SIGNATURES = using("reports") + f", f AS (SELECT event_id, list_distinct(flatten(list(fact_ids))) AS facts FROM reports GROUP BY event_id) SELECT name, count(*) FILTER (list_has_all(facts, required)) AS events, round(avg(len(list_intersect(facts, required))), 6) AS overlap FROM f CROSS JOIN (VALUES {_VALUES}) v(name, required) GROUP BY name"


def class_balance(spark, d):
    """How many tasks are significant, and what always answering the larger class gets right."""
    return M.class_balance(A.tasks(spark, d), "truth").select("n", "positive", F.round("share", 6).alias("share"), F.round("floor", 6).alias("floor"))


CLASS_BALANCE = using("tasks") + " SELECT count(*) AS n, count(*) FILTER (truth) AS positive, round(avg(truth::INT), 6) AS share, round(greatest(avg(truth::INT), 1 - avg(truth::INT)), 6) AS floor FROM tasks"

_T, _S, _R = [1, 2, 3], [0.0, 0.125, 0.25, 0.5], [3, 5, 7]


def _sweep(spark, d):
    t = A.tasks(spark, d).select("task", "evidence", (F.col("evidence") >= 3).alias("truth"))
    return M.review_sweep(t, _T, _S, _R)


def review_sweep(spark, d):
    """Accuracy of reviewers by their threshold and slip."""
    return _sweep(spark, d).select("threshold", "slip", F.round("accuracy", 6).alias("accuracy"))


_SWEEP = using("tasks") + f""", g AS (SELECT t AS threshold, s::DOUBLE AS slip, r AS seed FROM (VALUES (1), (2), (3)) a(t) CROSS JOIN (VALUES (0.0), (0.125), (0.25), (0.5)) b(s) CROSS JOIN (VALUES (3), (5), (7)) c(r)),
 p AS (SELECT threshold, slip, seed, avg((((evidence >= threshold) <> ({_U.format("seed || ':' || threshold || ':' || slip || ':' || task")} < slip)) = (evidence >= 3))::INT) AS a FROM tasks CROSS JOIN g GROUP BY ALL), cells AS (SELECT threshold, slip, avg(a) AS accuracy FROM p GROUP BY ALL)"""
REVIEW_SWEEP = _SWEEP + " SELECT threshold, slip, round(accuracy, 6) AS accuracy FROM cells"


def equivalent_slip(spark, d):
    return M.equivalent_slip(_sweep(spark, d).withColumn("accuracy", F.round("accuracy", 6)))


EQUIVALENT_SLIP = _SWEEP + ", r AS (SELECT threshold, slip, round(accuracy, 6) AS accuracy FROM cells) SELECT a.threshold, min(b.slip) AS slip FROM r a LEFT JOIN r b ON b.threshold = 3 AND b.accuracy <= a.accuracy WHERE a.slip = 0 GROUP BY a.threshold"


def rising_balances(spark, d):
    """Does the mean order price of each customer's nation rise from year to year, and is its least below every segment's?"""
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("m"))
    y = y.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "m"))), lambda x: x["m"]).alias("years"))
    s = o.groupBy("c_nationkey", "c_mktsegment").agg(F.round(F.avg("o_totalprice"), 4).alias("m")).groupBy("c_nationkey").agg(F.collect_list("m").alias("segments"))
    return y.join(s, "c_nationkey").select("c_nationkey", M.monotone(F.col("years")).alias("rises"), M.beats_every_draw(F.array_min("years"), F.col("segments")).alias("beats"))


RISING_BALANCES = """WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), y AS (SELECT c_nationkey, year(o_orderdate) AS y, round(avg(o_totalprice), 4) AS m FROM o GROUP BY ALL), z AS (SELECT *, lag(m) OVER (PARTITION BY c_nationkey ORDER BY y) AS p FROM y),
 r AS (SELECT c_nationkey, count(*) >= 2 AND coalesce(bool_and(m >= p), true) AND arg_max(m, y) > arg_min(m, y) AS rises, min(m) AS low FROM z GROUP BY 1), s AS (SELECT c_nationkey, min(m) AS least FROM (SELECT c_nationkey, c_mktsegment, round(avg(o_totalprice), 4) AS m FROM o GROUP BY ALL) GROUP BY 1)
 SELECT c_nationkey, rises, low < least AS beats FROM r JOIN s USING (c_nationkey)"""


def call_latency(spark, d):
    """Each user's first event against the later ones."""
    return M.split_latency(A.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", *[F.round(c, 6).alias(c) for c in ("cold", "warm_median", "warm_p95", "warm_min")], "n_warm")


CALL_LATENCY = """WITH c AS (SELECT user_id, value AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM events), w AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM c WHERE call > 1)
 SELECT w.user_id, round(any_value(f.s), 6) AS cold, round(median(w.s), 6) AS warm_median, round(max(w.s) FILTER (r = least(n - 1, floor(0.95::DOUBLE * n))), 6) AS warm_p95, round(min(w.s), 6) AS warm_min, count(*) AS n_warm FROM w JOIN c f ON f.user_id = w.user_id AND f.call = 1 GROUP BY w.user_id"""


def sync_cost(spark, d):
    """What a round's update of a part's parameters weighs."""
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 9973).cast("double").alias("t"), (F.col("p_partkey") % 7 * 1000003).cast("double").alias("n"))
    return p.select("p_partkey", *[F.round(c, 6).alias(k) for k, c in M.sync_cost(F.col("t"), F.col("n")).items()])


SYNC_COST = "WITH p AS (SELECT p_partkey, (p_size * 9973)::DOUBLE AS t, (p_partkey % 7 * 1000003)::DOUBLE AS n FROM part) SELECT p_partkey, CASE WHEN t > 0 AND n > 0 THEN round(t * 2 / 1048576.0::DOUBLE, 6) END AS mib_half, CASE WHEN t > 0 AND n > 0 THEN round(t * 4 / 1048576.0::DOUBLE, 6) END AS mib_full, CASE WHEN t > 0 AND n > 0 THEN round(t / n, 6) END AS share FROM p"


def understatement(spark, d):
    """How far independence understates a wrong majority, at each source's share of bad documents, by size of the fleet."""
    rows = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id")
    rates = rows.groupBy("source").agg(F.avg((F.col("quality") == 0).cast("double")).alias("rate"))
    cells = F.array(*[F.struct(F.lit(n).alias("fleet"), M.understatement(F.col("rate"), n).alias("ratio")) for n in (3, 5, 9, 15)])
    return rates.select("source", F.explode(cells).alias("c")).select("source", "c.fleet", "c.ratio")


UNDERSTATEMENT = """WITH r AS (SELECT source, avg((quality = 0)::INT) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source), g AS (SELECT source, rate, n::INT AS fleet FROM r CROSS JOIN (VALUES (3), (5), (9), (15)) b(n)),
 t AS (SELECT source, rate, fleet, sum(round(exp(lgamma(fleet + 1) - lgamma(k + 1) - lgamma(fleet - k + 1)), 0) * pow(rate, k) * pow(1 - rate, fleet - k)) AS p FROM g JOIN range(16) x(k) ON k > fleet // 2 AND k <= fleet GROUP BY ALL)
 SELECT source, fleet, CASE WHEN p > 0 THEN round(rate / p, 1) END AS ratio FROM t"""

_CEILINGS = {"open": (0, 0), "fleet": (1, 1), "all": (3, 15)}
_RULINGS = {"keep": L.KEEP, "drop": L.DROP, "protected": L.Ruling(capacities=(0, 1, 2), floor=2, drop=True)}


def federation_eligibility(spark, d):
    """How many tasks may be shared, by ceiling, ruling and capacity."""
    return M.eligibility(A.tasks(spark, d), _CEILINGS, _RULINGS).withColumn("share", F.round("share", 6))


def _eligibility_sql() -> str:
    rows = [f"('{c}', {s}, {m}, '{r}', {[L.CAPACITIES[i] for i in x.capacities]}, {x.floor}, {str(x.drop).lower()})" for c, (s, m) in _CEILINGS.items() for r, x in _RULINGS.items()]
    return using("tasks") + f""", g AS (SELECT * FROM (VALUES {', '.join(rows)}) v(ceiling, cs, cm, ruling, caps, low, gone) CROSS JOIN (SELECT unnest({L.CAPACITIES}) AS capacity)),
 x AS (SELECT ceiling, ruling, capacity, CASE WHEN list_contains(caps, capacity) THEN least(sens, low) ELSE sens END <= cs AND (CASE WHEN list_contains(caps, capacity) AND gone THEN 0 ELSE mask END) & ~cm = 0 AS ok FROM tasks CROSS JOIN g)
 SELECT ceiling, ruling, capacity, count(*) FILTER (ok) AS eligible, round(avg(ok::INT), 6) AS share FROM x GROUP BY ALL"""


def channel_check(spark, d):
    """Does hiding the partner channel change answers, and is it apart from difficulty?"""
    t = A.tasks(spark, d).withColumn("carries", F.col("mask").bitwiseAND(8) != 0)
    return M.channel_check(t, 2).select("affected", F.round("mean_with", 6).alias("mean_with"), F.round("mean_without", 6).alias("mean_without"), "usable")


CHANNEL_CHECK = using("tasks") + ", x AS (SELECT count(*) FILTER ((evidence >= 2) <> (seen_evidence >= 2)) AS affected, coalesce(avg(evidence) FILTER (mask & 8 <> 0), 0) AS a, coalesce(avg(evidence) FILTER (mask & 8 = 0), 0) AS b FROM tasks) SELECT affected, round(a, 6) AS mean_with, round(b, 6) AS mean_without, affected > 0 AND abs(a - b) <= 0.5 AS usable FROM x"


def gap_summary(spark, d):
    """Two length rules against the quality labels, by source: how the gap between them lies over each language."""
    j = A.table(spark, d, "documents").join(A.table(spark, d, "labels"), "doc_id")
    right = lambda n: F.avg(((F.col("n_chars") > n) == (F.col("quality") == 1)).cast("double"))
    g = j.groupBy("lang", "source").agg(F.round(right(500) - right(2000), 9).alias("gap"))
    return M.gap_summary(g, "gap", ["lang"]).select("lang", "n", *[F.round(c, 6).alias(c) for c in ("median_gap", "max_gap", "min_gap")], "better")


GAP_SUMMARY = """WITH g AS (SELECT lang, source, round(avg(((n_chars > 500) = (quality = 1))::INT) - avg(((n_chars > 2000) = (quality = 1))::INT), 9) AS gap FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
 SELECT lang, count(*) AS n, round(median(gap), 6) AS median_gap, round(max(gap), 6) AS max_gap, round(min(gap), 6) AS min_gap, count(*) FILTER (gap > 0.01) AS better FROM g GROUP BY lang"""


def fleet_gradients(spark, d):
    """Updates of which one client in five, by a hash, turns its own round."""
    g = M.fleet_gradients(A.updates(spark, d).select("client", "v"))
    return g.select("client", "byzantine", F.posexplode("v").alias("coord", "x")).select("client", "byzantine", "coord", F.round("x", 6).alias("x"))


_G = "sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2})"


def _gauss(key: str) -> str:
    return _G.format(u1=_U.format(f"{key} || ':r'"), u2=_U.format(f"{key} || ':t'"))


FLEET_GRADIENTS = using("updates") + f""", g AS (SELECT client, {_H.format("'42:bad:' || client")} % 5 = 0 AS byzantine, unnest(v) AS t, unnest(range(len(v)))::INT AS i FROM updates)
 SELECT client, byzantine, i AS coord, round(CASE WHEN byzantine THEN t * -1.5 ELSE t + 0.1 * {_gauss("'42:noise:' || client || ':' || i")} END, 6) AS x FROM g"""

QUERIES = {
    "assigned_fleet": (assigned_fleet, ASSIGNED_FLEET), "label_noise": (label_noise, LABEL_NOISE), "unmatched_terms": (unmatched_terms, UNMATCHED_TERMS), "compartment_subsets": (compartment_subsets, COMPARTMENT_SUBSETS),
    "dominance_keys": (dominance_keys, DOMINANCE_KEYS), "parsed_labels": (parsed_labels, PARSED_LABELS), "triggered_signatures": (triggered_signatures, TRIGGERED_SIGNATURES), "class_balance": (class_balance, CLASS_BALANCE),
    "review_sweep": (review_sweep, REVIEW_SWEEP), "equivalent_slip": (equivalent_slip, EQUIVALENT_SLIP), "rising_balances": (rising_balances, RISING_BALANCES), "call_latency": (call_latency, CALL_LATENCY),
    "sync_cost": (sync_cost, SYNC_COST), "understatement": (understatement, UNDERSTATEMENT), "federation_eligibility": (federation_eligibility, _eligibility_sql()), "channel_check": (channel_check, CHANNEL_CHECK),
    "gap_summary": (gap_summary, GAP_SUMMARY), "fleet_gradients": (fleet_gradients, FLEET_GRADIENTS),
}
