"""Worked cases of release decisions, kept as data: each names a label, a ceiling, a policy and a purpose, and what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L

_LABEL = "struct<sensitivity:string, compartments:array<string>, capacity:string>"
_POLICY = "struct<declassifiable:array<string>, release_floor:string, drop_compartments:boolean, prohibited:array<struct<compartment:string, purpose:string>>>"
_CASE = f"struct<id:string, label:{_LABEL}, ceiling:string, policy:string, purpose:string, expected_disposition:string, expected_reason:string, pass_criteria:string, verified:boolean>"
SCHEMA = f"ceilings map<string, {_LABEL}>, policies map<string, {_POLICY}>, cases array<{_CASE}>"


class CaseError(ValueError):
    """A table of cases that can't be run."""


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row a case: the case's fields, its ceiling as ``top`` and its policy as ``rule``; names are kept as written."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("d"))
    rows = docs.select("d.ceilings", "d.policies", F.explode("d.cases").alias("c"))
    return rows.select("c.*", F.col("ceilings")[F.col("c.ceiling")].alias("top"), F.col("policies")[F.col("c.policy")].alias("rule"))


def _place(value, names: list[str], what: str):
    """The place of a name; the query fails on one that isn't known, rather than mending it."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"no {what}: "), F.coalesce(value, F.lit("null")))).cast("int"))


def _label(x):
    bit = F.array(*[F.lit(1 << i) for i in range(len(L.COMPARTMENTS))])
    bits = F.transform(x["compartments"], lambda c: F.element_at(bit, _place(c, L.COMPARTMENTS, "compartment") + 1))
    return L.label(_place(x["sensitivity"], L.LEVELS, "level"), F.aggregate(F.array_distinct(bits), F.lit(0), lambda a, b: a.bitwiseOR(b)), _place(x["capacity"], L.CAPACITIES, "capacity"))


def run(cases: DataFrame) -> DataFrame:
    """(id, policy, disposition, reason, expected_disposition, expected_reason, passed) of every case.

    Policies are few; their names are collected, and each policy's cases are decided by its own rules. A case that names no
    known ceiling or policy, and a name that isn't known, is an error.
    """
    lost = cases.where("top IS NULL OR rule IS NULL").select("id").limit(3).collect()
    if lost:
        raise CaseError(f"no such ceiling or policy: {[r.id for r in lost]}")
    out = None
    for r in cases.select("policy", "rule").dropDuplicates(["policy"]).orderBy("policy").limit(1000).collect():
        try:
            ruling = L.Ruling(tuple(sorted(L.CAPACITIES.index(c) for c in r.rule.declassifiable)), L.LEVELS.index(r.rule.release_floor), bool(r.rule.drop_compartments))
            rules = L.ReleaseRules(ruling, tuple((1 << L.COMPARTMENTS.index(p.compartment), p.purpose) for p in r.rule.prohibited or []))
        except ValueError as e:
            raise CaseError(f"policy {r.policy}: {e}") from e
        mine = cases.where(F.col("policy") == r.policy)
        got = L.decide(_label(F.col("label")), _label(F.col("top")), rules, F.col("purpose"))
        rows = mine.select("id", "policy", got["disposition"].alias("disposition"), got["reason"].alias("reason"), "expected_disposition", "expected_reason")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return cases.select("id", "policy", F.lit("").alias("disposition"), F.lit("").alias("reason"), "expected_disposition", "expected_reason", F.lit(True).alias("passed"))
    passed = (F.col("disposition") == F.col("expected_disposition")) & (F.col("reason") == F.col("expected_reason"))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))
