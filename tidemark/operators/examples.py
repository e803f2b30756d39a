"""Prompts with the verdicts to be learned from them: the world's, or those that a reviewer's standard and slips give."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rng import uniform

#: Fixed value: how a reviewer on the grid of standard and carefulness is named.
SPEC = re.compile(r"^t([123])s(0(?:\.\d+)?)$")
PREAMBLE, INSTRUCTION = "Decide as the officer does.", "Answer with VERDICT: SIGNIFICANT or VERDICT: ROUTINE."


@dataclass(frozen=True)
class Teacher:
    """Calls a task significant from ``threshold`` facts on, and says the opposite in ``slip`` of all cases."""

    name: str
    threshold: int
    slip: float

    @classmethod
    def named(cls, name: str) -> Teacher:
        """``t2s0.15``: two facts, 15 % slips."""
        found = SPEC.match(name)
        if not found:
            raise ValueError(f"no teacher: {name!r}")
        return cls(name, int(found[1]), float(found[2]))

    def verdict(self, evidence: Column, task: Column, seed: int) -> Column:
        """Slips are drawn by seed, name and task, so a teacher slips on the same tasks whatever they are asked for."""
        return (evidence >= self.threshold) != (uniform(seed, self.name, task) < self.slip)


def significant(facts: Column, pattern: list[str]) -> Column:
    """All facts of the pattern are there."""
    return F.size(F.array_intersect(facts, F.array(*[F.lit(p) for p in pattern]))) == len(set(pattern))


def world_targets(reports: DataFrame, pattern: list[str]) -> DataFrame:
    """(task, target): whether a task's reports tell the whole pattern."""
    told = F.array_distinct(F.flatten(F.collect_list("fact_ids")))
    return reports.groupBy(F.col("event_id").alias("task")).agg(significant(told, pattern).alias("target"))


def review_targets(tasks: DataFrame, teacher: Teacher, seed: int = 7) -> DataFrame:
    """(task, target) as the teacher decides; ``tasks`` has task and evidence. No proposal is needed: what a reviewer accepts
    or corrects to is what they hold to be true."""
    return tasks.select("task", teacher.verdict(F.col("evidence"), F.col("task"), seed).alias("target"))


def build(reports: DataFrame, targets: DataFrame, preamble: str = PREAMBLE, instruction: str = INSTRUCTION) -> DataFrame:
    """(task, prompt, completion) of every task with a target: its reports' texts, numbered in order of id."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("report_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    rows = reports.groupBy(F.col("event_id").alias("task")).agg(texts.alias("texts")).join(targets.where("target IS NOT NULL"), "task")
    none = F.array().cast("array<struct<texts:array<string>, verdict:boolean>>")
    return rows.select("task", T.prompt(F.col("texts"), none, preamble, instruction).alias("prompt"), T.verdict_text(F.col("target")).alias("completion"))
