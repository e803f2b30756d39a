"""Classification labels as columns: struct<sens:int, mask:int, cap:int>.

``sens`` is the level, ``mask`` the set of compartments as bits, ``cap`` how much the output can carry. One label dominates
another if its level is as high and its compartments include the other's; ``cap`` plays no part in that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names in order of their codes.
LEVELS = ["OPEN", "INTERNAL", "PROTECTED", "RESTRICTED"]
COMPARTMENTS = ["SENSOR", "LIAISON", "LEGAL", "PARTNER"]
CAPACITIES = ["ENUM", "SCALAR", "SPAN", "FREETEXT"]
DISPOSITIONS = ["release", "approval", "withhold"]


@dataclass(frozen=True)
class Ruling:
    """What a declassification does: capacities it applies to, the level it lowers to, whether compartments go."""

    capacities: tuple[int, ...] = (0, 1)
    floor: int = 0
    drop: bool = False


@dataclass(frozen=True)
class ReleaseRules:
    """A ruling and the uses that owners have ruled out, as (compartment bit, purpose)."""

    ruling: Ruling = Ruling()
    prohibited: tuple[tuple[int, str], ...] = ()


KEEP, DROP = Ruling(), Ruling(drop=True)


def label(sens: Column | int, mask: Column | int, cap: Column | int = 0) -> Column:
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(as_int(sens).alias("sens"), as_int(mask).alias("mask"), as_int(cap).alias("cap"))


def dominates(high: Column, low: Column) -> Column:
    return (high["sens"] >= low["sens"]) & (low["mask"].bitwiseAND(F.bitwise_not(high["mask"])) == 0)


def join_agg(sens: str, mask: str, cap: int) -> Column:
    """Aggregate: the least upper bound, of no rows (OPEN, none); the capacity is the caller's."""
    return label(F.coalesce(F.max(sens), F.lit(0)), F.coalesce(F.bit_or(mask), F.lit(0)), cap)


def join_array(labels: Column, cap: int) -> Column:
    """The same over an array of labels."""
    top = F.aggregate(labels, F.lit(0), lambda a, x: F.greatest(a, x["sens"]))
    return label(top, F.aggregate(labels, F.lit(0), lambda a, x: a.bitwiseOR(x["mask"])), cap)


def declassify(x: Column, ruling: Ruling) -> Column:
    applies = x["cap"].isin(*ruling.capacities) if ruling.capacities else F.lit(False)
    mask = F.lit(0) if ruling.drop else x["mask"]
    return F.when(applies, label(F.least(x["sens"], F.lit(ruling.floor)), mask, x["cap"])).otherwise(label(x["sens"], x["mask"], x["cap"]))


def eligible(x: Column, ceiling: Column, ruling: Ruling) -> Column:
    return dominates(ceiling, declassify(x, ruling))


def prohibition(x: Column, rules: ReleaseRules, purpose: Column | str) -> Column:
    """Name of the first compartment, by name, whose owner rules out the purpose; null if none."""
    purpose = purpose if isinstance(purpose, Column) else F.lit(purpose)
    found = [F.when((x["mask"].bitwiseAND(bit) != 0) & (purpose == use), F.lit(COMPARTMENTS[bit.bit_length() - 1])) for bit, use in sorted(rules.prohibited, key=lambda p: (COMPARTMENTS[p[0].bit_length() - 1], p[1]))]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _decision(disposition: Column, reason: Column) -> Column:
    return F.struct(disposition.alias("disposition"), reason.alias("reason"))


def classify(released: Column, ceiling: Column) -> Column:
    above = released["sens"] > ceiling["sens"]
    fits = dominates(ceiling, released)
    return _decision(F.when(fits, "release").when(above, "withhold").otherwise("approval"), F.when(fits, "RELEASABLE").when(above, "LEVEL_ABOVE_CEILING").otherwise("COMPARTMENT_NOT_HELD"))


def admit(released: Column, ceiling: Column, rules: ReleaseRules = ReleaseRules(), purpose: Column | str = "fleet_training") -> Column:
    """Judges a label that has been derived already."""
    ruled_out = prohibition(released, rules, purpose).isNotNull()
    c = classify(released, ceiling)
    return _decision(F.when(ruled_out, "withhold").otherwise(c["disposition"]), F.when(ruled_out, "PURPOSE_PROHIBITED").otherwise(c["reason"]))


def decide(x: Column, ceiling: Column, rules: ReleaseRules = ReleaseRules(), purpose: Column | str = "fleet_training") -> Column:
    """Derives a release and judges it; the binding objection comes first. Adds ``released``."""
    ruled_out = prohibition(x, rules, purpose).isNotNull()
    released = declassify(x, rules.ruling)
    stuck = ~x["cap"].isin(*rules.ruling.capacities) if rules.ruling.capacities else F.lit(True)
    ok, c = dominates(ceiling, released), classify(released, ceiling)
    disposition = F.when(ruled_out, "withhold").when(ok, "release").when(stuck, "withhold").otherwise(c["disposition"])
    reason = F.when(ruled_out, "PURPOSE_PROHIBITED").when(ok, "RELEASABLE").when(stuck, "CAPACITY_NOT_DECLASSIFIABLE").otherwise(c["reason"])
    return F.struct(disposition.alias("disposition"), reason.alias("reason"), F.when(ruled_out, label(x["sens"], x["mask"], x["cap"])).otherwise(released).alias("released"))


def severity(disposition: Column) -> Column:
    return F.when(disposition == "withhold", 2).when(disposition == "approval", 1).otherwise(0)


def most_restrictive(disposition: Column) -> Column:
    """Aggregate: the worst disposition, of no rows release."""
    return F.get(F.array(*map(F.lit, DISPOSITIONS)), F.coalesce(F.max(severity(disposition)), F.lit(0)))


def names(mask: Column) -> Column:
    """Names of the compartments, sorted."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << COMPARTMENTS.index(n)) != 0, F.lit(n)) for n in sorted(COMPARTMENTS)]))


def render(x: Column, with_capacity: bool = False) -> Column:
    """``LEVEL[A,B]``, with ``@CAP`` if asked for."""
    level = F.get(F.array(*map(F.lit, LEVELS)), x["sens"])
    text = F.concat(level, F.lit("["), F.array_join(names(x["mask"]), ","), F.lit("]"))
    return F.concat(text, F.lit("@"), F.get(F.array(*map(F.lit, CAPACITIES)), x["cap"])) if with_capacity else text


def candidates(spark: SparkSession) -> DataFrame:
    """All 64 clearances (c_sens, c_mask)."""
    return spark.range(64).select((F.col("id") / 16).cast("int").alias("c_sens"), (F.col("id") % 16).cast("int").alias("c_mask"))


def route(action: Column, corrected: Column, proposed_label: Column, corrected_label: Column, grounds: Column, reasons: Column) -> Column:
    """Where a review may train: discard, personal_only or shared_federated; labels are rendered text."""
    secret = F.coalesce(proposed_label.contains("RESTRICTED"), F.lit(False)) | F.coalesce(corrected_label.contains("RESTRICTED"), F.lit(False))
    held_back = F.coalesce(F.array_contains(reasons, "COMPARTMENT_NOT_HELD"), F.lit(False))
    pattern = action.isin("accept", "revise") & F.coalesce(F.arrays_overlap(grounds, F.array(F.lit("verdict"), F.lit("release"))), F.lit(False))
    return F.when((action == "reject") & corrected.isNull(), "discard").when(secret | held_back, "personal_only").when(pattern, "shared_federated").otherwise("personal_only")
