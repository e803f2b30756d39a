"""Nested result documents, decision records, and scenario files."""

from __future__ import annotations

import json
import string
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a rendering may have filled in.
SLOTS = ["vessel", "hull", "flag", "center", "draft", "laden", "heading", "degrees", "range_nm", "count", "total", "time", "berth", "knots"]


def dig(document: Column, path: str) -> Column:
    """A value of a JSON document by dotted path; a part may be a key, an index from either end, or ``field=value`` for the
    first element of a list with that field. Null for any miss."""
    for part in path.split("."):
        if "=" in part:
            field, _, value = part.partition("=")
            rows = F.from_json(document, "array<string>")
            document = F.get(F.filter(rows, lambda x: F.get_json_object(x, f"$.{field}") == value), 0)  # noqa: B023
        elif part.lstrip("-").isdigit():
            rows = F.from_json(document, "array<string>")
            document = F.when(F.size(rows) >= (-int(part) if part[0] == "-" else int(part) + 1), F.element_at(rows, int(part) if part[0] == "-" else int(part) + 1))
        else:
            document = F.get_json_object(document, f"$['{part}']")
    return document


def canonical(row: Column) -> Column:
    """JSON of a struct, nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def ledger(reviews: DataFrame, seed: int, stamp: str) -> DataFrame:
    """Decision records with a digest; the time stamp is given, so a digest can be repeated."""
    r = reviews.select(F.concat_ws(":", F.lit(str(seed)), "analyst", F.col("task").cast("string")).alias("record_id"), F.col("task").cast("string").alias("task_id"), F.col("analyst").alias("analyst_id"), "action", F.array_join("grounds", ",").alias("grounds"), F.array_join("reasons", ",").alias("reasons"), "corrected_verdict", F.lit(stamp).alias("recorded_at"))
    return r.withColumn("digest", F.sha2(canonical(F.struct(*sorted(r.columns))).cast("binary"), 256))


def append_ledger(records: DataFrame, path: str) -> None:
    """One JSON object a line."""
    records.write.mode("append").json(path)


class ScenarioError(ValueError):
    """A scenario that can't be used."""


def _require(ok: bool, why: str) -> None:
    if not ok:
        raise ScenarioError(why)


def check_rendering(text: str, slots: list[str] = SLOTS) -> None:
    """Only plain known names may be filled in: no attributes, indices or conversions."""
    try:
        parts = list(string.Formatter().parse(text))
    except ValueError as e:
        raise ScenarioError(f"no template: {text!r}") from e
    for _, field, _, conversion in parts:
        _require(field is None or (conversion is None and field in slots), f"a slot that isn't allowed in {text!r}")


def validate(s: dict[str, Any]) -> dict[str, Any]:
    """Referential integrity of a scenario: facts, channels, patterns and voices fit together."""
    facts, channels = {f["id"]: f for f in s.get("facts", [])}, {c["id"]: c for c in s.get("channels", [])}
    significant, decoys = set(s["patterns"]["significant"]), [set(d) for d in s["patterns"]["decoys"]]
    _require(len(facts) == len(s.get("facts", [])) and len(channels) == len(s.get("channels", [])), "an id occurs twice")
    _require(bool(significant) and significant <= set(facts), "the pattern has an unknown fact")
    _require(all(d <= set(facts) and not d >= significant for d in decoys) and bool(decoys), "a decoy is unknown or holds the pattern")
    _require(all(set(f["channels"]) <= set(channels) and f["channels"] for f in facts.values()), "a fact has no or an unknown channel")
    _require({c for f in facts.values() for c in f["channels"]} == set(channels), "a channel carries no fact")
    _require(len({(c["sensitivity"], tuple(sorted(c["compartments"]))) for c in channels.values()}) >= 2, "one label for all channels")
    _require(bool(s["scenario"].get("voices")), "no voices")
    for f in facts.values():
        _require(bool(f["renderings"]), f"{f['id']} can't be told")
        for r in f["renderings"]:
            check_rendering(r, s.get("slots", SLOTS))
    return s


def load_scenario(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return validate(tomllib.load(f))


def available(folder: str) -> list[str]:
    """Names of the scenarios in a folder, in order."""
    return sorted(p.stem for p in Path(folder).glob("*.toml"))


def dimensions(spark: SparkSession, s: dict[str, Any]) -> dict[str, DataFrame]:
    """Facts and channels of a scenario as tables."""
    return {
        "facts": spark.createDataFrame([(f["id"], sorted(f["channels"]), list(f["renderings"]), f["id"] in s["patterns"]["significant"]) for f in s["facts"]], "fact_id string, channels array<string>, renderings array<string>, significant boolean"),
        "channels": spark.createDataFrame([(c["id"], c["sensitivity"], sorted(c["compartments"])) for c in s["channels"]], "channel string, sensitivity string, compartments array<string>"),
    }


def summary(s: dict[str, Any]) -> str:
    return json.dumps({"name": s["scenario"]["name"], "facts": len(s["facts"]), "channels": len(s["channels"]), "decoys": len(s["patterns"]["decoys"])}, sort_keys=True)
