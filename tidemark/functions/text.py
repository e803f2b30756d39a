"""Text functions: shape features, fact detection, verdict parsing, prompts and their perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rng import choice

# For each fact the terms of which any one in the text asserts it.
FACT_TERMS = {
    "draft_mismatch": ["draft", "freeboard"],
    "course_deviation": ["course altered", "heading of", "track turned", "degrees off", "divergence"],
    "unlit_contact": ["unlit", "no lights", "without lights"],
    "pilot_absent": ["pilot"],
    "crew_substitution": ["engineer", "substitution"],
    "certificate_unresolved": ["certificate", "registry"],
    "berth_closure": ["berth", "maintenance"],
    "demurrage_dispute": ["demurrage"],
    "reflagging": ["reflag", "changed flag", "change flag", "flag changes"],
    "ship_transfer_claim": ["transfer", "ship-to-ship"],
    "shoal_activity": ["shoal", "small-craft", "small craft"],
    "inspection_history": ["inspection", "port state"],
    "routine_transit": ["knots", "outbound transit"],
    "cargo_declared": ["cargo declared", "declared cargo", "manifest line"],
    "weather_note": ["visibility", "sea state"],
}
# Phrases of headers and closings, blanked in this order before terms are looked for.
BOILERPLATE = [
    "general cargo", "refrigerated cargo", "bulk carrier", "product tanker", "container feeder", "flag panama", "flag liberia", "flag malta", "flag marshall islands", "flag cyprus",
    "watch center", "vessel report", "sensor track", "port notice", "crew manifest", "press item", "liaison tip", "detention record", "partner report",
]
FACTS = list(FACT_TERMS)
# The three facts that are significant together.
PATTERN = ["draft_mismatch", "course_deviation", "unlit_contact"]


def shape(text: Column) -> dict[str, Column]:
    """Counts and ratios that tell how a text is shaped, not what it says. ASCII digits, Unicode upper case."""
    n = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    sentences = F.size(F.filter(F.split(text, r"\."), lambda x: F.regexp_replace(x, r"\s", "") != ""))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "char_len": F.char_length(text).cast("double"),
        "word_count": F.size(words).cast("double"),
        "sentence_count": sentences.cast("double"),
        "mean_sentence_len": F.size(words) / F.greatest(sentences, F.lit(1)).cast("double"),
        "digit_ratio": share(r"[0-9]"),
        "upper_ratio": share(r"\p{Lu}"),
        "punct_ratio": share(r"[.,;:()/\-]"),
        "has_timestamp": F.exists(words, lambda w: w.rlike(r"^[0-9]+Z$")).cast("double"),
    }


def place(value: Column, names: list[str]) -> Column:
    """The place of a category among its sorted names, as a number; null if it isn't one of them."""
    at = F.array_position(F.array(*[F.lit(n) for n in sorted(names)]), value)
    return F.when(at > 0, (at - 1).cast("double"))


def report_shape(text: Column, report_type: Column, voice: Column, types: list[str], voices: list[str]) -> dict[str, Column]:
    """All ten features that a probe of shape may use: those of the text, and the places of report type and voice."""
    return shape(text) | {"report_type_id": place(report_type, types), "voice_id": place(voice, voices)}


def strip_boilerplate(lowered: Column) -> Column:
    for phrase in BOILERPLATE:
        lowered = F.replace(lowered, F.lit(phrase), F.lit(" "))
    return lowered


def detect_facts(text: Column, terms: dict[str, list[str]] = FACT_TERMS) -> Column:
    """Ids of the facts that a text asserts, in the order of the table; none for a null text."""
    hit = lambda t, words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    found = lambda t: F.array_compact(F.array(*[F.when(hit(t, words), F.lit(fact)) for fact, words in terms.items()]))
    # As the element of an array the stripped text is made once for all terms.
    return F.transform(F.array(strip_boilerplate(F.lower(F.coalesce(text, F.lit(""))))), found)[0]


def parse_verdict(text: Column, marker: str | None = "VERDICT") -> Column:
    """True for SIGNIFICANT, false for ROUTINE, after the last marker; null if both or neither are said."""
    up = F.upper(text)
    tail = F.substring_index(up, marker, -1) if marker else up
    yes, no = tail.contains("SIGNIFICANT"), tail.contains("ROUTINE")
    return F.when(yes != no, yes)


def verdict_text(verdict: Column) -> Column:
    return F.when(verdict, "SIGNIFICANT").otherwise("ROUTINE")


def numbered(texts: Column, sep: str = "\n\n") -> Column:
    """``[1] ...`` for each text of an array."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), sep)


def without(texts: Column, dropped: Column | int) -> Column:
    """The array without the text at one index, to be numbered anew."""
    return F.filter(texts, lambda x, i: i != dropped)


def prompt(target: Column, shots: Column, preamble: str, instruction: str) -> Column:
    """Worked examples (an array of struct<texts, verdict>), then the target's texts and the instruction."""
    case = lambda s, i: F.concat(F.lit("--- CASE "), (i + 1).cast("string"), F.lit(" ---\n"), numbered(s["texts"]), F.lit("\nOFFICER'S VERDICT: "), verdict_text(s["verdict"]), F.lit("\n"))
    some = F.concat(F.array(F.lit(preamble)), F.transform(shots, case), F.array(F.lit("--- NEW CASE ---")))
    head = F.when(F.size(shots) > 0, some).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.array(numbered(target), F.lit(instruction))), "\n\n")


def balanced_shots(pool: DataFrame, k: int, order: str, verdict: str) -> DataFrame:
    """k rows that alternate between the classes, true first; the rest comes from one class when the other is used up."""
    from pyspark.sql import Window

    both = pool.withColumn("_rank", F.row_number().over(Window.partitionBy(verdict).orderBy(order))).where(F.col("_rank") <= k)  # the limit is pushed below the shuffle
    place = 2 * F.col("_rank") - F.when(F.col(verdict), 1).otherwise(0)
    return both.withColumn("_place", place).orderBy("_place").limit(k).drop("_rank", "_place")


# Terms and the phrases that may stand for them.
SYNONYMS = {
    "deviation": ["course offset", "bearing drift", "heading variance"],
    "draft": ["freeboard", "submerged depth", "hull waterline"],
    "unlit": ["darkened ship", "running lights extinguished", "blackout vessel"],
}


def substitute(text: Column, key: Column, seed: int = 42, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Replaces terms, found in any case but replaced as they are written, by a synonym drawn by key."""
    for term, others in synonyms.items():
        drawn = F.get(F.array(*map(F.lit, others)), choice(len(others), seed, key, term).cast("int"))
        text = F.when(F.lower(text).contains(term), F.replace(text, F.lit(term), drawn)).otherwise(text)
    return text


def inject(texts: Column, key: Column, decoy: str, seed: int = 42) -> Column:
    """Appends a decoy to one text of the array, drawn by key."""
    at = F.pmod(choice(2**31, seed, key, "decoy"), F.greatest(F.size(texts), F.lit(1)))
    return F.transform(texts, lambda x, i: F.when(i == at, F.concat(x, F.lit(" "), F.lit(decoy))).otherwise(x))
