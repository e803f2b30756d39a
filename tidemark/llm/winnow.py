"""Document fingerprints by winnowing.

A text is lower-cased and cut into units: runs of other characters than ASCII white space, but single characters in
scripts that are written without spaces and in runs of more than ``LONGEST`` characters, such as base64. k-grams of units
get rolling polynomial hashes modulo 2^31 - 1. Of every window of w consecutive hashes the smallest is chosen, the
rightmost among equals, and kept with its position. So any run of w + k - 1 units that two texts share leaves a common
hash in both fingerprints, and nothing shorter than k units does. A text with fewer than k units is one gram, one with
fewer than w grams one window; an empty text has an empty fingerprint. Equal texts have equal fingerprints. Everything is
a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .quality import rolled
from .shared import fresh, words

PRIME = 2**31 - 1
BASE = 1_000_003
#: Units in a gram and grams in a window: both powers of two.
GRAM, WIDTH = 4, 8
#: Longer runs are cut into characters; the last ``LONGEST`` of them stay together.
LONGEST = 24
# Scripts without spaces between words.
UNSPACED = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]
_SCRIPTS = "".join(rf"\p{{Is{s}}}" for s in UNSPACED)
_SPACED = rf"[^\x20\x09-\x0D{_SCRIPTS}]"
UNIT = rf"{_SPACED}{{1,{LONGEST}}}+(?!{_SPACED})|[^\x20\x09-\x0D]"


def units(text: Column) -> Column:
    """The units of a text; none of a null one. Most texts are just split: units are words unless a script or a run says
    otherwise."""
    # All of the scripts lie above U+0E00.
    odd = text.rlike(r"[\x{0E00}-\x{10FFFF}]") | text.rlike(rf"[^\x20\x09-\x0D]{{{LONGEST + 1}}}")
    return F.when(odd, F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).otherwise(words(text))


def _powers(n: int) -> tuple[int, ...]:
    return tuple(2**i for i in range(n.bit_length() - 1))


def add_choices(df: DataFrame, text: str, name: str, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: the chosen grams in order of position, each hash * 2^32 + position (of its first unit, from 0).

    A null text counts as empty and gives an empty array.
    """
    if gram & (gram - 1) or width & (width - 1):
        raise ValueError("gram and width must be powers of two")
    n, h = fresh(df, f"_n_{name}"), fresh(df, f"_h_{name}")
    df = df.withColumn(h, F.transform(units(F.lower(F.col(text))), lambda x: F.xxhash64(x).bitwiseAND(F.lit(2**62 - 1)) % PRIME))
    df = df.withColumn(n, F.size(h))
    for k in _powers(gram):  # a gram of 2k words from two of k: H(a b) = H(a) * BASE^k + H(b)
        up = pow(BASE, k, PRIME)
        df = rolled(df, h, (k,), lambda a, b: (a * F.lit(up) + F.coalesce(b, F.lit(0))) % PRIME)
    last = 2**32 - 1
    grams = F.slice(h, F.lit(1), F.greatest(F.least(F.col(n), F.lit(1)), F.col(n) - (gram - 1)))
    # The smaller of two such numbers has the smaller hash or, of equal hashes, the place further right.
    df = df.withColumn(h, F.transform(grams, lambda x, i: x * F.lit(2**32) + (F.lit(last) - i)))
    df = df.withColumn(n, F.size(h))
    df = rolled(df, h, _powers(width), lambda a, b: F.least(a, b))
    kept = F.array_distinct(F.slice(h, F.lit(1), F.greatest(F.least(F.col(n), F.lit(1)), F.col(n) - (width - 1))))
    return df.withColumn(name, F.transform(kept, lambda x: x + (F.lit(last) - 2 * (x % F.lit(2**32))))).drop(n, h)


def hashes(choices: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(choices, lambda x: F.shiftright(x, 32)))


def as_string(choices: Column) -> Column:
    """``hash@position`` of every choice, hashes in hexadecimal."""
    return F.array_join(F.transform(choices, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"), (x % F.lit(2**32)).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _below(cuts: list[int], value: Column, step: int = 64) -> Column:
    """How many of the sorted ``cuts`` are below ``value``: first among every ``step``-th, then within that stretch."""
    count = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    if not cuts:
        return F.lit(0)
    whole = F.array(*[F.lit(c).cast("long") for c in cuts])
    heads = F.array(*[F.lit(c).cast("long") for c in cuts[::step]])
    start = F.greatest(count(heads) - 1, F.lit(0)) * step
    return start + count(F.slice(whole, start + 1, F.lit(step)))


def in_stretches(docs: DataFrame, ident: str, stretches: int | None = None) -> tuple[DataFrame, str, str]:
    """Rows dealt out by stretch of ascending ``ident``, with the names of two added columns: stretch, and ghost.

    Ids are cut into ``stretches`` by quantiles, each to be ordered on its own, and the first rows of a stretch are also
    sent, as ghosts, to the one before it (those of the first to the last). So no task holds all rows; the driver keeps
    one id a stretch. Null ids come first.
    """
    spark = docs.sparkSession
    stretches = stretches or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    b, ghost, low = fresh(docs, "_stretch"), fresh(docs, "_ghost"), fresh(docs, "_low")
    at = [i / stretches for i in range(1, stretches)]
    cuts = docs.agg(F.percentile_approx(ident, F.array(*map(F.lit, at)), max(10_000, 4 * stretches))).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    place = F.coalesce(_below(cuts, F.col(ident)), F.lit(0)).alias(b)
    firsts = {r[0]: (None if r[2] else r[1]) for r in docs.select(F.col(ident).cast("long").alias(low), place).groupBy(b).agg(F.min(low), F.max(F.col(low).isNull())).collect()}
    order = sorted(firsts)
    before = {k: order[i - 1] for i, k in enumerate(order)}
    lows = F.array(*[F.lit(firsts.get(k)).cast("long") for k in range(len(cuts) + 1)])
    backs = F.array(*[F.lit(before.get(k, 0)) for k in range(len(cuts) + 1)])
    placed = docs.select("*", place)
    first = F.col(ident).cast("long").eqNullSafe(F.get(lows, F.col(b)))
    own = F.struct(F.col(b).alias("b"), F.lit(False).alias("g"))
    sent = F.explode(F.when(first, F.array(own, F.struct(F.get(backs, F.col(b)).alias("b"), F.lit(True).alias("g")))).otherwise(F.array(own)))
    sent_rows = placed.select("*", sent.alias(ghost)).select(*docs.columns, F.col(f"{ghost}.b").alias(b), F.col(f"{ghost}.g").alias(ghost))
    return sent_rows.repartition(b), b, ghost


def next_of(rows: DataFrame, ident: str, carry: list[str], b: str, ghost: str, ties: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for each c of ``carry``: that column of the next row in ascending ``ident``; the last row's next is the
    first. Rows of one id follow ``ties``. ``rows`` come from ``in_stretches``, whose ghosts are dropped here."""
    order = Window.partitionBy(b).orderBy(ghost, F.asc_nulls_first(ident), *[F.asc_nulls_first(c) for c in ties])
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry]).where(~F.col(ghost)).drop(b, ghost)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every whole text and of its edited text (see ``queries.op4_winnowing``), with likenesses.

    Reads doc_id (a number) and text; other columns may have any name. Null texts count as empty; null ids come first, rows of
    one id follow in the order of their texts, and rows that are equal too in any order, which gives the same rows. Texts
    of any length are taken whole. A table of one row is edited with itself, an empty one gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, b, ghost = in_stretches(base, "doc_id")
    rows = add_choices(rows, "text", "own")
    rows = rows.withColumn("own_set", hashes(F.col("own")))
    rows = next_of(rows, "doc_id", ["text", "own_set"], b, ghost, ["text"])
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = add_choices(rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "own_set", "next_own_set", "edited"), "edited", "other")
    rows = rows.withColumn("other_set", hashes(F.col("other")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("other_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_own_set")).alias("near_next"),
    )
