"""Sums that reveal no single share: fixed-point numbers in the ring of 2^64, hidden by masks that cancel in pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = 2**64
SCALE = 2**24
LEAST = 3
#: Clients of a cohort on average; fewer than LEAST in one are then as good as impossible.
COHORT = 32
_D = "decimal(38,0)"


def ring(x: Column) -> Column:
    return F.pmod(x.cast(_D), F.lit(str(RING)).cast(_D)).cast(_D)


def max_magnitude(participants: int) -> float:
    """The largest size of a term for which the sum of all terms cannot wrap around."""
    return float(RING // 2 // SCALE) / max(participants, 1)


def encode(x: Column) -> Column:
    """Rounded half to even at 2^-24."""
    return ring(F.rint(x * SCALE).cast(_D))


def decode(x: Column) -> Column:
    """The centred value of a ring element."""
    half, whole = F.lit(str(RING // 2)).cast(_D), F.lit(str(RING)).cast(_D)
    return F.when(x >= half, x - whole).otherwise(x).cast("double") / F.lit(float(SCALE))


def mask(seed: int, low: Column, high: Column, coord: Column) -> Column:
    """A ring element for a pair of clients and a coordinate."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), low.cast("string"), high.cast("string"), coord.cast("string")).cast("binary"))
    word = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast(_D)
    return (word(1) * F.lit(2**32).cast(_D) + word(9)).cast(_D)


def shares(vectors: DataFrame, seed: int, group: list[str]) -> DataFrame:
    """Masked shares (group, client, coord, share) of ``vectors`` (group, client, v).

    Each client adds the masks it has with later clients of its group and subtracts those with earlier ones. The pairs
    are what the protocol exchanges; groups are cohorts of bounded size.
    """
    long = vectors.select(*group, "client", F.posexplode("v").alias("coord", "x"))
    peers = vectors.select(*group, F.col("client").alias("peer"))
    pairs = long.join(peers, group) if group else long.join(peers)
    m = F.when(F.col("peer") > F.col("client"), mask(seed, F.col("client"), F.col("peer"), F.col("coord"))).when(F.col("peer") < F.col("client"), -mask(seed, F.col("peer"), F.col("client"), F.col("coord"))).otherwise(F.lit(0).cast(_D))
    return pairs.groupBy(*group, "client", "coord").agg(F.first("x").alias("x"), F.sum(m).cast(_D).alias("m")).select(*group, "client", "coord", ring(encode(F.col("x")) + F.col("m")).alias("share"))


def reveal(masked: DataFrame, group: list[str], least: int = LEAST) -> DataFrame:
    """(group, coord, total, participants); groups with fewer than ``least`` participants reveal nothing."""
    return masked.groupBy(*group, "coord").agg(F.sum("share").alias("s"), F.count_distinct("client").alias("participants")).where(F.col("participants") >= least).select(*group, "coord", decode(ring(F.col("s"))).alias("total"), "participants")


def secure_sum(vectors: DataFrame, seed: int = 0, group: list[str] | None = None, least: int = LEAST) -> DataFrame:
    group = group or []
    return reveal(shares(vectors, seed, group), group, least)


def _streams(seed: int, key: Column, peers: Column, length: Column) -> Column:
    """For each peer (plus, words): the ring elements that the pair shares, eight coordinates from one hash."""
    digits = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substr(h, 15 * k + 1, F.lit(15)), 16, 10).cast("long"))
    block = lambda p, j: F.sha2(F.concat_ws(":", F.lit(str(seed)), key, F.least("ident", p), F.greatest("ident", p), j.cast("string")).cast("binary"), 512)
    words = lambda p: F.flatten(F.transform(F.transform(F.sequence(F.lit(0), F.floor((length - 1) / 8).cast("int")), lambda j: block(p, j)), digits))
    return F.transform(peers, lambda p: F.struct((F.col("ident") < p).alias("plus"), words(p).alias("words")))


def cohort_sum(vectors: DataFrame, seed: int = 0, group: list[str] | None = None, size: int = COHORT, least: int = LEAST) -> DataFrame:
    """Masked sums of any number of clients: (group, coord, total, participants).

    A group is cut into cohorts by a hash of the client, as many as have ``size`` clients or more on average; groups of
    fewer than twice ``size`` clients are one cohort. In a cohort the clients form a ring and mask with the two next ones
    on either side, so masks grow with the clients alone; one hash masks eight coordinates. Masks cancel within cohorts,
    whose totals are added up; a cohort of fewer than ``least`` clients reveals nothing. Vectors of one client in a group
    are added up before. Null groups are groups, null clients and vectors and empty vectors are left out. Numbers of
    size up to 3e10 can be summed.
    """
    from . import federated as R

    group = group or []
    names = [f"_g{i}" for i in range(len(group))]
    own = vectors.where("client IS NOT NULL AND v IS NOT NULL AND size(v) > 0").select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("client").cast("string").alias("ident"), "v")
    # Null and missing groups as one text, so that groups can be joined and hashed.
    key = F.to_json(F.struct(F.lit(1).alias("g"), *names)).alias("_key")
    own = own.withColumn("_key", key)
    n = own.groupBy("_key").agg(F.greatest(F.floor(F.count_distinct("ident") / size), F.lit(1)).alias("_n"), (F.count("*") > F.count_distinct("ident")).alias("_twice"))
    if n.where("_twice").limit(1).count():
        at = own.select("_key", *names, "ident", F.posexplode("v").alias("i", "x")).groupBy("_key", *names, "ident", "i").agg(F.sum("x").alias("x"))
        own = at.groupBy("_key", *names, "ident").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    dealt = own.join(n, "_key").withColumn("_cohort", F.pmod(F.xxhash64(F.lit(seed), "ident"), F.col("_n")))
    rings = dealt.groupBy("_key", "_cohort").agg(R.ring_of(F.array_sort(F.collect_list("ident"))).alias("ring"))
    peers = rings.select("_key", "_cohort", F.explode("ring").alias("x")).select("_key", F.col("x.who").alias("ident"), "x.peers")
    scope = F.concat_ws(":", "_key", F.col("_cohort").cast("string"))
    rows = dealt.join(peers, ["_key", "ident"]).select(*names, "_key", "_cohort", "ident", "v", _streams(seed, scope, F.col("peers"), F.size("v")).alias("m"))
    turn = lambda m, i: F.when(m["plus"], F.get(m["words"], i)).otherwise(F.lit(1 << R.RING_BITS) - F.get(m["words"], i))
    hidden = F.transform("v", lambda x, i: F.aggregate("m", R.encode(x, SCALE), lambda acc, m: R.added(acc, turn(m, i))))
    sent = rows.select(*names, "_key", "_cohort", F.posexplode(hidden).alias("coord", "share"))
    cells = sent.groupBy(*names, "_key", "_cohort", "coord").agg(F.count("*").alias("participants"), R.ring_sum(F.col("share")).alias("s")).where(F.col("participants") >= least)
    sums = cells.groupBy(*names, "coord").agg(F.sum(R.decode(F.col("s"), SCALE)).alias("total"), F.sum("participants").alias("participants"))
    return sums.select(*[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], "coord", "total", "participants")
