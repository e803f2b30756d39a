"""Who may contribute what, what contributions reveal, and controls against it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels as L
from ..functions.rng import Draws, below, uniform
from ..ship import ship

OPEN_CEILING = (0, 0)
#: The fewest and most analysts of one block of pairs, its tasks, and the most partitions a side.
PEOPLE, CROWD, TASKS, SIDES = 64, 4096, 65536, 64


def label_cells(tasks: DataFrame, ruling: L.Ruling, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """Releasable labels among the tasks: at most 4 x 16 rows (sens, mask) however many tasks there are."""
    cells = tasks.select("sens", "mask").distinct()
    return cells.where(L.eligible(L.label(F.col("sens"), F.col("mask")), L.label(*ceiling), ruling))


def reachable_cells(holders: DataFrame, cells: DataFrame, sens: str, mask: str) -> DataFrame:
    """Holders joined with the labels they dominate. ``cells`` has at most 64 rows, so it is broadcast."""
    t = F.broadcast(cells.select(F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask")))
    return holders.join(t, (F.col(sens) >= F.col("t_sens")) & (F.col("t_mask").bitwiseAND(F.bitwise_not(F.col(mask))) == 0))


def contribute(fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """Rows (analyst, pseudonym, task) for every task that the analyst may read and whose verdict may be shared.

    The theta join runs over labels, of which there are few; tasks are then joined by equal labels.
    """
    open_ = reachable_cells(fleet, label_cells(tasks, ruling, ceiling), "sens", "mask").select("analyst", "pseudonym", "t_sens", "t_mask")
    return open_.join(tasks.select("task", F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask")), ["t_sens", "t_mask"]).select("analyst", "pseudonym", "task")


def readership(fleet: DataFrame, tasks: DataFrame) -> DataFrame:
    """How many analysts can read each task, once per distinct label."""
    cells = tasks.select("sens", "mask").distinct()
    n = reachable_cells(fleet, cells, "sens", "mask").groupBy("t_sens", "t_mask").agg(F.count_distinct("analyst").alias("readers"))
    per = cells.join(n, (cells.sens == n.t_sens) & (cells["mask"] == n.t_mask), "left").select("sens", "mask", F.coalesce("readers", F.lit(0)).alias("readers"))
    return tasks.join(F.broadcast(per), ["sens", "mask"]).select("task", "sens", "mask", "readers")


def observed(stream: DataFrame) -> DataFrame:
    return stream.groupBy("pseudonym").agg(F.array_sort(F.collect_set("task")).alias("tasks"))


def open_cells(fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """What ``contribute`` gives, by label instead of by task: (analyst, pseudonym, t_sens, t_mask, size, first, last).

    At most 64 rows an analyst however many tasks there are; counts over contributions are sums of ``size``.
    """
    sizes = tasks.groupBy(F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask")).agg(F.count("*").alias("size"), F.min("task").alias("first"), F.max("task").alias("last"))
    cells = reachable_cells(fleet, label_cells(tasks, ruling, ceiling), "sens", "mask")
    return cells.join(F.broadcast(sizes), ["t_sens", "t_mask"]).select("analyst", "pseudonym", "t_sens", "t_mask", "size", "first", "last")


def task_reach(fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """(task, n, rows): distinct analysts who contribute to each task, and contributions; tasks without any have no row."""
    per = open_cells(fleet, tasks, ruling, ceiling).groupBy("t_sens", "t_mask").agg(F.count_distinct("analyst").alias("n"), F.count("*").alias("rows"))
    keyed = tasks.select("task", F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask"))
    return keyed.join(F.broadcast(per), ["t_sens", "t_mask"]).select("task", "n", "rows")


def link(stream: DataFrame, fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """The linkage attack on a stream of contributions, as a control may have left it; see ``linked``."""
    per_task = stream.select("pseudonym", "task").distinct().join(tasks, "task")
    seen = per_task.groupBy("pseudonym", F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask")).agg(F.count("*").alias("k"))
    return linked(seen, stream.select("analyst", "pseudonym").distinct(), fleet, tasks, ruling, ceiling)


def link_open(fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """The linkage attack on all contributions, from labels alone: a pseudonym has all tasks of a label or none."""
    open_ = open_cells(fleet, tasks, ruling, ceiling)
    seen = open_.select("pseudonym", "t_sens", "t_mask", F.col("size").alias("k")).distinct()
    return linked(seen, open_.select("analyst", "pseudonym").distinct(), fleet, tasks, ruling, ceiling)


def linked(seen: DataFrame, active: DataFrame, fleet: DataFrame, tasks: DataFrame, ruling: L.Ruling, ceiling: tuple[int, int]) -> DataFrame:
    """For each pseudonym, the clearances whose reachable tasks are most like what was seen.

    ``seen`` is (pseudonym, t_sens, t_mask, k): distinct tasks by label; ``active`` the (analyst, pseudonym) who spoke.
    Jaccard counts are sums over labels (at most 64) rather than over tasks: a candidate reaches all tasks of a label or
    none. Returns analyst, pseudonym, silent, score, tied (distinct compartment sets at the top score), crowd (analysts who
    share the pseudonym), anonymity, inferred (smallest mask by size, then value) and exact. No overlap scores 0.
    """
    spark = seen.sparkSession
    cells = label_cells(tasks, ruling, ceiling)
    sizes = tasks.groupBy(F.col("sens").alias("t_sens"), F.col("mask").alias("t_mask")).agg(F.count_distinct("task").alias("size"))
    reach = reachable_cells(L.candidates(spark), cells, "c_sens", "c_mask").join(F.broadcast(sizes), ["t_sens", "t_mask"])
    reach_n = L.candidates(spark).join(reach.groupBy("c_sens", "c_mask").agg(F.sum("size").alias("reach")), ["c_sens", "c_mask"], "left").select("c_sens", "c_mask", F.coalesce("reach", F.lit(0)).alias("reach"))
    both = seen.join(F.broadcast(reach.select("c_sens", "c_mask", "t_sens", "t_mask")), ["t_sens", "t_mask"]).groupBy("pseudonym", "c_sens", "c_mask").agg(F.sum("k").alias("both"))
    total = seen.groupBy("pseudonym").agg(F.sum("k").alias("seen"))
    grid = total.join(F.broadcast(reach_n)).join(both, ["pseudonym", "c_sens", "c_mask"], "left")  # 64 rows a pseudonym
    shared = F.coalesce("both", F.lit(0))
    union = F.col("seen") + F.col("reach") - shared
    scored = grid.withColumn("score", F.when(union == 0, 0.0).otherwise(shared / union))
    order = Window.partitionBy("pseudonym")
    top = scored.withColumn("best", F.max("score").over(order)).where("score = best").groupBy("pseudonym").agg(F.first("best").alias("score"), F.count_distinct("c_mask").alias("tied"), F.min(F.struct(F.bit_count("c_mask").alias("n"), F.col("c_mask").alias("m"))).alias("least"))
    crowd = active.groupBy("pseudonym").agg(F.count_distinct("analyst").alias("crowd"))
    out = fleet.select("analyst", "mask").join(active, "analyst", "left").join(top, "pseudonym", "left").join(crowd, "pseudonym", "left")
    silent = F.col("score").isNull()
    return out.select(
        "analyst", "pseudonym", silent.alias("silent"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tied", F.lit(0)).alias("tied"), F.coalesce("crowd", F.lit(0)).alias("crowd"),
        F.coalesce(F.col("tied") * F.col("crowd"), F.lit(0)).alias("anonymity"), F.col("least.m").alias("inferred"), (~silent & (F.col("tied") == 1) & (F.col("crowd") == 1) & (F.col("least.m") == F.col("mask"))).alias("exact"),
    )


def identifiability(tasks: DataFrame, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """Candidates collapsed by equal reachable sets: distinct sets, how many one compartment set alone has, the largest."""
    spark = tasks.sparkSession
    cells = label_cells(tasks, ruling, ceiling)
    reach = L.candidates(spark).join(reachable_cells(L.candidates(spark), cells, "c_sens", "c_mask"), ["c_sens", "c_mask"], "left")
    # Sets of tasks are equal exactly if the sets of their labels are.
    sets = reach.groupBy("c_sens", "c_mask").agg(F.array_sort(F.collect_set(F.when(F.col("t_sens").isNotNull(), F.col("t_sens") * 16 + F.col("t_mask")))).alias("cells"))
    same = sets.groupBy("cells").agg(F.count_distinct("c_mask").alias("n"))
    return same.agg(F.count("*").alias("distinct_sets"), F.sum((F.col("n") == 1).cast("int")).alias("unique_sets"), F.max("n").alias("largest"))


def k_anonymity(stream: DataFrame, k: int) -> DataFrame:
    """Rows of tasks with at least k distinct analysts."""
    wide = stream.groupBy("task").agg(F.count_distinct("analyst").alias("n")).where(F.col("n") >= k).select("task")
    return stream.join(wide, "task", "left_semi")


def widest(reach: DataFrame, keep: float) -> DataFrame:
    """The max(1, int(n * keep)) tasks of ``reach`` (task, n, ...) with the widest reach, ties by task.

    The number of tasks at each reach tells which reach is cut through; only that reach is put in order.
    """
    hist = reach.groupBy("n").agg(F.count("*").alias("k"))
    upto = Window.orderBy(F.desc("n"))
    room = F.greatest(F.lit(1), F.floor(F.sum("k").over(Window.partitionBy()) * keep))
    room = hist.select("n", "k", (room - (F.sum("k").over(upto) - F.col("k"))).alias("room")).where("room > 0")
    placed = reach.join(F.broadcast(room), "n")
    cut = placed.where("k > room").withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy("task"))).where("place <= room")
    return placed.where("k <= room").select(*reach.columns).unionByName(cut.select(*reach.columns))


def rarity_suppression(stream: DataFrame, keep: float) -> DataFrame:
    """Rows of the tasks with the widest reach; see ``widest``."""
    return stream.join(widest(stream.groupBy("task").agg(F.count_distinct("analyst").alias("n")), keep).select("task"), "task", "left_semi")


def subsample(stream: DataFrame, keep: float, seed: int = 7) -> DataFrame:
    return stream.where(uniform(seed, F.col("analyst"), F.col("task")) < keep)


def pool(stream: DataFrame) -> DataFrame:
    return stream.withColumn("pseudonym", F.lit("POOLED"))


def label_noise(rows: DataFrame) -> DataFrame:
    """Share of randomised contributions (as ``participation`` gives them) on tasks that their analyst can't read; 0 of none."""
    return rows.agg(F.coalesce(F.avg((~F.col("readable")).cast("double")), F.lit(0.0)).alias("noise"), F.count("*").alias("n"))


def noise_of(counts: DataFrame) -> DataFrame:
    """``label_noise`` from ``drawn_counts``."""
    return counts.agg(F.coalesce(F.sum("unreadable") / F.sum("n"), F.lit(0.0)).alias("noise"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


CONTROLS = {"k_anonymity": k_anonymity, "rarity_suppression": rarity_suppression, "subsample": subsample, "pooling": lambda s: pool(s)}


def separation(fleet: DataFrame, tasks: DataFrame) -> DataFrame:
    """The most tasks that one of two analysts can read and the other can't, over distinct clearances (at most 64)."""
    sizes = tasks.groupBy("sens", "mask").agg(F.count("*").alias("size"))
    kinds = fleet.select("sens", "mask").distinct()
    can = lambda c: F.when((F.col(f"{c}.sens") >= F.col("t.sens")) & (F.col("t.mask").bitwiseAND(F.bitwise_not(F.col(f"{c}.mask"))) == 0), 1).otherwise(0)
    pairs = kinds.alias("a").join(F.broadcast(kinds.alias("b")), F.struct("a.sens", "a.mask") < F.struct("b.sens", "b.mask"))
    apart = pairs.join(F.broadcast(sizes.alias("t"))).groupBy("a.sens", "a.mask", "b.sens", "b.mask").agg(F.sum(F.abs(can("a") - can("b")) * F.col("t.size")).alias("n"))
    return apart.agg(F.coalesce(F.max("n"), F.lit(0)).alias("widest"))


def epsilon(keep: Column, fabricate: Column) -> Column:
    """Of randomised response; infinite if a row can't be fabricated or is always kept."""
    bound = F.log(F.greatest(keep / fabricate, (1 - fabricate) / (1 - keep)))
    return F.when((fabricate <= 0) | (keep >= 1), F.lit(float("inf"))).otherwise(bound)


def composed(eps: Column, k: Column, delta: float = 1e-5) -> dict[str, Column]:
    """Basic and advanced composition over k indicators, and the smaller of both."""
    basic = k * eps
    advanced = F.sqrt(2 * k * math.log(1 / delta)) * eps + k * eps * (F.exp(eps) - 1)
    return {"basic": basic, "advanced": advanced, "effective": F.least(basic, advanced)}


def participation(fleet: DataFrame, tasks: DataFrame, keep: float, fabricate: float, seed: int = 7, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING) -> DataFrame:
    """Randomised response over all analyst and task pairs: a true contribution stays with probability ``keep``, another
    is made up with ``fabricate`` and a coin for its verdict. The pairs themselves are what is asked for."""
    able = (F.col("f.sens") >= F.col("t.sens")) & (F.col("t.mask").bitwiseAND(F.bitwise_not(F.col("f.mask"))) == 0)
    shared = able & L.eligible(L.label(F.col("t.sens"), F.col("t.mask")), L.label(*ceiling), ruling)
    draw = uniform(seed, F.col("analyst"), F.col("task"), "part")
    rows = fleet.alias("f").join(tasks.alias("t"), (draw < F.when(shared, keep).otherwise(fabricate)), "inner")
    return rows.select("analyst", "pseudonym", "task", shared.alias("genuine"), able.alias("readable"), (uniform(seed, F.col("analyst"), F.col("task"), "coin") < 0.5).alias("coin"))


def _packed(rows: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """One row of arrays for about ``size`` rows, or for up to ``most`` if there are more than 16 such; blocks are dealt to
    at most ``SIDES`` partitions."""
    n = rows.count()
    blocks = max(1, -(-n // min(max(size, -(-n // 16)), most)))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(blocks))).repartition(min(blocks, SIDES), "_b")
    c = dealt.groupBy("_b").agg(F.collect_list(F.struct(*rows.columns)).alias("_c"))
    return c.select(F.col("_b").alias(f"{key}_block"), *[F.col(f"_c.{x}").alias(f"{key}_{x}") for x in rows.columns])


def _drawn(keep: float, fabricate: float, seed: int, tail: str, coin: str):
    yes, made_up = below(keep), below(fabricate)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for f in frames:
            for row in f.itertuples(index=False):
                if row.task_block != block:
                    block = row.task_block
                    t, t_sens, t_mask, t_open = (np.asarray(x) for x in (row.task_task, row.task_sens, row.task_mask, row.task_open))
                    draws, coins = Draws(t, tail.encode()), Draws(t, coin.encode())
                people = np.asarray(row.analyst_analyst, object), np.asarray(row.analyst_sens), np.asarray(row.analyst_mask)
                out = []
                # What a clearance reads is found out once for all who have it.
                for sens, mask in sorted(set(zip(people[1].tolist(), people[2].tolist(), strict=True))):
                    able = (t_sens <= sens) & ((t_mask & ~mask) == 0)
                    shared = able & t_open
                    own, toss, limit = draws, coins, np.where(shared, np.uint64(yes), np.uint64(made_up))
                    if fabricate <= 0:  # nothing else can be drawn
                        own, toss, able, limit = Draws(t[shared], tail.encode()), Draws(t[shared], coin.encode()) if coin else None, able[shared], np.uint64(yes)
                        shared = shared[shared]
                    if (top := int(limit.max(initial=0))) < 1 << 32:
                        limit = limit.astype(np.uint32)
                    for who in people[0][(people[1] == sens) & (people[2] == mask)]:
                        prefix = f"{seed}:{who}:"
                        here = own.under(prefix) < limit
                        n = int(np.count_nonzero(here)) if top else 0
                        if n:
                            heads = int(np.count_nonzero(toss.under(prefix, here) < np.uint32(1 << 31))) if coin else 0
                            out.append((who, n, int(np.count_nonzero(here & shared)), int(np.count_nonzero(here & ~able)), heads))
                yield pd.DataFrame(out, columns=["analyst", "n", "genuine", "unreadable", "heads"])

    return run


def drawn_counts(fleet: DataFrame, tasks: DataFrame, keep: float, fabricate: float, seed: int = 7, ruling: L.Ruling = L.DROP, ceiling: tuple[int, int] = OPEN_CEILING, tail: str = ":part", coin: str = ":coin") -> DataFrame:
    """(analyst, n, genuine, unreadable, heads): what ``participation`` gives, counted by analyst; who takes no part has no row.

    Every pair is drawn, a block of analysts with a block of tasks at a time: only sums by analyst leave a block. With
    ``tail`` and ``coin`` empty and nothing fabricated these are the contributions that ``subsample`` leaves. Tasks are
    whole numbers; rows without analyst, task or label are left out.
    """
    ship(fleet.sparkSession)
    known = lambda df, *cs: df.where(" AND ".join(f"{c} IS NOT NULL" for c in cs)).select(*cs)
    open_ = L.eligible(L.label(F.col("sens"), F.col("mask")), L.label(*ceiling), ruling).alias("open")
    people = _packed(known(fleet, "analyst", "sens", "mask"), "analyst", PEOPLE, CROWD)
    work = _packed(known(tasks, "task", "sens", "mask").select("*", open_), "task", TASKS, TASKS)
    kind = fleet.schema["analyst"].dataType.simpleString()
    pairs = work.crossJoin(people.hint("shuffle_replicate_nl"))
    per = pairs.mapInPandas(_drawn(keep, fabricate, seed, tail, coin), f"analyst {kind}, n bigint, genuine bigint, unreadable bigint, heads bigint")
    return per.groupBy("analyst").agg(*[F.sum(c).alias(c) for c in ("n", "genuine", "unreadable", "heads")])


def value_noise(stream: DataFrame, flip: float, seed: int = 7) -> DataFrame:
    return stream.withColumn("verdict", F.col("verdict") != (uniform(seed, F.col("who"), F.col("task")) < flip))


def link_trials(links: DataFrame) -> DataFrame:
    """(task, outcome): one trial an analyst, whether they were named exactly. Analysts are the clusters: tasks are shared by
    the whole fleet, so drawing tasks anew would draw the same people many times. Silent ones are not named."""
    return links.select(F.col("analyst").alias("task"), F.col("exact").alias("outcome"))
