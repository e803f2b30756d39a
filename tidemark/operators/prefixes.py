"""From which size on does a table tell no more? The structure of reachable sets over nested prefixes.

What clearances reach changes only where a label appears for the first time. So one pass finds where each of the at most 64
labels appears first, a second counts the tasks up to each of these places, and every prefix follows from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import labels as L


def appearances(tasks: DataFrame) -> DataFrame:
    """(sens, mask, at): how many tasks there are up to a label's first one, by task; ``tasks`` has task, sens, mask.

    Tasks are counted between the first places, which are few; none is put in order.
    """
    firsts = tasks.groupBy("sens", "mask").agg(F.min("task").alias("first"))
    marks = F.broadcast(firsts.agg(F.array_sort(F.collect_list("first")).alias("marks")))
    # The last mark that a task has reached; the first task of all reaches the first.
    reached = F.array_max(F.filter("marks", lambda m: m <= F.col("task")))
    counts = tasks.select("task").distinct().join(marks).groupBy(reached.alias("mark")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("mark")) - F.col("n"))
    return firsts.join(before, F.col("first") == F.col("mark")).select("sens", "mask", (F.col("before") + 1).alias("at"))


def structures(tasks: DataFrame, sizes: list[int], ruling: L.Ruling = L.KEEP) -> DataFrame:
    """(size, labels, distinct_sets, unique_sets, largest) of the first ``size`` tasks, for every size that the table has.

    Labels count after the ruling, as enumerated values. Of the 64 clearances, those that reach the same labels reach the
    same tasks: ``unique_sets`` are reached by one compartment set alone, ``largest`` by most.
    """
    spark = tasks.sparkSession
    told = tasks.select("task", L.declassify(L.label(F.col("sens"), F.col("mask"), 0), ruling).alias("l")).select("task", "l.sens", "l.mask")
    n = tasks.select("task").distinct().count()
    known = [s for s in sorted(set(sizes)) if s <= n]
    grid = spark.createDataFrame([(s,) for s in known], "size int")
    there = F.broadcast(appearances(told)).join(grid, F.col("at") <= F.col("size"))
    labels = there.groupBy("size").agg(F.count("*").alias("labels"))
    every = L.candidates(spark)
    reach = there.join(F.broadcast(every), (F.col("c_sens") >= F.col("sens")) & (F.col("mask").bitwiseAND(F.bitwise_not("c_mask")) == 0))
    sets = reach.groupBy("size", "c_sens", "c_mask").agg(F.array_sort(F.collect_set(F.col("sens") * 16 + F.col("mask"))).alias("cells"))
    all_sets = grid.join(F.broadcast(every)).join(sets, ["size", "c_sens", "c_mask"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<int>")))
    same = all_sets.groupBy("size", "cells").agg(F.count_distinct("c_mask").alias("n"))
    out = same.groupBy("size").agg(F.count("*").alias("distinct_sets"), F.sum((F.col("n") == 1).cast("long")).alias("unique_sets"), F.max("n").alias("largest"))
    return out.join(labels, "size", "left").select("size", F.coalesce("labels", F.lit(0)).alias("labels"), "distinct_sets", "unique_sets", "largest")


def saturates(grid: DataFrame) -> DataFrame:
    """``grid`` with ``settled``: neither this size nor a larger one differs from the largest; the first such size is where
    the structure saturates. One row a size, so the window is small."""
    shape = F.struct("labels", "distinct_sets", "unique_sets", "largest")
    last = F.last(shape).over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = Window.orderBy("size").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return grid.withColumn("_same", shape == last).withColumn("settled", F.min("_same").over(after)).drop("_same")
