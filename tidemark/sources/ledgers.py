"""A ledger of decisions that takes each record once, however often a batch is written.

A batch is written aside and then moved into place under its number: the move either happens whole or not at all, and a
batch that is in place is never written again. Records that an earlier batch holds are left out by their id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


class LedgerConflict(ValueError):
    """A record differs from the one that the ledger holds under its id."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are in place."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All records, with the number of their batch."""
    there = batches(spark, path)
    if not there:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))
    parts = [spark.read.schema(schema).parquet(f"{path}/batch={b}").withColumn("batch", F.lit(b).cast("bigint")) for b in there]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append(records: DataFrame, path: str, batch: int) -> bool:
    """Adds the records (record_id, digest and others) of a batch; False if that batch is in place already.

    Records of one id within a batch have to agree in their digest, and with what the ledger holds: else LedgerConflict, and
    nothing is added. Records without an id are refused. A run that dies on the way leaves a folder aside that no reader
    sees; the next run of the batch writes it anew. One writer a ledger.
    """
    spark = records.sparkSession
    if batch in batches(spark, path):
        return False
    held = read(spark, path, records.schema).select("record_id", F.col("digest").alias("_held"))
    per = Window.partitionBy("record_id").orderBy("digest", *[c for c in records.columns if c not in ("record_id", "digest")])
    same = Window.partitionBy("record_id")
    marked = records.withColumn("_n", F.row_number().over(per)).withColumn("_d", F.max("digest").over(same) != F.min("digest").over(same))
    marked = marked.where("_n = 1").join(held, "record_id", "left").withColumn("_d", F.col("_d") | F.coalesce(F.col("_held") != F.col("digest"), F.lit(False)))
    aside = f"{path}/.aside-{batch}-{uuid.uuid4().hex}"
    marked.write.parquet(aside)
    bad = spark.read.parquet(aside).where("_d OR record_id IS NULL").select("record_id").limit(3).collect()
    fs, p = _fs(spark, aside)
    if bad:
        fs.delete(p, True)
        raise LedgerConflict(f"records without an id, or with another digest: {[r.record_id for r in bad]}")
    new = f"{path}/.new-{batch}-{uuid.uuid4().hex}"
    spark.read.schema(marked.schema).parquet(aside).where("_held IS NULL").select(*records.columns).write.parquet(new)
    fs.delete(p, True)
    if not fs.rename(_fs(spark, new)[1], _fs(spark, f"{path}/batch={batch}")[1]):
        raise RuntimeError(f"batch {batch} could not be put in place")
    return True


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is replayed after a failure is added once."""
    return lambda records, batch: (append(records, path, batch), None)[1]


def export_lines(records: DataFrame) -> DataFrame:
    """(value): one JSON object a record, nulls kept, ready for ``write.text``."""
    columns = sorted(c for c in records.columns if c != "batch")
    return records.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
