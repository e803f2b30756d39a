"""Tables that a call writes on its way: in a folder of the call's own, below the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, as in tests, one of our own on a local master."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """One call's tables. Nobody else's folder is touched, so calls may run side by side in a session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed, written and read again: its lineage ends here."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of this call that nothing reads any more; others are left alone."""
        for t in tables:
            if (path := getattr(t, "_tidemark_path", None)) and path.startswith(self.root + "/"):
                self._delete(path)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Keeps ``df`` and deletes everything else that the call wrote."""
        out = self.keep(df, name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if status.getPath().getName() != out._tidemark_path.rsplit("/", 1)[1]:
                self._delete(status.getPath().toString())
        return out

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
