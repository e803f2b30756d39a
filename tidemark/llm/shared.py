"""What the operators share: the folder that all executors see, staged tables, and words."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder

#: ASCII white space; words are the runs between it.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


class Run:
    """What one call has written: nobody else's folders are in it, so calls may run side by side in a session."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def clean(self, spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
        """Deletes what the call has written, once it is used up; ``keep`` are parts of names that stay."""
        for f in [f for f in self.folders if not any(k in f for k in keep)]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            self.folders.remove(f)


_RUN: contextvars.ContextVar[Run | None] = contextvars.ContextVar("run", default=None)


@contextlib.contextmanager
def scope() -> Iterator[Run]:
    """Inside, what this thread stages is noted in a ``Run`` of its own; what is left at the end goes to the run around it."""
    own, outer = Run(), _RUN.get()
    token = _RUN.set(own)
    try:
        yield own
    finally:
        _RUN.reset(token)
        if outer is not None:
            outer.folders.extend(own.folders)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _RUN.get()) is not None:
        own.folders.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when an executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] = lambda: None) -> Callable:
    """For mapInArrow: when a task ends, the worker that goes on forgets what it remembered and gives memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def words(text: Column) -> Column:
    """The runs ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null or blank."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
