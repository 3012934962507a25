"""Shared helpers: tables, shared checkpoint folder, size-checked joins, text input."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.shared import ship as ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); where that is unset, a local one in local mode, else an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


#: Rows that a partition of a narrow intermediate table has at least, where there are more partitions than cores keep busy.
PART = 50_000


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """df in no more partitions than so many narrow rows deserve (None: as it is).

    A file is written for each, and for a file in a local folder Hadoop starts
    processes that, while they start, count as another JVM of the same size.
    """
    return df if rows is None else df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation; rows: see few()."""
    ensure_checkpoint_dir(df.sparkSession)
    return few(df, rows).checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more; it finds them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def store(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new place in the shared folder, and reread."""
    return Kept(df.sparkSession).store(df, name)


class Kept:
    """Tables that a job keeps in the shared folder for a while; drop() deletes one when its last reader is done."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folder = spark, spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.paths: dict[str, str] = {}

    def store(self, df: DataFrame, name: str, rows: int | None = None, plain: str | None = None) -> DataFrame:
        """df written as Parquet under a name of this job's, and reread; rows: see few(); plain: a column of values that hardly repeat, for which no dictionary is tried."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}.parquet"
        writer = few(df, rows).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        (writer if plain is None else writer.option(f"parquet.enable.dictionary#{plain}", "false")).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and shuffle files that nothing refers to."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        tidy(self.spark)


def bounded(df: DataFrame, side: DataFrame, on: str | list[str], how: str, max_rows: int = 1_000_000) -> DataFrame:
    """Join df with side; side is broadcast only if a count shows at most max_rows narrow rows, else both are shuffled."""
    if side.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(side), on, how)
    return df.join(side.hint("merge"), on, how)


def text_of(name: str = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def pieces(rows: Iterator, limit: int = 4096) -> Iterator[list]:
    """Lists of at most limit rows from an iterator."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= limit:
            yield out
            out = []
    if out:
        yield out


def light(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run for mapInArrow, after which its Python worker, which later tasks use again, gives freed memory back to the system."""

    def wrapped(batches: Iterable) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def rewritten(docs: DataFrame, wide: DataFrame) -> DataFrame:
    """docs from wide's _row, with the texts of _text where that isn't null; n_chars, if there, follows the text.

    As rows stand in one column, their names can't clash with others.
    """
    new = F.col("_text")

    def column(name: str) -> Column:
        old = F.col("_row").getField(name)
        if name == "text":
            return F.coalesce(new, old).alias(name)
        if name == "n_chars":
            return F.when(new.isNotNull(), F.char_length(new).cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return wide.select(*map(column, docs.columns))
