"""Reading the tables that the operators take."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; beside the warehouse where it names none."""
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: they stay on disk as long as the driver's memory holds their plans."""
    gc.collect()
    spark.range(1).count()  # Spark's listeners hold the plan of the query that ended last
    spark._jvm.System.gc()


#: What stored() made within the innermost alone().
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared scratch folder and read again: no lineage, and any executor can read it."""
    tidy(df.sparkSession)
    path = f"{scratch(df.sparkSession).rstrip('/')}/rippleframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    session = df.sparkSession
    at = session._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    at.getFileSystem(session._jsc.hadoopConfiguration()).delete(at, True)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a table of stored(); the others that were stored on the way to it are deleted."""
    token = _made.set(made := [])
    try:
        out = make()
        out = out if hasattr(out, "_stored_at") else stored(out)
    finally:
        _made.reset(token)
    for df in made:
        if df._stored_at != out._stored_at:
            discard(df)
    if (outer := _made.get()) is not None:
        outer.append(out)
    return out


def give_back() -> None:
    """Returns to the system what this Python worker has freed: workers are used again, and otherwise keep the most that any task held."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema), after whose tasks their workers give their memory back."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidied, schema)


def map_groups(groups: GroupedData, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """groups.applyInArrow(run, schema), after each of whose groups the worker gives its memory back."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    def tidied_with_key(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            give_back()

    return groups.applyInArrow(tidied if run.__code__.co_argcount == 1 else tidied_with_key, schema)


#: Rows that travel to Python in one Arrow batch of the pipeline: some MB of text.
ARROW_ROWS = 2048


def small_batches(spark: SparkSession, most: int = ARROW_ROWS) -> None:
    """From now on Arrow batches of this session have at most so many rows; a smaller number that is set stays.

    A batch of whole texts is held by the JVM's direct memory and by the worker at once, and both keep
    what the largest batch took.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, as doc_id and text; a null text becomes empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Ids that a semi-join may send to every task: 16 MB of longs.
BROADCAST_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose id is among the stored ids: their number is counted first, up to `most` are sent to the tasks, more are joined by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, on: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose id is not among the stored ids, in the way of with_ids(); rows with a null id stay."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, on, "left_anti")
