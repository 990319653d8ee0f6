"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local master, whose executors are this process, may go without one; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wireloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder that holds all tables of this application; ``clear`` removes it."""
    return f"{shared_dir(spark)}/wireloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, what: str) -> str:
    return f"{run_dir(spark)}/{uuid.uuid4().hex}/{what}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, once no result that it gave is read any more."""
    remove(spark, run_dir(spark))


def cut(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df in the shared folder and read it back: a later loss of executors costs no recomputation."""
    return Tables(df.sparkSession).cut(df, what, compression)


class Tables:
    """Tables of one operator in the shared folder, which are deleted by name as soon as no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
        """Write df and read it back, in place of an earlier table of that name, which df may read."""
        path = scratch(self.spark, what)
        df.write.parquet(path, compression=compression)
        self.drop(what)
        self.paths[what] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, what: str, *conditions: Column) -> tuple:
        """``cut``, and how many rows meet each condition, which are counted as they are written."""
        seen = Observation()
        made = self.cut(df.observe(seen, *[F.count_if(c).alias(f"n{k}") for k, c in enumerate(conditions)]), what)
        return made, *[seen.get.get(f"n{k}", 0) for k in range(len(conditions))]

    def drop(self, *names: str) -> None:
        for what in names:
            if what in self.paths:
                remove(self.spark, self.paths.pop(what))


#: Bytes of shuffled rows that Spark puts together for one task of ``small_tasks``.
TASK_BYTES = "8MB"


#: Rows of a batch that Spark hands to a Python worker in ``small_batches``.
BATCH_ROWS = 2048


@contextlib.contextmanager
def _with(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


@contextlib.contextmanager
def small_tasks(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """What runs inside gets tasks of a bounded share of the rows; Spark's own bound of 64 MB lets them grow with the input.

    parts: shuffles are dealt to so many parts at least before small ones are put together, as rows in a part would else
    grow with the input.
    """
    with contextlib.ExitStack() as stack:
        stack.enter_context(_with(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES))
        if parts and parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            stack.enter_context(_with(spark, "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts)))
        yield


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What runs inside hands few rows at once to Python workers, which the JVM and the worker both hold."""
    return _with(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def numbered(df: DataFrame, order: list[str], name: str, tables: Tables | None = None) -> DataFrame:
    """df with each row's place, from 0 on, in the order of these columns, nulls first.

    Rows are dealt and sorted by ranges of the order; only one count for each partition is brought together.
    The result reads a table named "ranged" of tables, which the caller may drop once it has written the result.
    """
    tables = tables or Tables(df.sparkSession)
    at, part, before, size = (f"wireloom_{x}" for x in ("at", "part", "before", "size"))
    ranged = tables.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranged")
    bits = 33  # of a monotonically increasing id, which tell a row's place in its partition
    ranged = ranged.withColumn(part, F.shiftright(at, bits))
    counts = ranged.groupBy(part).agg(F.count("*").alias(size))
    counts = counts.select(F.col(part).alias("wireloom_of"), F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    joined = ranged.join(F.broadcast(counts), F.col(part) == F.col("wireloom_of"))
    place = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << bits) - 1))
    return joined.select(*df.columns, place.alias(name))


def walk(df: DataFrame, key: list[str], order: list, start: Callable[[], Callable], schema: str, out: pa.Schema) -> DataFrame:
    """Rows of a sequential walk over each key's rows in order.

    start() makes the walk of one key, which maps a row (a tuple) to a list of rows, and None, at the key's end, to the
    last ones.  A key is dealt to one task and sorted there by Spark, which may spill; rows pass in batches and only
    what the walk keeps is held.
    """
    n, names = len(key), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            made = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if step is None or row[:n] != at:
                    if step is not None:
                        made += step(None)
                    at, step = row[:n], start()
                made += step(row)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), out, strict=True)], schema=out)
        if step is not None and (made := step(None)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    assert names[:n] == key
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
