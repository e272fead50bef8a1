"""Shared helpers of the text operators: row-wise Arrow columns, shared storage, numbering without hot partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python task holds as objects at once.
ROWS_AT_ONCE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows, so that a run of very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        path = held or tempfile.mkdtemp(prefix="flowsieve-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A write's shuffle files go when it ends, not when the driver next collects garbage: what was written is read back
    from its table, so that nothing asks for them again. Until then lost ones are made anew as ever."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Folders and tables that this driver has stored, for remove_stored.
_FOLDERS: list[str] = []
_TABLES: list[str] = []


def remove_stored(spark: SparkSession) -> int:
    """Removes what `stored` and `stored_in_buckets` have written for this driver, once no result that reads it is wanted
    any more; the number of folders and tables."""
    n = len(_FOLDERS) + len(_TABLES)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as a table of the shared warehouse in buckets of `key`: joins and groups by key read it without an exchange."""
    return added_in_buckets(df, key, buckets, table_name(name))


def table_name(name: str) -> str:
    _TABLES.append(f"{name}_{uuid.uuid4().hex}")
    return _TABLES[-1]


def added_in_buckets(df: DataFrame, key: str, buckets: int, table: str) -> DataFrame:
    """The table of that name with the rows of df added to its buckets; it is made if it isn't there."""
    with shuffles_removed(df.sparkSession):
        df.write.format("parquet").option("compression", "zstd").mode("append").bucketBy(buckets, key).saveAsTable(table)
    return df.sparkSession.table(table)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], fn: Callable) -> DataFrame:
    """df plus `fields`, made row by row: fn(*lists of the inputs' values) gives one list per field.

    A column of df that has the name of a field is replaced. Rows stay as they are, repeated ones too."""
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    source = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in new]
    at = [next(i for i, c in enumerate(df.columns) if c.lower() == x.lower()) for x in inputs]
    out = T.StructType([T.StructField(f"k{i}", df.schema.fields[i].dataType) for i in kept] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                made = fn(*[part.column(i).to_pylist() for i in at])
                arrays = [part.column(i) for i in kept] + [pa.array(x, type=arrow.field(f"n{i}").type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    done = source.mapInArrow(run, out)
    names = [df.columns[i] for i in kept] + [f.name for f in fields]
    return done.toDF(*names)


def filtered(docs: DataFrame, names: dict[str, str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of docs with their own columns: keep gets them with the columns of `names` (name for keep: own name, in any
    case) and all others under names that can't clash with what it adds, and returns those that stay."""
    own = {v.lower(): k for k, v in names.items()}
    at = [own.pop(c.lower(), f"k{i}") for i, c in enumerate(docs.columns)]
    return keep(docs.toDF(*at)).select(*at).toDF(*docs.columns)


def ranked(df: DataFrame, key: Column, order: list[Column], name: str = "rank", spread: int = 64) -> DataFrame:
    """df plus a 0-based rank of each row within `key`, without one task per key.

    Rows of a key are dealt to `spread` slots by the hash of their order columns; ranks within a slot are offset by the
    sizes of the slots before it. The order within a key is (slot, order columns): fixed, but not that of the columns."""
    slotted = df.withColumn("_key", key).withColumn("_slot", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    sizes = slotted.groupBy("_key", "_slot").count()
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_key").alias("_k"), F.col("_slot").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = slotted.withColumn("_in", F.row_number().over(Window.partitionBy("_key", "_slot").orderBy(*order)) - 1)
    return within.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_slot") == F.col("_s"))).withColumn(name, F.col("_start") + F.col("_in")).drop("_key", "_slot", "_k", "_s", "_start", "_in")
