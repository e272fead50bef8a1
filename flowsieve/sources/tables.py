"""Sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import q
from .csv_scan import report, scan_csv


def read_table(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Parquet, or CSV with a header (all columns as text) where the path ends in .csv."""
    df = spark.read.option("header", True).csv(path) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
    if label and label not in df.columns:
        raise ValueError(f"{path} has no column {label}; there are {df.columns}")
    return df


def list_files(spark: SparkSession, root: str, suffix: str = ".csv", max_files: int | None = None) -> list[str]:
    """Paths below root in sorted order, through Spark's own file listing, so any store works."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    ordered = found.orderBy("path")
    return [r["path"] for r in (ordered.limit(max_files) if max_files else ordered).collect()]


def read_csv_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The first max_files CSV parts below root, as text, with `_file` (S2). Parts are put together by column name: files
    with the same header are one read, and columns that a file hasn't got are null."""
    paths = list_files(spark, root, ".csv", max_files)
    if not paths:
        raise ValueError(f"no CSV file below {root}")
    by_header: dict[str, list[str]] = {}
    for r in headers(spark, paths).collect():  # a row a file
        by_header.setdefault(r["header"], []).append(r["file"])
    frames = [spark.read.option("header", True).csv(sorted(some)).withColumn("_file", F.col("_metadata.file_path")) for _, some in sorted(by_header.items(), key=lambda x: min(x[1]))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, header): the first line of every file; empty files have none."""
    lines = spark.read.format("text").load(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    return lines.where("at = 0").groupBy("file").agg(F.min_by("value", "i").alias("header"))


def scan_status(spark: SparkSession, root: str, columns: list[str], label: str | None = None) -> DataFrame:
    """file, n_columns, n_rows, n_bad, labels, status and error of every CSV part below root (S3, A25), read to its end or to
    where it breaks."""
    return report(scan_csv(spark, root, columns), label)


def bounded_read(df: DataFrame, order: str, first: int) -> DataFrame:
    """The first rows by a column (S4): a distributed top-n."""
    return df.orderBy(q(order)).limit(first)


def blank_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as doubles, blanks as null."""
    return df.withColumns({c: F.nullif(F.trim(q(c)), F.lit("")).try_cast("double") for c in columns})


def write_metrics(df: DataFrame, path: str, by: tuple[str, ...] = ("dataset", "scenario", "seed"), fmt: str = "parquet") -> None:
    """Run metrics by partition (S6); CSV with a header for clean tables and samples."""
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    writer.option("header", True).format(fmt).save(path)


def manifest_rows(counts: DataFrame, name: str) -> DataFrame:
    """One row with a JSON payload: rows in all and per family (S7); counts: family, n, a row per family."""
    by_family = F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n"))))
    return counts.agg(F.to_json(F.struct(F.lit(name).alias("dataset"), F.sum("n").alias("rows"), by_family.alias("families"))).alias("manifest"))
