"""CSV files that may be broken: a data source that reports what went wrong.

Every file gives its rows, as far as it can be read, and then one row that tells how it ended: rows, rows with more cells
than the header, and the exception that stopped it. So a file that can't be decompressed or decoded in its middle loses
what is behind that place and nothing else, and no job fails. Files are streamed, line by line, in the tasks."""

from __future__ import annotations

import csv
import gzip
import io
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.expr import q

#: Rows of a batch, and files of a partition.
AT_ONCE, FILES = 2048, 4
TOLD = [("_file", T.StringType()), ("_line", T.LongType()), ("_status", T.StringType()), ("_n_rows", T.LongType()), ("_n_bad", T.LongType()), ("_n_columns", T.IntegerType()), ("_error", T.StringType())]


def opened(path: str):
    """A stream of the bytes of a file in any store that pyarrow knows, decompressed where its name says so."""
    url = urlparse(path)
    store, name = (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    raw = store.open_input_stream(name, compression=None)
    return gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CsvScanReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], files: int):
        self.paths, self.columns, self.files = paths, columns, files

    def partitions(self) -> list[InputPartition]:
        return [Files(self.paths[k : k + self.files]) for k in range(0, len(self.paths), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from self.file(path)

    def batch(self, path: str, rows: list[list[str | None]], first: int, end: dict | None = None) -> pa.RecordBatch:
        n, told = len(rows), end or {}
        arrays = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(self.columns))]
        arrays += [pa.array([path] * n), pa.array([None] * n if end else range(first, first + n), pa.int64()), pa.array([told.get("status")] * n, pa.string())]
        arrays += [pa.array([told.get(k)] * n, t) for k, t in (("n_rows", pa.int64()), ("n_bad", pa.int64()), ("n_columns", pa.int32()), ("error", pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*self.columns, *(c for c, _ in TOLD)])

    def file(self, path: str) -> Iterator[pa.RecordBatch]:
        rows: list[list[str | None]] = []
        n = bad = sent = 0
        header: list[str] = []
        error, known = None, True
        try:
            # lines are decoded one by one, so that all before a bad one count
            lines = csv.reader(line.decode("utf-8-sig" if not k else "utf-8") for k, line in enumerate(opened(path)))
            header = next((r for r in lines if r), [])
            by_name = {c.strip().lower(): k for k, c in reversed(list(enumerate(header)))}
            at = [by_name.get(c.lower()) for c in self.columns]
            if known := any(k is not None for k in at):
                for cells in lines:
                    if len(cells) > len(header):
                        bad += 1
                    elif cells:
                        rows.append([cells[k] if k is not None and k < len(cells) else None for k in at])
                        n += 1
                        if len(rows) == AT_ONCE:
                            yield self.batch(path, rows, sent)
                            sent, rows = n, []
        except Exception as e:  # what a file holds must not stop the others; it is reported
            error = f"{type(e).__name__}: {e}"
        if rows:
            yield self.batch(path, rows, sent)
        if error is None and header and not known:
            error = "none of the columns"
        status = ("error" if not n else "partial") if error else "empty" if not header else "partial" if bad else "ok"
        yield self.batch(path, [[None] * len(self.columns)], 0, {"status": status, "n_rows": n, "n_bad": bad, "n_columns": len(header), "error": error})


class CsvScan(DataSource):
    """spark.read.format("csv_scan"): options paths and columns (JSON lists), files (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "csv_scan"

    def schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(c, T.StringType()) for c in json.loads(self.options["columns"])), *(T.StructField(c, t) for c, t in TOLD)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CsvScanReader(json.loads(self.options["paths"]), json.loads(self.options["columns"]), int(self.options.get("files", FILES)))


def scan_csv(spark: SparkSession, root: str, columns: list[str], pattern: str = "*.csv*", files: int = FILES) -> DataFrame:
    """The columns of all files below root as text, `_file` and `_line`, and a last row for each file (see `report`). The
    files are those of Spark's own listing, which leaves out files of no bytes; columns are found by name in any case, and
    are null where a file hasn't got them."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path").orderBy("path")
    spark.dataSource.register(CsvScan)
    return spark.read.format("csv_scan").option("paths", json.dumps([r["path"] for r in listed.collect()])).option("columns", json.dumps(columns)).option("files", files).load()


def rows_of(scan: DataFrame) -> DataFrame:
    """The rows alone, with `_file` and `_line`."""
    return scan.where("_status IS NULL").drop("_status", "_n_rows", "_n_bad", "_n_columns", "_error")


def report(scan: DataFrame, label: str | None = None) -> DataFrame:
    """file, n_columns, n_rows, n_bad, status (ok, partial, error, empty), error, and with `label` its values by number of
    rows as JSON (few: attack labels): one pass over the files."""
    told = F.max(F.struct("_status", "_n_rows", "_n_bad", "_n_columns", "_error"))
    by_label = scan.groupBy("_file", (q(label) if label else F.lit(None).cast("string")).alias("l")).agg(F.count(F.when(F.col("_status").isNull(), 1)).alias("n"), F.max("_status").alias("s"), told.alias("t"))
    labels = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct(F.coalesce("l", F.lit("")).alias("l"), "n"))))))
    out = by_label.groupBy("_file").agg(F.max("t").alias("t"), (labels if label else F.lit(None).cast("string")).alias("labels"))
    return out.select(F.col("_file").alias("file"), F.col("t._n_columns").alias("n_columns"), F.col("t._n_rows").alias("n_rows"), F.col("t._n_bad").alias("n_bad"), "labels", F.col("t._status").alias("status"), F.col("t._error").alias("error"))
