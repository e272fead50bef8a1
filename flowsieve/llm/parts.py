"""Tables of parts: each row holds a few MB of documents as compact arrays.

An operator that needs to know something about every word or byte of the corpus sends one message per part and shard,
not one row per word: part rows are written to the shared folder once, shards gather the messages for their range of
hashes, answer every part, and the answers meet the parts again. A hash occurs at most once in a part's messages, so
that no word, line or passage makes a hot key, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, col, stored, stored_in_buckets

PART_BYTES = 4 << 20


def squeeze(x: np.ndarray | bytes) -> bytes:
    """Compressed; an array byte plane by byte plane, so that the low bytes of hashes don't hide the even high ones."""
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).reshape(-1, 1).view(np.uint8).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(x: bytes, dtype=None):
    """Bytes, or with dtype the array, which must be of the type that was squeezed."""
    raw = zstandard.ZstdDecompressor().decompress(x)
    if dtype is None:
        return raw
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def make_parts(docs: DataFrame, fn: Callable, schema: T.StructType, name: str, part_bytes: int = PART_BYTES, bucketed: bool = False) -> DataFrame:
    """docs: doc_id, text. fn(ids, texts as bytes) gives the fields of a part's row; a leading `part` is its number.
    Nothing is shuffled: parts are runs of rows of the scan, fixed by being written. With `bucketed` they are written by
    buckets of `part`, so that answers meet them as often as needed without another exchange of the parts."""
    spark = docs.sparkSession
    bound_batches(spark)
    full = T.StructType([T.StructField("part", T.LongType()), *schema.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []

        def part():
            nonlocal count
            row = (task << 24 | count, *fn(list(ids), list(texts)))
            count += 1
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(raw)
                held += len(raw) + 16
                if held >= part_bytes:
                    yield part()
                    held = 0
        if ids:
            yield part()

    source = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").cast("string").alias("text"))
    made = source.mapInArrow(run, full)
    if not bucketed:
        return stored(made, name)
    return stored_in_buckets(made, "part", part_buckets(docs), name)


def part_buckets(docs: DataFrame) -> int:
    """Buckets that parts made of docs are written by."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select(col("doc_id"), col("text")).rdd.getNumPartitions())


def shard_count(parts: DataFrame) -> int:
    """As many shards as parts, so that a shard's share stays that of a part as the corpus grows."""
    return max(4, min(parts.count(), 1 << 15))


def by_shard(hashes: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of sorted hashes that fall into each shard."""
    edges = np.searchsorted(hashes, (np.arange(1, shards, dtype=np.uint64) * np.uint64((1 << 64) // shards)))
    edges = np.concatenate([[0], edges, [len(hashes)]])
    return [(s, int(edges[s]), int(edges[s + 1])) for s in range(shards) if edges[s + 1] > edges[s]]


def map_rows(parts: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """fn(row as dict) yields tuples; a part at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(fn({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    arrow = to_arrow_schema(schema)
    return parts.mapInArrow(run, schema)


def in_shards(messages: DataFrame, key: str, fn: Callable, schema: T.StructType) -> DataFrame:
    """fn(frame of one key's messages) yields tuples. A key's messages are one from each part at most."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(fn(frame)), columns=schema.fieldNames())

    return messages.groupBy(key).applyInPandas(run, schema)


def with_answers(parts: DataFrame, answers: DataFrame, fn: Callable, schema: T.StructType) -> DataFrame:
    """fn(part row as dict, frame of the answers to it) yields tuples."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [x for r in left.to_dict("records") for x in fn(r, right)]
        return pd.DataFrame(rows, columns=schema.fieldNames())

    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(run, schema)

