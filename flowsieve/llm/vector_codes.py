"""Vector codes: product quantisation trained by member-resident Lloyd rounds.

A vector's components become integers and its four consecutive parts are coded by the nearest entry of a codebook each.
In training, the parts live with the owner of their entry: rows are partitioned by (position, entry, salt), where the salt
is the hash of the row, so that an entry that holds any share of all rows is spread over many owners. In each round owners
sum their resident members, the sums of at most 4 x 256 entries come together as the new codebooks, and members look up
their entry again: those that keep it stay where they are (a narrow union), and only those that change it go through the
next shuffle. Members carry no ids; the codes of the rows come from one last pass over the table itself.

All numbers are exact: integers in doubles where they fit 53 bits, else 64-bit integers. Lost executors' members are made
again from the four rounds' shuffles and the table; salts depend on the row alone.

Defined results: vectors that are null, hold null or non-finite components, or whose length isn't that of the kept vector
with the least id (a multiple of the number of parts) are left out; components beyond +-131,072 count as that; rows
without an id come after all others; rows that repeat an id take part each on its own, in the order of their vectors where
seeds are picked; fewer than 256 rows give as many entries; a table without kept vectors gives an empty result; columns
that clash with the new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, col, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 131_072 * SCALE
#: Parts that a task looks up at once.
AT_ONCE = 4096
LABEL_SALTS = 32


def prepared(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The kept rows with their integers as `_v`, of the length of the first of them."""
    sound = F.col("_raw").isNotNull() & F.forall("_raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("_raw", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e12)), F.lit(1e12)) * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = vectors.withColumn("_raw", col(vector).cast("array<double>")).where(sound & (F.size("_raw") > 0) & (F.size("_raw") % parts == 0)).withColumn("_v", whole).drop("_raw")
    return kept


def seeds(kept: DataFrame, vec_id: str = "vec_id", entries: int = ENTRIES, parts: int = PARTS) -> tuple[int, np.ndarray | None]:
    """(length of the vectors, the first codebooks: parts x entries x width) from the rows with the least ids."""
    first = [col(vec_id).asc_nulls_last(), F.col("_v")]
    one = kept.orderBy(*first).select(F.size("_v")).head()
    if one is None:
        return 0, None
    rows = kept.where(F.size("_v") == one[0]).orderBy(*first).limit(entries).select("_v").collect()
    return one[0], np.array([r[0] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; the least entry of equal ones."""
    entry, distance = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if largest**2 * book.shape[1] * 4 < 1 << 53 else np.int64
    b = book.astype(kind)
    for k in range(0, len(parts), AT_ONCE):
        p = parts[k : k + AT_ONCE].astype(kind)
        far = (b * b).sum(axis=1) - 2 * (p @ b.T)
        e = far.argmin(axis=1)
        entry[k : k + AT_ONCE] = e
        distance[k : k + AT_ONCE] = far[np.arange(len(e)), e] + (p * p).sum(axis=1)
    return entry, distance


def looked_up(position: np.ndarray, parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The entry of each part in the codebook of its position."""
    entry = np.empty(len(parts), dtype=np.int64)
    for p in range(len(books)):
        at = np.flatnonzero(position == p)
        entry[at] = nearest(parts[at], books[p])[0]
    return entry


def owner(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of (position, entry, salt)."""
    x = ((position * np.int64(1 << 12) + entry) * np.int64(1 << 20) + salt).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(partitions)).astype(np.int64)


def _same(key: int) -> int:
    return key


def _narrow(parts: np.ndarray) -> np.ndarray:
    return parts.astype(np.int16 if np.abs(parts).max(initial=0) < 1 << 15 else np.int32)


#: A block of members: position, entry, salt and integers of each.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _dealt(block: Block, partitions: int):
    """The block cut up by owner: (partition, block)."""
    position, entry, salt, parts = block
    to = owner(position, entry, salt, partitions)
    order = np.argsort(to, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        if len(at):
            yield int(to[at[0]]), (position[at], entry[at], salt[at], _narrow(parts[at]))


def _merged(blocks, size: int = 4 * AT_ONCE):
    """Blocks put together until they have `size` members."""
    held, n = [], 0
    for b in blocks:
        held.append(b)
        n += len(b[0])
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def placed(kept: DataFrame, books: np.ndarray, vec_id: str, salts: int, partitions: int) -> RDD:
    """The members at their first owners: every part is looked up where it was read and sent once."""
    spark = kept.sparkSession
    n_parts, _, width = books.shape
    held = spark.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            salt = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), n_parts).astype(np.int32)
            position = np.tile(np.arange(n_parts), batch.num_rows)
            entry = looked_up(position, parts, held.value)
            out = list(_dealt((position.astype(np.int8), entry.astype(np.int16), salt, parts), partitions))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int32()), *[pa.array([x[i].tobytes() for _, x in out], pa.binary()) for i in range(4)], pa.array([x[3].itemsize for _, x in out], pa.int32())],
                names=["owner", "position", "entry", "salt", "parts", "bytes"],
            )

    salt = F.pmod(F.xxhash64(col(vec_id), F.col("_v")), F.lit(salts)).cast("int")
    sent = kept.select("_v", salt.alias("salt")).mapInArrow(run, "owner int, position binary, entry binary, salt binary, parts binary, bytes int")
    kinds = (np.int8, np.int16, np.int32)

    def opened(r):
        parts = np.frombuffer(bytes(r["parts"]), dtype=np.int16 if r["bytes"] == 2 else np.int32).reshape(-1, width)
        return r["owner"], (*[np.frombuffer(bytes(r[n]), dtype=k) for n, k in zip(("position", "entry", "salt"), kinds, strict=True)], parts)

    return sent.rdd.map(opened).partitionBy(partitions, _same)


def sums(members: RDD, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) by position and entry: owners sum their residents, and the at most 4 x 256 sums come to the driver."""
    n_parts, entries, width = shape

    def of_owner(rows):
        count, total = np.zeros(n_parts * entries, np.int64), np.zeros((n_parts * entries, width), np.int64)
        for position, entry, _, parts in _merged(b for _, b in rows):
            key = position.astype(np.int64) * entries + entry
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            total[key[order][begin]] += np.add.reduceat(parts[order].astype(np.int64), begin, axis=0)
            count += np.bincount(key, minlength=len(count))
        return [(int(k), (int(count[k]), total[k])) for k in np.flatnonzero(count)]

    found = members.mapPartitions(of_owner).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(16, members.getNumPartitions())).collect()
    count, total = np.zeros(n_parts * entries, np.int64), np.zeros((n_parts * entries, width), np.int64)
    for k, (c, t) in found:
        count[k], total[k] = c, t
    return count.reshape(n_parts, entries), total.reshape(shape)


def renewed(books: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries with members become the floor of their mean; the others stay."""
    return np.where(count[:, :, None] > 0, np.floor_divide(total, np.maximum(count, 1)[:, :, None]), books)


def reassigned(members: RDD, books: np.ndarray, partitions: int) -> tuple[RDD, RDD]:
    """(the members at the owners of their new entries, what is cached for them): residents that keep their entry stay in
    their partition, the others migrate."""
    held = members.context.broadcast(books)

    def look(rows):
        for position, entry, salt, parts in _merged(b for _, b in rows):
            new = looked_up(position, parts, held.value).astype(np.int16)
            stay = new == entry
            yield True, (position[stay], entry[stay], salt[stay], parts[stay])
            if not stay.all():
                yield False, (position[~stay], new[~stay], salt[~stay], parts[~stay])

    told = members.mapPartitions(look, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    stay = told.mapPartitions(lambda rows: ((0, b) for kept, b in rows if kept), preservesPartitioning=True)
    moved = told.mapPartitions(lambda rows: (x for b in _merged(b for kept, b in rows if not kept) for x in _dealt(b, partitions))).partitionBy(partitions, _same)
    return stay.union(moved), told


def train(kept: DataFrame, first: np.ndarray, vec_id: str = "vec_id", rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after `rounds` rounds: parts x entries x width."""
    spark = kept.sparkSession
    bound_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(4, partitions // 4)
    books, cached = first, None
    members = placed(kept, books, vec_id, salts, partitions) if rounds else None
    for k in range(rounds):
        books = renewed(books, *sums(members, books.shape))
        if k + 1 < rounds:
            before, (members, cached) = cached, reassigned(members, books, partitions)
            if before is not None:
                before.unpersist()
    if cached is not None:
        cached.unpersist()
    return books


def encode(kept: DataFrame, books: np.ndarray, columns: list[str]) -> DataFrame:
    """`columns` of the kept rows plus code (two hex digits a part) and error (squared distances of all parts)."""
    bound_batches(kept.sparkSession)
    n_parts, _, width = books.shape
    held = kept.sparkSession.sparkContext.broadcast(books)
    names = [c for c in columns if c.lower() not in ("code", "error")]
    source = kept.select(*[col(c).alias(f"k{i}") for i, c in enumerate(names)], "_v")
    out = source.drop("_v").withColumns({"_code": F.lit(""), "_error": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_parts, width)
            codes, errors = np.empty((batch.num_rows, n_parts), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p in range(n_parts):
                entry, distance = nearest(parts[:, p], held.value[p])
                codes[:, p] = entry
                errors += distance
            text = [codes[i].tobytes().hex() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(text), pa.array(errors)], names=out.names)

    return source.mapInArrow(run, out).toDF(*names, "code", "error")


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def digest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels) and codebooks_sha256 of every kept row."""
    kept = prepared(vectors.select(col(vec_id).alias("vec_id"), col(vector).alias("vector"), col(label).alias("label")), "vector")
    width, first = seeds(kept)
    if first is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    kept = kept.where(F.size("_v") == width)
    books = train(kept, first)
    coded = stored(encode(kept, books, ["vec_id", "label"]), "vector-codes")
    # a label may hold any share of the rows: they are dealt to salts, and each label's sum goes to all of them
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("_salt"))
    salted = coded.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(LABEL_SALTS)).cast("int"))
    # Spark takes a table that an explode has multiplied for as small as it was, hence the hint
    both = salted.hint("merge").join(totals, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(codebooks_text(books).encode()).hexdigest()).alias("codebooks_sha256"))
