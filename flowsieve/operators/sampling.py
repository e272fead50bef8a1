"""Repeatable caps, samples, splits and client partitions.

Every random order is that of `hash_order`, so results don't depend on partitioning and can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_order, q

#: Hex digits of the hash that make up a bucket of the histogram: 4096 buckets a group.
DIGITS = 3


#: Rows of a bucket that are ranked in a task; larger ones are cut by further digits first.
RANKED = 100_000
#: Groups whose thresholds come to the driver and are broadcast again.
MOST_GROUPS = 100_000


def quota_thresholds(rows: DataFrame, quota: Column, ranked: int = RANKED) -> list[tuple]:
    """(group, hash, key) of the last row in hash order that is within each group's quota; groups with a quota of 0 are
    left out. rows: _g, _h, _k. No group is sorted as a whole: a histogram of hash prefixes (4096 buckets a group at
    most) tells the bucket in which the quota is reached; buckets of many rows are cut by `DIGITS` further digits, and
    only rows of the last buckets are ranked. One row a group comes to the driver, as groups are families."""
    spark, digits, edges = rows.sparkSession, DIGITS, None
    kind = rows.select(F.col("_g").alias("_eg"), F.col("_h").alias("_edge"), F.lit(0).cast("long").alias("_need")).schema
    inside = rows
    while True:
        cut = inside.withColumn("_b", F.substring("_h", 1, digits))
        by = Window.partitionBy("_g")
        sized = cut.groupBy("_g", "_b").count().withColumn("_upto", F.sum("count").over(by.orderBy("_b"))).withColumn("n", F.sum("count").over(by))
        if edges is None:
            sized = sized.withColumn("_quota", F.least(F.greatest(quota.cast("long"), F.lit(0)), F.col("n")))
        else:
            sized = sized.join(edges.select("_eg", F.col("_need").alias("_quota")), F.col("_g").eqNullSafe(F.col("_eg")))
        edge = sized.where("_upto >= _quota AND _quota > 0").groupBy("_g").agg(F.min(F.struct("_b", (F.col("_quota") - F.col("_upto") + F.col("count")).alias("need"), "count")).alias("_e"))
        found = edge.select("_g", "_e._b", "_e.need", "_e.count").limit(MOST_GROUPS + 1).collect()  # a row a group
        if len(found) > MOST_GROUPS:
            raise ValueError(f"more than {MOST_GROUPS} groups; pick_quota_by_window takes any number of small ones")
        edges = F.broadcast(spark.createDataFrame([(g, b, need) for g, b, need, _ in found], kind))
        inside = rows.join(edges, F.col("_g").eqNullSafe(F.col("_eg")) & (F.substring("_h", 1, digits) == F.col("_edge")))
        if digits >= 30 or max((r["count"] for r in found), default=0) <= ranked:
            break
        digits, inside = digits + DIGITS, inside.drop("_eg", "_edge", "_need")
    last = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k")))
    return [tuple(r) for r in last.where("_r = _need").select("_g", "_h", "_k").collect()]


def pick_quota(df: DataFrame, group: str, key: str, quota: Column, seed: int, salt: str, name: str = "picked") -> DataFrame:
    """df plus a boolean: whether the row is among the first `quota` of its group in hash order (H1); quota is an
    expression over `n`, the group's size. Thresholds are found first; the flag is then a projection."""
    h = hash_order(seed, salt, q(key))
    rows = df.select(q(group).alias("_g"), h.alias("_h"), q(key).alias("_k"))
    found = df.sparkSession.createDataFrame(quota_thresholds(rows, quota), rows.select(F.col("_g").alias("_tg"), F.col("_h").alias("_th"), F.col("_k").alias("_tk")).schema)
    joined = df.join(F.broadcast(found), q(group).eqNullSafe(F.col("_tg")), "left")
    return joined.withColumn(name, F.coalesce((h < F.col("_th")) | ((h == F.col("_th")) & (q(key) <= F.col("_tk"))), F.lit(False))).drop("_tg", "_th", "_tk")


def pick_quota_by_window(df: DataFrame, group: str, key: str, quota: Column, seed: int, salt: str, name: str = "picked") -> DataFrame:
    """The same by a plain window; for small groups and as the reference in tests."""
    w = Window.partitionBy(q(group))
    ranked = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(hash_order(seed, salt, q(key)), q(key))))
    return ranked.withColumn(name, F.col("_r") <= quota).drop("_r", "n")


def family_cap(df: DataFrame, family: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows of each family in hash order."""
    return pick_quota(df, family, key, F.lit(cap), seed, "cap").where("picked").drop("picked")


def prefix_bound(df: DataFrame, order: str, n: int, ranked: int = RANKED) -> tuple | None:
    """(the n-th least value of a column,) or None if it has fewer: ranges of a sample tell where it is, the range that
    holds it is cut again until it has `ranked` rows or values that a sample can't part, and those alone are ordered."""
    rows, need, before = df.select(q(order).alias("_o")).where("_o IS NOT NULL"), n, None
    while True:
        edges = [e for r in sampled_edges(rows, F.col("_o")).collect() for e in r["_edges"]]
        place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("_o"))) if edges else F.lit(0)
        counts = {r["p"]: r["count"] for r in rows.groupBy(place.alias("p")).count().collect()}  # a row a range
        at = 0
        while at <= len(edges) and need > counts.get(at, 0):
            need -= counts.get(at, 0)
            at += 1
        if at > len(edges):
            return None
        if at:
            rows = rows.where(F.col("_o") >= F.lit(edges[at - 1]))
        if at < len(edges):
            rows = rows.where(F.col("_o") < F.lit(edges[at]))
        if counts[at] <= ranked or counts[at] == before:
            break
        before = counts[at]
    by_value = rows.groupBy("_o").count().withColumn("_upto", F.sum("count").over(Window.orderBy("_o")))  # a range's values
    return tuple(by_value.where(F.col("_upto") >= need).agg(F.min("_o")).head())


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by a column of any type that has an order and doesn't repeat (W2): a bound and a filter, so nothing
    is shuffled however large n is. Rows without a value aren't among them."""
    bound = prefix_bound(df, order, n) if n > 0 else None
    if bound is None:
        return df.where(q(order).isNotNull() & F.lit(n > 0))
    return df.where(q(order) <= F.lit(bound[0]))


def first_come_cap(df: DataFrame, family: str, order: str, cap: int, max_rows: int) -> DataFrame:
    """Of the first `max_rows` rows in `order`, the first `cap` of each family (W2). Families are numbered by ranges of the
    order: a family may have any share of the rows, and max_rows may be any share of the table."""
    first = first_rows(df, order, max_rows)
    cut, at = with_range(first, q(order), q(family))
    numbered = distributed_row_number(cut, [q(order)], [q(family), *at], "_come", within=1)
    return numbered.where(F.col("_come") <= cap).select(*[q(c) for c in df.columns])


def in_file_order(df: DataFrame, run: int = 1_000_000) -> tuple[DataFrame, list[Column], list[Column]]:
    """(df plus _file and _row, order, bucket) of a table read from Parquet files: the order of files by path and of rows in
    them, for distributed_row_number; runs are `run` rows of a file."""
    told = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return told, [F.col("_file"), F.col("_row")], [F.col("_file"), F.floor(F.col("_row") / run)]


def test_quota(ratio: float, min_group: int = 2) -> Column:
    """Half-even rounding of the test share, at least one; groups of at most `min_group` rows stay in train."""
    return F.when(F.col("n") <= min_group, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(ratio), 0).cast("long")))


def stratified_split(df: DataFrame, family: str, key: str, ratio: float = 0.25, seed: int = 42, min_group: int = 2, salt: str = "split") -> DataFrame:
    """df plus `split` (train or test), by family (W3). min_group 0: every family gives a test row."""
    return pick_quota(df, family, key, test_quota(ratio, min_group), seed, salt).withColumn("split", F.when(F.col("picked"), "test").otherwise("train")).drop("picked")


def three_way_split(df: DataFrame, family: str, key: str, test_ratio: float, valid_ratio: float, seed: int = 42) -> DataFrame:
    """df plus `split`: test, then valid out of what is left, the rest train."""
    split = stratified_split(df, family, key, test_ratio, seed)
    rest = stratified_split(split.where("split = 'train'").drop("split"), family, key, valid_ratio, seed, salt="valid")
    return split.where("split = 'test'").unionByName(rest.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise("train")))


def stratified_cap(df: DataFrame, family: str, key: str, max_rows: int, seed: int = 42) -> DataFrame:
    """About max_rows rows in the families' proportion, at least one of each, then trimmed to max_rows."""
    total = df.count()
    if total <= max_rows:
        return df
    quota = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(max_rows) / F.lit(float(total)), 0).cast("long"))
    return random_rows(pick_quota(df, family, key, quota, seed, "strata").where("picked").drop("picked"), key, max_rows, seed, "trim")


def proportional_sample(df: DataFrame, family: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """From each family size * share rows, at least one, at most all."""
    total = df.count()
    quota = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(size) * (F.col("n") / F.lit(float(total))), 0).cast("long")))
    return pick_quota(df, family, key, quota, seed, "sample").where("picked").drop("picked")


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42, salt: str = "rows") -> DataFrame:
    """n rows in hash order (T1): a threshold and a filter, as a quota of one group, whatever n is."""
    one = df.withColumn("_all", F.lit(0))
    return pick_quota(one, "_all", key, F.lit(n), seed, salt, "_picked").where("_picked").drop("_all", "_picked")


def hash_bucket(h: Column) -> Column:
    """The first hex digits of a hash: 4096 buckets in hash order."""
    return F.substring(h, 1, DIGITS)


#: Ranges of a column at least and at most (a range has about RANKED rows in between), and sampled values to a range.
RANGES, MOST_RANGES, SAMPLED = 64, 4096, 16


def sampled_edges(df: DataFrame, column: Column, by: Column | None = None) -> DataFrame:
    """(_by, _edges): inner edges of about equal ranges of any column that has an order, texts too; with `by` (few values,
    as labels or splits) for each of them. They are those of a sample of about SAMPLED rows a range, chosen by hash. The
    edges only balance the ranges, so a sample does."""
    group = by.cast("string") if by is not None else F.lit("")
    rows = df.select(group.alias("_by"), column.alias("_x")).where(F.col("_x").isNotNull())
    sizes = rows.groupBy("_by").count().limit(MOST_GROUPS + 1).collect()  # a row a group
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    share, ranges = F.lit(1.0), min(MOST_RANGES, max(RANGES, max((r["count"] for r in sizes), default=0) // RANKED))
    for r in sizes:
        share = F.when(F.col("_by").eqNullSafe(F.lit(r["_by"])), F.lit(ranges * SAMPLED / max(1, r["count"]))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("_x"), F.lit(1 << 30)) < share * float(1 << 30)).distinct()
    held: dict = {}
    for r in chosen.orderBy("_by", "_x").collect():  # SAMPLED rows a range and group, about
        held.setdefault(r["_by"], []).append(r["_x"])
    edges = [(r["_by"], [x[k * len(x) // ranges] for k in range(1, ranges)] if len(x := held.get(r["_by"], [])) >= ranges else x) for r in sizes]
    kind = rows.select("_by", F.array("_x").alias("_edges")).schema
    return df.sparkSession.createDataFrame(edges, kind)


def with_range(df: DataFrame, column: Column, by: Column | None = None) -> tuple[DataFrame, list[Column]]:
    """(df plus the number of the range that the column is in, from 0, nulls in 0, that number as a bucket)."""
    edges = sampled_edges(df, column, by)
    group = by.cast("string") if by is not None else F.lit("")
    out = df.join(F.broadcast(edges), group.eqNullSafe(F.col("_by")), "left")  # a row a group, as many as labels or splits
    place = F.coalesce(F.when(column.isNull(), -1).otherwise(F.size(F.filter("_edges", lambda e: e <= column))), F.lit(0))
    return out.withColumn("_range", place).drop("_by", "_edges"), [F.col("_range")]


def distributed_row_number(df: DataFrame, order: list[Column], bucket: list[Column], name: str = "row_number", within: int = 0) -> DataFrame:
    """df plus a 1-based row number in `order` (H5), global or within the first `within` columns of `bucket`.

    bucket: columns by which the rows are cut into runs of the order: rows of a lesser bucket come before all rows of a
    greater one. They are functions of the row alone, so the sizes counted in one job hold for the numbering in the next,
    and no join drops a row. No task sorts more than a bucket."""
    names = [f"_b{i}" for i in range(len(bucket))]
    cut = df.withColumns(dict(zip(names, bucket, strict=True)))
    before = Window.partitionBy(*names[:within]).orderBy(*names[within:]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*names).count()
    starts = sizes.select(*[F.col(c).alias(f"_s{c}") for c in names], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # a row a bucket
    inside = cut.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    on = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in names]
    return inside.join(starts, on, "left").withColumn(name, F.col("_start") + F.col("_r")).drop(*names, *[f"_s{c}" for c in names], "_start", "_r")


def _parts(number: Column, total: int, parts: int) -> Column:
    """Which of `parts` runs, the first ones a row longer, a 1-based number falls into (as ntile does)."""
    size, longer = divmod(total, parts)
    edge = longer * (size + 1)
    head = F.floor((number - 1) / (size + 1))
    return F.when(number <= edge, head).otherwise(longer + F.floor((number - 1 - edge) / F.lit(max(size, 1)))).cast("int")


def iid_clients(df: DataFrame, key: str, clients: int, seed: int = 42) -> DataFrame:
    """df plus client_id: equal runs of the hash order."""
    hashed = df.withColumn("_h", hash_order(seed, "client", q(key)))
    numbered = distributed_row_number(hashed, [F.col("_h"), q(key)], [hash_bucket(F.col("_h"))], "_n")
    return numbered.withColumn("client_id", _parts(F.col("_n"), df.count(), clients)).drop("_h", "_n")


def label_skew_clients(df: DataFrame, label: str, key: str, clients: int, classes: int, seed: int = 42) -> DataFrame:
    """df plus client_id: rows in label order are cut into max(2 * clients, 2 * classes) shards, and the shards, in
    hash order, are dealt out in turn (W8). Rows are numbered by label and key range, so a label may have any share."""
    shards = max(2 * clients, 2 * classes)
    cut, at = with_range(df, q(key), q(label))
    numbered = distributed_row_number(cut, [q(key)], [q(label), *at], "_n").withColumn("_shard", _parts(F.col("_n"), df.count(), shards)).drop("_n", "_range")
    deal = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("_s"), hash_order(seed, "shard", F.col("id")).alias("_h"))
    deal = deal.select("_s", F.pmod(F.row_number().over(Window.orderBy("_h", "_s")) - 1, F.lit(clients)).cast("int").alias("client_id"))
    return numbered.join(F.broadcast(deal), F.col("_shard") == F.col("_s"), "left").drop("_s", "_shard")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in hash order, for writing."""
    return df.orderBy(hash_order(seed, "shuffle", q(key)), q(key))
