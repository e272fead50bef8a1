"""Column profiles, label fractions, fitted statistics and column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, number_of, q
from .quantiles import quantiles

#: Column names that tell the label, and parts of names that identify a host.
LABEL_LIKE = ("label", "attack", "attack_cat", "attack_type", "attack_label", "class", "category", "target", "_family_label")
IDENTIFIERS = ("IPV4_SRC_ADDR", "IPV4_DST_ADDR", "IPV6", "SRC_ADDR", "DST_ADDR")


def find_label(columns: list[str], requested: str | None = None, candidates: tuple[str, ...] = LABEL_LIKE) -> str:
    """The label column (P1): the requested one, else a candidate in any case, else a name that contains one."""
    by_lower = {c.lower(): c for c in columns}
    if requested:
        if requested in columns or requested.lower() in by_lower:
            return requested if requested in columns else by_lower[requested.lower()]
        raise ValueError(f"no column {requested}; there are {columns}")
    for name in candidates:
        if name in by_lower:
            return by_lower[name]
    for c in columns:
        if any(part in c.lower() for part in ("label", "attack", "class")):
            return c
    raise ValueError(f"no label column among {columns}")


def drop_label_like(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df without columns that give the label away."""
    return df.select(*[q(c) for c in df.columns if c.lower() not in LABEL_LIKE or c in keep])


def drop_identifiers(df: DataFrame, parts: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """df without columns whose names hold a host identifier."""
    return df.select(*[q(c) for c in df.columns if not any(p.lower() in c.lower() for p in parts)])


#: Columns whose sketch tells fewer distinct values than this are counted exactly.
EXACT_BELOW = 1000
PROFILE = "column_name string, n long, parse_ratio double, n_distinct long, std double, n_null long"


def profile(df: DataFrame, columns: list[str], exact_below: int = EXACT_BELOW) -> DataFrame:
    """column_name, n, parse_ratio, n_distinct, std (sample), n_null: a row per column (A3). One pass of partial sums and
    mergeable sketches of the distinct values for all columns together; a second pass counts the values of the columns
    that have few, as those decide between categories and high cardinality. Others keep the sketch's estimate."""
    if not columns:
        return df.sparkSession.createDataFrame([], PROFILE)
    stats = []
    for c in columns:
        x, told = number_of(df, c), F.when(q(c).isNotNull(), F.xxhash64(q(c)))
        stats.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.avg(x.isNotNull().cast("double")).alias("parse_ratio"), F.hll_sketch_estimate(F.hll_sketch_agg(told, F.lit(14))).alias("n_distinct"), F.stddev_samp(F.coalesce(x, F.lit(0.0))).alias("std"), F.sum(q(c).isNull().cast("long")).alias("n_null")))
    rows = [r.asDict() for r in df.agg(F.array(*stats).alias("p")).select(F.explode("p").alias("p")).select("p.*").collect()]
    few = [r["column_name"] for r in rows if (r["n_distinct"] or 0) < exact_below]
    if few:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v")) for c in few])).alias("x")).select("x.*").where("v IS NOT NULL")
        exact = {r["c"]: r["n"] for r in long.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = [{**r, "n_distinct": exact.get(r["column_name"], 0)} if r["column_name"] in few else r for r in rows]
    names = [f.split()[0] for f in PROFILE.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[k] for k in names) for r in rows], PROFILE)


def with_kinds(profiled: DataFrame, numeric_ratio: float = 0.9, max_categories: int = 80, least_std: float = 1e-12) -> DataFrame:
    """The profile plus kind (numeric, categorical or dropped) and the reason (P4). A NaN deviation counts as constant."""
    numeric = F.col("parse_ratio") >= numeric_ratio
    varies = F.coalesce((F.col("std") > least_std) & ~F.isnan("std"), F.lit(False))
    kind = F.when(numeric & varies, "numeric").when(~numeric & F.col("n_distinct").between(2, max_categories), "categorical").otherwise("dropped")
    reason = F.when(kind != "dropped", "").when(numeric, "constant").when(F.col("n_distinct") < 2, "constant").otherwise("high_cardinality")
    return profiled.withColumn("kind", kind).withColumn("reason", reason)


def select_by_profile(profiled: DataFrame, numeric_ratio: float = 0.9, max_categories: int = 80, least_std: float = 1e-12) -> DataFrame:
    """column_name, kind and reason alone."""
    return with_kinds(profiled, numeric_ratio, max_categories, least_std).select("column_name", "kind", "reason")


def label_fractions(df: DataFrame, label: str) -> DataFrame:
    """label, n, fraction (A2)."""
    counts = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("_total")).alias("fraction"))


def impute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, median, mean, std (A4): the median of the finite values by selection, then mean and population
    deviation with the median filled in, from sums of one pass; a deviation under 1e-8 counts as 1."""
    finites = {c: finite(number_of(df, c)) for c in columns}
    medians = quantiles(df, finites, [0.5])
    rows = []
    for c, x in finites.items():
        n, m, s, s2 = F.count(F.lit(1)), F.lit(medians[c][0] or 0.0), F.coalesce(F.sum(x), F.lit(0.0)), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        k = F.count(x)
        mean = (s + m * (n - k)) / n
        own = F.when(k > 0, s / k).otherwise(m)
        var = (s2 + k * (own - mean) * (own - mean) + (n - k) * (m - mean) * (m - mean)) / n
        std = F.sqrt(F.greatest(var, F.lit(0.0)))
        rows.append(F.struct(F.lit(c).alias("column_name"), m.alias("median"), mean.alias("mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("std")))
    return df.agg(F.array(*rows).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def quantile_thresholds(df: DataFrame, columns: list[str], at: float = 0.75) -> DataFrame:
    """column_name, threshold (A5): exact interpolated quantiles of all columns at once by selection, nulls as 0."""
    found = quantiles(df, {c: F.coalesce(number_of(df, c), F.lit(0.0)) for c in columns}, [at])
    return df.sparkSession.createDataFrame([(c, v[0]) for c, v in found.items()], "column_name string, threshold double")


def category_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, categories: sorted distinct texts, null as `nan` (A6). For columns that the profile found small."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.sort_array(F.collect_set(F.coalesce(q(c).cast("string"), F.lit("nan")))).alias("categories")) for c in columns]
    return df.agg(F.array(*rows).alias("c")).select(F.explode("c").alias("c")).select("c.*")
