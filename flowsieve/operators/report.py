"""Counts, roll-ups over seeds, baseline deltas, evidence matrices and claim gates (A1, A22-A26, J3, J4, W11, T2-T4,
U1, U2, U4, P16, M7)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import q


def family_counts(df: DataFrame, family: str, dataset: str | None = None) -> DataFrame:
    """Rows by dataset and family with totals (null family, null dataset) in one pass (A1)."""
    keys = [q(dataset).alias("dataset")] if dataset else []
    return df.select(*keys, q(family).alias("family")).rollup(*[k for k in ("dataset", "family") if k == "family" or dataset]).agg(F.count(F.lit(1)).alias("n"))


def require_rows(df: DataFrame, panel: str, column: str = "panel") -> DataFrame:
    """The rows of a panel; an error if there is none."""
    out = df.where(q(column) == panel)
    if out.isEmpty():
        raise ValueError(f"no rows for panel {panel}")
    return out


def boundary_tag(text):
    """What a claim's text says about its reach."""
    x = F.lower(F.coalesce(text, F.lit("")))
    return F.when(x.contains("stress"), "stress").when(x.contains("boundary") | x.contains("mixed"), "boundary").otherwise("supported")


def seed_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """n, mean and sample deviation over seeds of each metric."""
    aggs = [f(q(m)).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*[q(b) for b in by]).agg(F.count(F.lit(1)).alias("n"), *aggs)


def baseline_deltas(df: DataFrame, keys: list[str], baseline: str, metrics: list[str], scenario: str = "scenario") -> DataFrame:
    """keys, scenario and delta_<metric>_vs_<baseline>: each scenario less the baseline of the same keys."""
    base = df.where(q(scenario) == baseline).select(*[q(k).alias(f"_{k}") for k in keys], *[q(m).alias(f"_m_{m}") for m in metrics])
    on = reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.where(q(scenario) != baseline).join(base, on).select(*keys, scenario, *[(q(m) - F.col(f"_m_{m}")).alias(f"delta_{m}_vs_{baseline}") for m in metrics])


def pairwise_deltas(df: DataFrame, keys: list[str], metrics: list[str], scenario: str = "scenario") -> DataFrame:
    """keys, comparison (`b_minus_a` for a < b), metric, delta (J4). Scenarios are few."""
    long = df.unpivot([*keys, scenario], metrics, "metric", "value")
    a = long.select(*[q(k).alias(f"_{k}") for k in keys], q(scenario).alias("_s"), F.col("metric").alias("_m"), F.col("value").alias("_v"))
    on = reduce(lambda x, y: x & y, [q(k).eqNullSafe(F.col(f"_{k}")) for k in keys], (F.col("metric") == F.col("_m")) & (F.col("_s") < q(scenario)))
    return long.join(a, on).select(*keys, F.concat(q(scenario), F.lit("_minus_"), F.col("_s")).alias("comparison"), "metric", (F.col("value") - F.col("_v")).alias("delta"))


def last_rounds(df: DataFrame, by: list[str], order: str = "round") -> DataFrame:
    """The row of the last round of each run."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), q(order)).alias("_r")).select(*by, "_r.*")


def top_values(df: DataFrame, columns: list[str], n: int = 20) -> DataFrame:
    """column_name, value, count, rank: the n most frequent values of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), F.asc("value")))).where(F.col("rank") <= n)


def best_scenarios(df: DataFrame, by: list[str], metric: str, scenario: str = "scenario") -> DataFrame:
    """The scenario with the greatest metric of each group, the first by name on ties (T4)."""
    w = Window.partitionBy(*by).orderBy(F.desc(metric), F.asc(scenario))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, scenario, metric)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of different columns under one another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def evidence_matrix(df: DataFrame, keys: list[str], metric: str, scenarios: list[str], scenario: str = "scenario") -> DataFrame:
    """keys, a column per scenario, and source_gate's lead over the others."""
    wide = df.groupBy(*keys).pivot(scenario, scenarios).agg(F.avg(q(metric)))
    return wide.select(*keys, *scenarios, *[(F.col("source_gate") - F.col(s)).alias(f"source_delta_vs_{s}") for s in scenarios if s != "source_gate"])


#: The columns of a figure source.
FIGURE = ("panel", "evidence_block", "scope", "metric", "traffic_only", "weak_cti", "source_gate", "random_cti", "source_delta_vs_traffic", "source_delta_vs_weak", "boundary")


@dataclass(frozen=True)
class Block:
    """An evidence block of a figure: what of the run metrics it shows (`rows`: a condition), and what it says about its
    reach."""

    panel: str
    name: str
    scope: str
    metric: str
    boundary: str
    rows: str = "true"
    scenarios: tuple[str, ...] = ("traffic_only", "weak_cti", "source_gate", "random_cti")


def figure_source(runs: DataFrame, blocks: list[Block], scenario: str = "scenario") -> DataFrame:
    """A row a block with the columns FIGURE, and `reach`, the tag of its boundary text (U4). All blocks are averages of one
    pass over the run metrics; scenarios that a block leaves out are null, and so are the leads over them."""
    cells = [
        F.struct(*[F.avg(F.when((q(scenario) == s) & F.expr(b.rows), q(b.metric))).alias(s) for s in b.scenarios])
        for b in blocks
    ]
    whole = runs.agg(*[c.alias(f"b{k}") for k, c in enumerate(cells)])

    def row(k: int, b: Block) -> Column:
        value = {s: F.col(f"b{k}.{s}") if s in b.scenarios else F.lit(None).cast("double") for s in ("traffic_only", "weak_cti", "source_gate", "random_cti")}
        value |= {"panel": F.lit(b.panel), "evidence_block": F.lit(b.name), "scope": F.lit(b.scope), "metric": F.lit(b.metric), "boundary": F.lit(b.boundary)}
        value |= {"source_delta_vs_traffic": value["source_gate"] - value["traffic_only"], "source_delta_vs_weak": value["source_gate"] - value["weak_cti"]}
        return F.struct(*[value[c].alias(c) for c in FIGURE], boundary_tag(F.lit(b.boundary)).alias("reach"))

    return whole.select(F.explode(F.array(*[row(k, b) for k, b in enumerate(blocks)])).alias("r")).select("r.*")


def claim_gates(matrix: DataFrame, others: list[str]) -> DataFrame:
    """claim, holds, n: whether source_gate leads each other scenario in every row (M7)."""
    claims = [F.struct(F.lit(f"source_gate_beats_{s}").alias("claim"), F.bool_and(F.col("source_gate") > F.col(s)).alias("holds"), F.count(F.lit(1)).alias("n")) for s in others]
    return matrix.agg(F.array(*claims).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def family_rollup(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """family, recall: tp and support of fine labels summed by family (A24); mapping: label, family."""
    joined = counts.join(mapping, "label")
    return joined.groupBy("family").agg((F.sum("tp") / (F.sum("support") + 1e-12)).alias("recall"), F.sum("support").alias("support"))


def schema_probe(tables: dict[str, DataFrame], label_parts=("label", "attack", "type", "status", "flag"), flow_parts=("byte", "pkt", "quantity", "price", "value", "port", "proto", "dur")) -> DataFrame:
    """dataset, n_rows, n_columns, label_candidates, flow_columns."""
    frames = []
    for name, df in tables.items():
        find = lambda parts, cols=df.columns: ",".join(c for c in cols if any(p in c.lower() for p in parts))
        frames.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(find(label_parts)).alias("label_candidates"), F.lit(find(flow_parts)).alias("flow_columns")))
    return union_all(frames)
