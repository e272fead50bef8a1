"""Temperature scaling, global and by gate bin, and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import q, softmax
from .quantiles import quantiles

#: 26 temperatures from 0.5 to 3 and 20 from 3.25 to 8, evenly spaced.
GRID = [0.5 + i * 0.1 for i in range(26)] + [3.25 + i * 0.25 for i in range(20)]
#: Scales of the evidence among which the validation rows choose.
ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25]


def _losses(logits: Column, y: Column, grid: list[float]) -> Column:
    """The row's loss at each temperature. The logits less their maximum are bound once (by a transform over one
    element); each temperature is then one sum of exponentials."""
    shifted = F.transform(logits, lambda v: v - F.array_max(logits))
    points = F.array(*[F.lit(float(max(t, 1e-6))) for t in grid])

    def row(z: Column) -> Column:
        own = F.element_at(z, (y + 1).cast("int"))
        return F.transform(points, lambda t: -F.ln(F.exp(own / t) / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v / t)) + 1e-12))

    return F.transform(F.array(shifted), row)[0]


def temperature_losses(df: DataFrame, by: tuple[str, ...] = (), grid: list[float] | None = None) -> DataFrame:
    """nll: array of the mean loss at each temperature, n, n_labels: one pass with an average per grid point."""
    grid = grid or GRID
    losses = df.select(*by, "y", _losses(q("logits"), q("y"), grid).alias("l"))
    return losses.groupBy(*by).agg(F.array(*[F.avg(F.col("l")[k]) for k in range(len(grid))]).alias("nll"), F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("n_labels"))


def best_temperature(losses: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """losses plus temperature: the first minimum."""
    points = F.array(*[F.lit(float(t)) for t in (grid or GRID)])
    return losses.withColumn("temperature", F.get(points, (F.array_position("nll", F.array_min("nll")) - 1).cast("int")))


def gate_thresholds(df: DataFrame, gate: str, bins: int) -> list[float]:
    """Distinct inner quantiles of the gate score, exact by selection."""
    found = quantiles(df, {gate: q(gate)}, [k / bins for k in range(1, bins)])[gate]
    return sorted({x for x in found if x is not None})


def gate_bin(gate: Column, thresholds: list[float]) -> Column:
    """Number of thresholds under the score."""
    return sum(((gate > t).cast("int") for t in thresholds), F.lit(0))


def binned_temperatures(df: DataFrame, gate: str, bins: int, min_rows: int = 50) -> tuple[DataFrame, list[float]]:
    """(gate_bin, n, temperature; thresholds): the bin's own temperature, or the global one for bins of fewer than
    min_rows rows or one label (A15)."""
    thresholds = gate_thresholds(df, gate, bins)
    whole = best_temperature(temperature_losses(df)).select(F.col("temperature").alias("_global"))
    own = best_temperature(temperature_losses(df.withColumn("gate_bin", gate_bin(q(gate), thresholds)), ("gate_bin",)))
    small = (F.col("n") < min_rows) | (F.col("n_labels") < 2)
    return own.join(F.broadcast(whole)).select("gate_bin", "n", F.when(small, F.col("_global")).otherwise(F.col("temperature")).alias("temperature")), thresholds


def apply_binned(df: DataFrame, gate: str, temperatures: DataFrame, thresholds: list[float]) -> DataFrame:
    """df plus temperature and probs of its gate bin (J7); the table of bins has as many rows as bins. A bin without
    fitted temperature keeps 1."""
    out = df.withColumn("gate_bin", gate_bin(q(gate), thresholds)).join(F.broadcast(temperatures.select("gate_bin", "temperature")), "gate_bin", "left")
    out = out.withColumn("temperature", F.coalesce("temperature", F.lit(1.0)))
    return out.withColumn("probs", softmax(q("logits"), F.col("temperature")))


def select_candidate(candidates: DataFrame, by: tuple[str, ...], mode: str = "band") -> DataFrame:
    """The chosen row of each group (W10). `band`: within max(0.010, 0.025 * best F1) of the best F1 the least (ece, nll,
    -F1, alpha); `score`: the greatest (macro_f1 - 0.75 ece - 0.10 brier, -ece, F1, -alpha)."""
    w = Window.partitionBy(*by)
    if mode == "band":
        best = F.max("macro_f1").over(w)
        pool = candidates.withColumn("_best", best).where(F.col("macro_f1") >= F.col("_best") - F.greatest(F.lit(0.010), 0.025 * F.abs("_best"))).drop("_best")
        order = [F.asc("ece"), F.asc("nll"), F.desc("macro_f1"), F.asc("alpha")]
    else:
        pool = candidates
        order = [F.desc(F.col("macro_f1") - 0.75 * F.col("ece") - 0.10 * F.col("brier")), F.asc("ece"), F.desc("macro_f1"), F.asc("alpha")]
    return pool.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1").drop("_r")
