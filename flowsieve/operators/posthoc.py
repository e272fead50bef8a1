"""Validation-selected scale of the evidence, and post-hoc calibration by gate bins (M6).

For every seed the training rows lose a share to validation; a model is trained for every scale of the evidence and every
seed, all in one stack. On the validation rows each is judged as it is (temperature 1); one scale a seed is chosen by each
of the two rules of W10. The chosen models get a temperature, and one for each of two and three bins of the gate score,
from their validation rows, and are judged on the test rows with each. All models are judged in one scan of the rows a
stage, so scans don't multiply by seeds or scales."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import hash_order, q
from .calibrate import ALPHAS, GRID, select_candidate
from .metrics import BINS, evaluation_sums, scores_of
from .quantiles import quantiles
from .train import AT_ONCE, Models, fit_stack, matrix, stored, summed

#: Scenario of each rule of W10.
RULES = {"cal_source_gate": "band", "cal_source_gate_ece": "score"}
BIN_NUMBERS = (2, 3)
RESULT = (
    "scenario string, seed int, alpha double, temperature double, train_rows long, valid_rows long, test_rows long, valid_macro_f1 double, valid_raw_ece double, valid_nll double, accuracy double, macro_f1 double, normal_fpr double, "
    "raw_ece double, raw_brier double, temp_ece double, temp_brier double, group2_ece double, group2_brier double, group3_ece double, group3_brier double"
)


def marked(df: DataFrame, seeds: tuple[int, ...], valid_ratio: float) -> DataFrame:
    """df plus bit sets over the seeds: `member` of the rows that train, `valid` of those that validate."""
    bits = lambda wanted: sum((F.when((F.col("split") == "train") & wanted(_valid(s, valid_ratio)), 1 << k).otherwise(0) for k, s in enumerate(seeds)), F.lit(0)).cast("long")
    return df.withColumn("member", bits(lambda v: ~v)).withColumn("valid", bits(lambda v: v))


def _valid(seed: int, ratio: float):
    return F.conv(F.substring(hash_order(seed, "valid", q("key")), 1, 8), 16, 10).cast("double") < ratio * float(1 << 32)


def role_counts(df: DataFrame, by: list[str], seeds: tuple[int, ...], valid_ratio: float) -> DataFrame:
    """A row for every value of `by`, with the numbers of its rows: arrays over the seeds `member` of those that train and
    `valid` of those that validate, and `test`. df: key, split (train, test) and `by`."""
    marks = marked(df, seeds, valid_ratio).select(*by, "member", "valid", (F.col("split") == "test").alias("_t"))
    bit = lambda c, k: F.sum(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")))
    return marks.groupBy(*by).agg(*[F.array(*[bit(c, k) for k in range(len(seeds))]).alias(c) for c in ("member", "valid")], F.count(F.when(F.col("_t"), 1)).alias("test"))


def judge(rows: DataFrame, w: np.ndarray, bits: np.ndarray, part: Callable, size: int) -> np.ndarray:
    """models x size: sums of part(model, logits, y, gate, times) over the rows (features, y, of, gate) that the model's
    place in `of` numbers. w: models x (width + 1) x classes, for features that aren't scaled."""
    held = rows.sparkSession.sparkContext.broadcast((w, bits))

    def run(batches):
        w, bits = held.value
        out = np.zeros((len(w), size))
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(start, AT_ONCE)
                x, y, gate = matrix(piece.column(0), w.shape[1] - 1), piece.column(1).to_numpy(), piece.column(3).to_numpy(zero_copy_only=False)
                x, of = np.column_stack([x, np.ones(len(x))]), matrix(piece.column(2), bits.max() + 1)
                for m in range(len(w)):
                    own = np.flatnonzero(of[:, bits[m]])
                    if len(own):
                        out[m] += part(m, x[own] @ w[m], y[own], gate[own], of[own, bits[m]])
        return out.ravel()

    return summed(rows, run, len(w) * size).reshape(len(w), size)


def probabilities(z: np.ndarray, temperature: np.ndarray | float) -> np.ndarray:
    e = np.exp((z - z.max(axis=1, keepdims=True)) / np.reshape(temperature, (-1, 1)))
    return e / e.sum(axis=1, keepdims=True)


def _losses(z: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Summed loss at each temperature of the grid."""
    shifted = z - z.max(axis=1, keepdims=True)
    own = shifted[np.arange(len(y)), y]
    return np.array([-np.log(np.exp(own / t) / np.exp(shifted / t).sum(axis=1) + 1e-12) @ times for t in GRID])


def alpha_grid(df: DataFrame, scaled: np.ndarray, classes: int, seeds: tuple[int, ...] = (42, 43, 44), alphas: list[float] | None = None, valid_ratio: float = 0.2, smoothing: float = 0.05, penalty: float = 0.01, decay: float = 1e-4, iterations: int = 80, min_rows: int = 50, benign: tuple[int, ...] = (0,)) -> DataFrame:
    """A row a rule and seed with the columns RESULT. df: key, split (train, test), y, features, gate; scaled: which
    features are evidence."""
    return counted_grid(role_counts(df, ["features", "y", "gate"], seeds, valid_ratio), scaled, classes, seeds, alphas, smoothing, penalty, decay, iterations, min_rows, benign)


def counted_grid(df: DataFrame, scaled: np.ndarray, classes: int, seeds: tuple[int, ...] = (42, 43, 44), alphas: list[float] | None = None, smoothing: float = 0.05, penalty: float = 0.01, decay: float = 1e-4, iterations: int = 80, min_rows: int = 50, benign: tuple[int, ...] = (0,)) -> DataFrame:
    """The same from rows with the numbers of `role_counts`: features, y, gate, member, valid, test. Every scan goes over
    these rows, which are stored once; what many rows share is computed once and weighs as much."""
    alphas = alphas or ALPHAS
    spark, n_seeds, width, cells = df.sparkSession, len(seeds), len(scaled), classes * classes + 3 * BINS + 1
    rows = stored(df.select("features", F.col("y").cast("long").alias("y"), "member", "valid", F.array(*[F.col("test")] * n_seeds).alias("test"), F.col("gate").cast("double").alias("gate")))
    of = lambda name: rows.select("features", "y", F.col(name).alias("of"), "gate")

    sizes = rows.groupBy("y").agg(*[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("member", "valid", "test") for k in range(n_seeds)]).collect()  # a row a class
    counts = {c: np.array([[next((r[f"{c}{k}"] for r in sizes if r["y"] == y), 0) for y in range(classes)] for k in range(n_seeds)], dtype=float) for c in ("member", "valid", "test")}
    weights = counts["member"].sum(axis=1, keepdims=True) / np.maximum(counts["member"], 1.0)
    weights /= weights.mean(axis=1, keepdims=True)

    models = Models.of(width, alphas, scaled, smoothing, penalty, n_seeds)
    w, _ = fit_stack(rows, models, classes, weights, decay, iterations)
    plain = np.concatenate([w[:, :-1] * models.scales[:, :, None], w[:, -1:]], axis=1)

    # judged as they are, with the loss at every temperature
    seen = judge(of("valid"), plain, models.bit, lambda m, z, y, gate, times: np.concatenate([evaluation_sums(probabilities(z, 1.0)[:, None], y, times)[0], _losses(z, y, times)]), cells + len(GRID))
    candidates = []
    for m in range(len(plain)):
        n, s = max(1.0, counts["valid"][models.bit[m]].sum()), scores_of(seen[m, :cells], classes, benign)
        nll = seen[m, cells:] / n
        candidates.append((int(seeds[models.bit[m]]), m, float(alphas[m % len(alphas)]), s["macro_f1"], s["ece"], s["brier"], float(nll.min()), float(GRID[int(nll.argmin())])))
    table = spark.createDataFrame(candidates, "seed int, model int, alpha double, macro_f1 double, ece double, brier double, nll double, temperature double")
    chosen = [(name, r) for name, rule in RULES.items() for r in sorted(select_candidate(table, ("seed",), rule).collect(), key=lambda r: r["seed"])]

    # temperatures of the bins of the gate score, whose edges are those of the seed's validation rows
    at = sorted({k / b for b in BIN_NUMBERS for k in range(1, b)})
    found = quantiles(rows, {str(k): F.col("gate") for k in range(n_seeds)}, at, times={str(k): F.col("valid")[k] for k in range(n_seeds)})
    edges = [[np.array(sorted({found[str(k)][at.index(j / b)] for j in range(1, b)} - {None})) for b in BIN_NUMBERS] for k in range(n_seeds)]
    w, bits = plain[[r["model"] for _, r in chosen]], np.array([seeds.index(r["seed"]) for _, r in chosen])
    most = max(BIN_NUMBERS)

    def bin_sums(m, z, y, gate, times):
        out = np.zeros((len(BIN_NUMBERS), most, len(GRID) + classes))
        for b, e in enumerate(edges[bits[m]]):
            bins = np.searchsorted(e, gate, side="left")
            for k in np.unique(bins):
                own = bins == k
                out[b, k] = np.concatenate([_losses(z[own], y[own], times[own]), np.bincount(y[own], times[own], minlength=classes)])
        return out.ravel()

    fitted = judge(of("valid"), w, bits, bin_sums, len(BIN_NUMBERS) * most * (len(GRID) + classes)).reshape(len(w), len(BIN_NUMBERS), most, -1)
    losses, labels = fitted[..., : len(GRID)], fitted[..., len(GRID) :]
    whole = np.array([r["temperature"] for _, r in chosen])
    enough = (labels.sum(axis=3) >= min_rows) & ((labels > 0).sum(axis=3) >= 2)
    binned = np.where(enough, np.array(GRID)[losses.argmin(axis=3)], whole[:, None, None])
    binned = np.where(labels.sum(axis=3) > 0, binned, 1.0)  # a bin without rows has no temperature

    def test_sums(m, z, y, gate, times):
        at = [1.0, whole[m], *[binned[m, b][np.searchsorted(e, gate, side="left")] for b, e in enumerate(edges[bits[m]])]]
        return np.concatenate([evaluation_sums(probabilities(z, t)[:, None], y, times)[0] for t in at])

    tested = judge(of("test"), w, bits, test_sums, (2 + len(BIN_NUMBERS)) * cells).reshape(len(w), -1, cells)
    rows.unpersist()
    out = []
    for m, (name, r) in enumerate(chosen):
        raw, temp, *groups = [scores_of(x, classes, benign) for x in tested[m]]
        k = bits[m]
        out.append((
            name, r["seed"], r["alpha"], r["temperature"], *[int(counts[c][k].sum()) for c in ("member", "valid", "test")], r["macro_f1"], r["ece"], r["nll"],
            raw["accuracy"], raw["macro_f1"], raw["normal_fpr"], raw["ece"], raw["brier"], temp["ece"], temp["brier"], *[x for g in groups for x in (g["ece"], g["brier"])],
        ))
    return spark.createDataFrame(out, RESULT)
