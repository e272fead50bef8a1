"""Scores and evaluation (F1, F2, A7-A12, A27, H3). The tables are reduced to k*k or bins rows by one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import argmax, brier, ece_bin, linear_logits, q, softmax

#: Confidence bins.
BINS = 15


def score_logits(df: DataFrame, logits: str = "logits", temperature: float = 1.0) -> DataFrame:
    """df plus probs, pred (first maximum) and confidence (F1)."""
    return df.withColumn("probs", softmax(q(logits), temperature)).withColumn("pred", argmax(F.col("probs"))).withColumn("confidence", F.array_max("probs"))


def score_linear(df: DataFrame, weights: np.ndarray, bias: np.ndarray, features: str = "features") -> DataFrame:
    """df plus logits: x . w + b (F2). Few classes and features stay in expressions, others go by Arrow batch (H3)."""
    if weights.size <= 256:
        return df.withColumn("logits", linear_logits(q(features), weights.tolist(), bias.tolist()))
    held = df.sparkSession.sparkContext.broadcast((np.asarray(weights, float), np.asarray(bias, float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = held.value
        for part in batches:
            x = np.stack(part[features].to_numpy()) if len(part) else np.zeros((0, w.shape[0]))
            yield part.assign(logits=list(x @ w + b))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))]))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """y, pred, n: at most k * k rows a group of `by`."""
    return df.groupBy(*by, q(y).cast("int").alias("y"), q(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """label_id, tp, fp, fn, support for every class of the dimension, also those without rows."""
    truth = cells.groupBy(*by, F.col("y").alias("label_id")).agg(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0)).alias("fn"))
    guess = cells.groupBy(*by, F.col("pred").alias("label_id")).agg(F.sum(F.when(F.col("y") != F.col("pred"), F.col("n")).otherwise(0)).alias("fp"))
    groups = cells.select(*by).distinct().join(F.broadcast(classes.select("label_id"))) if by else classes.select("label_id")
    on = [*by, "label_id"]
    joined = groups.join(truth, on, "left").join(guess, on, "left")
    return joined.select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]).withColumn("support", F.col("tp") + F.col("fn"))


def family_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, 1e-12 in every denominator."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-12), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-12)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / (p + r + 1e-12))


def summary_scores(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy and macro_f1 over all classes."""
    return scores.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def normal_fpr(df: DataFrame, benign: list[int], y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of benign rows that are predicted to be something else; null without benign rows."""
    return df.groupBy(*by).agg(F.avg(F.when(q(y).isin(*benign), (~q(pred).isin(*benign)).cast("double"))).alias("normal_fpr"))


def reliability_table(df: DataFrame, bins: int = BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, n, accuracy, confidence, gap: the bins that have rows."""
    hit = (F.col("pred") == F.col("y")).cast("double")
    out = df.groupBy(*by, ece_bin(F.col("confidence"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def calibration(df: DataFrame, bins: int = BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """ece, brier and mean_confidence (A10, A11), all from one aggregate by bin."""
    hit = (F.col("pred") == F.col("y")).cast("double")
    table = df.groupBy(*by, ece_bin(F.col("confidence"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.sum("confidence").alias("conf"), F.sum(brier(F.col("probs"), F.col("y"))).alias("b"))
    return table.groupBy(*by).agg((F.sum(F.abs(F.col("hits") - F.col("conf"))) / F.sum("n")).alias("ece"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("conf") / F.sum("n")).alias("mean_confidence"))


def ranking_by_class(long: DataFrame, ranges: int = 256) -> DataFrame:
    """label_id, auroc (ties count half) and auprc (step-wise) from rows (label_id, s, positive), all classes at once.
    Rows are counted by class and score value; scores are cut into ranges of about equally many values by class, running
    sums go over a range, and those of the ranges before it are added. So no task holds all scores of a class, and the
    number of jobs doesn't depend on the classes."""
    counts = long.where("s IS NOT NULL").groupBy("label_id", "s").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum((~F.col("positive")).cast("long")).alias("m"))
    edges = counts.groupBy("label_id").agg(F.percentile_approx("s", [k / ranges for k in range(1, ranges)], 1000).alias("_edges"))
    ranged = counts.join(F.broadcast(edges), "label_id").withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("s")))).drop("_edges")
    before = Window.partitionBy("label_id").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("label_id", "_part").agg(F.sum("p").alias("_p"), F.sum("m").alias("_m"))  # `ranges` rows a class
    sums = sums.select("label_id", "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}b") for c in ("_p", "_m")], *[F.sum(c).over(Window.partitionBy("label_id")).alias(f"{c}t") for c in ("_p", "_m")])
    upto = Window.partitionBy("label_id", "_part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(sums, ["label_id", "_part"]).withColumn("tp", F.col("_pb") + F.sum("p").over(upto)).withColumn("fp", F.col("_mb") + F.sum("m").over(upto))
    area, all_pairs = F.sum(F.col("m") * (F.col("tp") - F.col("p") / 2.0)), F.max(F.col("_pt").cast("double") * F.col("_mt"))
    return run.groupBy("label_id").agg((area / F.nullif(all_pairs, F.lit(0.0))).alias("auroc"), F.sum(F.col("p") / F.nullif(F.col("_pt").cast("double"), F.lit(0.0)) * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("auprc"))


def ranking_scores(df: DataFrame, score: str, positive: str) -> DataFrame:
    """auroc and auprc of a score (A27); null without rows of both kinds."""
    one = ranking_by_class(df.select(F.lit(0).alias("label_id"), q(score).alias("s"), q(positive).alias("positive")))
    return one.agg(F.max("auroc").alias("auroc"), F.max("auprc").alias("auprc"))


def macro_ranking(df: DataFrame, classes: int, probs: str = "probs", y: str = "y") -> DataFrame:
    """auroc and auprc, each class against the rest, and the plain mean over the classes that have rows and others."""
    long = df.select(q(y).alias("_y"), F.posexplode(F.slice(q(probs), 1, classes)).alias("label_id", "s")).select("label_id", "s", (F.col("_y") == F.col("label_id")).alias("positive"))
    return ranking_by_class(long).where("auroc IS NOT NULL").agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"), F.count(F.lit(1)).alias("n_classes"))


def retention(clean: DataFrame, poisoned: DataFrame, score: str, by: tuple[str, ...]) -> DataFrame:
    """by, clean, poisoned, retention: the poisoned score as a share of the clean one (A27); null where that is 0."""
    a, b = clean.select(*by, q(score).alias("clean")), poisoned.select(*by, q(score).alias("poisoned"))
    return a.join(b, list(by)).withColumn("retention", F.when(F.col("clean") != 0, F.col("poisoned") / F.col("clean")))

def evaluation_sums(p: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """models x cells from probabilities rows x models x classes: the confusion counts, then of each confidence bin rows,
    hits and summed confidence, then the summed squared distance to the labels. Sums of parts are those of the whole;
    times: how many equal rows each row stands for."""
    rows, n_models, classes = p.shape
    times = np.broadcast_to(np.ones(1) if times is None else np.asarray(times, float)[:, None], (rows, n_models))
    pred, confidence = p.argmax(axis=2), p.max(axis=2)
    bins = np.minimum(np.floor(confidence * BINS), BINS - 1).astype(np.int64)
    hit = (pred == y[:, None]).astype(float)
    away = (p * p).sum(axis=2) - 2 * np.take_along_axis(p, np.broadcast_to(y[:, None, None], (rows, n_models, 1)), 2)[:, :, 0] + 1
    of = np.arange(n_models)[None, :]
    count = lambda at, size, weight: np.bincount((of * size + at).ravel(), weights=weight.ravel(), minlength=n_models * size).reshape(n_models, size)
    return np.hstack([count(y[:, None] * classes + pred, classes * classes, times), count(bins, BINS, times), count(bins, BINS, hit * times), count(bins, BINS, confidence * times), (away * times).sum(axis=0)[:, None]])


def scores_of(cells: np.ndarray, classes: int, benign: Iterable[int] = (0,)) -> dict[str, float | None]:
    """accuracy, macro_f1, normal_fpr, ece, brier and mean_confidence of one model's evaluation sums."""
    table, rest = cells[: classes * classes].reshape(classes, classes), cells[classes * classes :]
    n, hits, confidence = rest[:BINS], rest[BINS : 2 * BINS], rest[2 * BINS : 3 * BINS]
    tp, total, ordinary = np.diag(table), table.sum(), list(benign)
    p, r = tp / (table.sum(axis=0) + 1e-12), tp / (table.sum(axis=1) + 1e-12)
    of_benign = table[ordinary]
    if not total:
        return dict.fromkeys(("accuracy", "macro_f1", "normal_fpr", "ece", "brier", "mean_confidence"))
    return {
        "accuracy": float(tp.sum() / total), "macro_f1": float((2 * p * r / (p + r + 1e-12)).mean()), "normal_fpr": float(1 - of_benign[:, ordinary].sum() / of_benign.sum()) if of_benign.sum() else None,
        "ece": float(np.abs(hits - confidence).sum() / total), "brier": float(rest[3 * BINS] / total), "mean_confidence": float(confidence.sum() / total),
    }
