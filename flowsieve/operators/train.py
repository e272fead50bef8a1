"""Softmax regression: class weights, MLlib, and stacks of models with extra loss terms by L-BFGS.

A stack holds models that differ in their features' scales, loss terms and training rows. One scan of the table gives the
losses and gradients of all of them, at several step lengths each, so that the scans don't multiply by models or by the
trials of a line search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.expr import q


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """label, n, weight: total / n, divided by the mean of these over the classes."""
    counts = df.groupBy(q(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("_t"), F.avg(1.0 / F.col("n")).alias("_i")))  # one row
    return counts.join(total).select("label", "n", ((F.col("_t") / F.col("n")) / (F.col("_t") * F.col("_i"))).alias("weight"))


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, row_weight: np.ndarray | None = None, smoothing: float = 0.0, penalty: float = 0.0) -> np.ndarray:
    """Summed gradient of the weighted cross-entropy with label smoothing and a confidence penalty."""
    p = softmax_rows(x @ w)
    target = np.full(p.shape, smoothing / classes)
    target[np.arange(len(y)), y] += 1 - smoothing
    g = p - target
    if penalty:
        logp = np.log(np.clip(p, 1e-12, 1))
        g += penalty * p * (logp - (p * logp).sum(axis=1, keepdims=True))
    if row_weight is not None:
        g *= row_weight[:, None]
    return x.T @ g


#: Rows that a task multiplies at once.
AT_ONCE = 8192
#: Step lengths that a line search tries in the same scan.
LENGTHS = (1.0, 2.0, 0.3, 0.03)


@dataclass(frozen=True)
class Models:
    """What the models of a stack differ in, an entry a model: factors of the features (models x width), label smoothing,
    confidence penalty, and the place in a row's `member` that says how often the row trains the model."""

    scales: np.ndarray
    smoothing: np.ndarray
    penalty: np.ndarray
    bit: np.ndarray

    def some(self, which: np.ndarray) -> Models:
        return Models(self.scales[which], self.smoothing[which], self.penalty[which], self.bit[which])

    @staticmethod
    def of(width: int, alphas: list[float] | None = None, scaled: np.ndarray | None = None, smoothing: float = 0.0, penalty: float = 0.0, bits: int = 1) -> Models:
        """Every alpha (the factor of the features marked in `scaled`) for every bit, bits first."""
        alphas = alphas or [1.0]
        one = np.array([np.where(scaled, a, 1.0) if scaled is not None else np.ones(width) for a in alphas])
        n = bits * len(alphas)
        return Models(np.tile(one, (bits, 1)), np.full(n, min(max(smoothing, 0.0), 0.5)), np.full(n, penalty), np.repeat(np.arange(bits), len(alphas)))


def over_cores(rows: DataFrame) -> DataFrame:
    """rows over all cores, for a table that many scans will read: small tables come in one or two partitions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def cut_off(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder, or a cached table where the session names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir() and (path := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(path)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def stored(rows: DataFrame) -> DataFrame:
    """rows cut off from what they were made of and over all cores, for many scans; unpersist() when these are done. They
    are read as a stream, so an executor holds batches of them however large a partition is; only what is too small to have
    a partition a core is cached as well."""
    cut = cut_off(rows)
    spread = over_cores(cut)
    return cut if spread is cut else spread.persist()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of equally long number lists as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def summed(rows: DataFrame, part: Callable, size: int) -> np.ndarray:
    """The sum over all tasks of part(batches), an array of `size` numbers a task."""

    def run(batches):
        total = part(batches)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["at", "value"])

    out = np.zeros(size)
    got = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[got.column("at").to_numpy()] = got.column("value").to_numpy()
    return out


def losses_by_class(z: np.ndarray, y: np.ndarray, weight: np.ndarray, smoothing: np.ndarray | float, penalty: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted losses rows x columns, their gradients by logit) of logits classes x rows x columns; weight: rows x columns,
    smoothing and penalty: a number or one a column."""
    e = np.exp(z - z.max(axis=0))
    p = e / e.sum(axis=0)
    logp = np.log(np.clip(p, 1e-12, 1.0))
    at = (y, np.arange(len(y)))
    loss, g = -smoothing / len(z) * logp.sum(axis=0) - (1.0 - smoothing) * logp[at], p - smoothing / len(z)
    g[at] -= 1.0 - smoothing
    if np.any(penalty):
        inner = (p * logp).sum(axis=0)
        loss, g = loss + penalty * inner, g + penalty * p * (logp - inner)
    return loss * weight, g * weight


def loss_rows(z: np.ndarray, y: np.ndarray, weight: np.ndarray, smoothing: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted losses, their gradients by logit) of logits rows x trials x classes."""
    loss, g = losses_by_class(z.transpose(2, 0, 1), y, weight[:, None], smoothing, penalty)
    return loss, g.transpose(1, 2, 0)


#: Logits that a task holds at once.
LOGITS = 1 << 19


def stack_sums(rows: DataFrame, models: Models, w: np.ndarray, class_weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of each model, summed loss by model and trial, summed gradient) at weights models x trials x (width + 1) x
    classes, in one scan of rows (features, y, member). member: an array of how often the row is among those of each place,
    or a bit set. The factor of a feature is moved to its weights, so that all models and trials are one product with the
    rows as they are."""
    n_models, trials, deep, classes = w.shape
    held = rows.sparkSession.sparkContext.broadcast((models, w, class_weights))
    member = F.col("member")
    if not isinstance(rows.schema["member"].dataType, ArrayType):
        member = F.array(*[F.shiftright(member.cast("long"), k).bitwiseAND(F.lit(1).cast("long")) for k in range(len(class_weights))])
    at_once = max(1, min(AT_ONCE, LOGITS // (n_models * trials * classes)))

    def part(batches):
        models, w, class_weights = held.value
        factors = np.column_stack([models.scales, np.ones(n_models)])[:, None, :, None]
        wide = (w * factors).transpose(3, 2, 0, 1).reshape(classes, deep, -1)  # a column a model and trial
        smoothing, penalty = np.repeat(models.smoothing, trials), np.repeat(models.penalty, trials)
        n, loss, g = np.zeros(n_models), np.zeros(n_models * trials), np.zeros(wide.shape)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                piece = batch.slice(start, at_once)
                x, y = matrix(piece.column(0), deep - 1), piece.column(1).to_numpy()
                x, times = np.column_stack([x, np.ones(len(x))]), matrix(piece.column(2), len(class_weights))
                n += times.sum(axis=0)[models.bit]
                weight = np.repeat((times * class_weights[:, y].T)[:, models.bit], trials, axis=1)
                l, gz = losses_by_class(np.matmul(x, wide), y, weight, smoothing, penalty)
                loss += l.sum(axis=0)
                g += np.matmul(x.T, gz)
        return np.concatenate([n, loss, (g.reshape(classes, deep, n_models, trials).transpose(2, 3, 1, 0) * factors).ravel()])

    flat = summed(rows.select("features", F.col("y").cast("long"), member.alias("member")), part, n_models * (1 + trials) + w.size)
    return flat[:n_models], flat[n_models : n_models * (1 + trials)].reshape(n_models, trials), flat[n_models * (1 + trials) :].reshape(w.shape)


def _direction(g: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """The two-loop recursion over the last steps and changes of the gradient."""
    d, used = -g, []
    for s, c in zip(reversed(steps), reversed(changes), strict=True):
        a = (s @ d) / (c @ s)
        d = d - a * c
        used.append(a)
    if steps:
        d = d * ((steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1]))
    for s, c, a in zip(steps, changes, reversed(used), strict=True):
        d = d + s * (a - (c @ d) / (c @ s))
    return d


def minimise(evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, iterations: int = 60, tolerance: float = 1e-7, memory: int = 10) -> tuple[np.ndarray, list[np.ndarray]]:
    """(weights, losses of all models after each iteration) by L-BFGS on a stack: start is models x numbers; evaluate maps
    models x trials x numbers, and which models these are, to losses (models x trials) and gradients. An iteration is one
    call of evaluate for the models that still move: it tries all step lengths, and of those that lower the loss enough
    (Armijo) the lowest is taken. A model stands still once no length does, from its plain gradient as well, or once it
    gains less than `tolerance`."""
    w, n = start.copy(), len(start)
    f, g = (x[:, 0].copy() for x in evaluate(w[:, None], np.arange(n)))
    steps, changes = [[] for _ in range(n)], [[] for _ in range(n)]
    open_, seen = np.ones(n, dtype=bool), [f.copy()]
    lengths = np.array(LENGTHS)
    for _ in range(iterations):
        which = np.flatnonzero(open_)
        if not len(which):
            break
        d = np.stack([_direction(g[m], steps[m], changes[m]) / (1.0 if steps[m] else max(1.0, np.linalg.norm(g[m]))) for m in which])
        slope = (d * g[which]).sum(axis=1)
        trial = w[which, None] + lengths[None, :, None] * d[:, None]
        fs, gs = evaluate(trial, which)
        fs = np.where(np.isfinite(fs) & (fs <= f[which, None] + 1e-4 * lengths * slope[:, None]), fs, np.inf)
        for i, m in enumerate(which):
            k = int(np.argmin(fs[i]))
            if not np.isfinite(fs[i, k]):
                open_[m] = bool(steps[m])
                steps[m], changes[m] = [], []
                continue
            s, c = trial[i, k] - w[m], gs[i, k] - g[m]
            if s @ c > 1e-12:
                steps[m], changes[m] = [*steps[m][1 - memory :], s], [*changes[m][1 - memory :], c]
            open_[m] = f[m] - fs[i, k] > tolerance * max(1.0, abs(f[m]))
            w[m], f[m], g[m] = trial[i, k], fs[i, k], gs[i, k]
        seen.append(f.copy())
    return w, seen


def fit_stack(rows: DataFrame, models: Models, classes: int, class_weights: np.ndarray | None = None, decay: float = 1e-4, iterations: int = 60) -> tuple[np.ndarray, list[np.ndarray]]:
    """(weights models x (width + 1) x classes with the bias last, mean losses after each iteration) of rows (features, y,
    member). Persist rows before: every iteration scans them once for all models. class_weights: places of member x
    classes."""
    n_models, width = models.scales.shape
    table = np.ones((int(models.bit.max()) + 1, classes)) if class_weights is None else class_weights

    def evaluate(flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = flat.reshape(len(which), -1, width + 1, classes)
        n, loss, g = stack_sums(rows, models.some(which), w, table)
        n = np.maximum(n, 1.0)
        inner = w[:, :, :-1]
        g = g / n[:, None, None, None]
        g[:, :, :-1] += decay * inner
        return loss / n[:, None] + decay / 2 * (inner * inner).sum(axis=(2, 3)), g.reshape(flat.shape)

    w, losses = minimise(evaluate, np.zeros((n_models, (width + 1) * classes)), iterations)
    return w.reshape(n_models, width + 1, classes), losses


def fit_softmax(df: DataFrame, classes: int, width: int, iterations: int = 60, decay: float = 1e-4, weights: dict[int, float] | None = None, smoothing: float = 0.0, penalty: float = 0.0, features: str = "features", label: str = "y") -> tuple[np.ndarray, list[float]]:
    """(weights with the bias as last row, mean loss after each iteration) of one model (M2, H4)."""
    rows = df.select(q(features).alias("features"), q(label).alias("y"), F.lit(1).alias("member"))
    table = np.array([[(weights or {}).get(k, 1.0) for k in range(classes)]])
    w, losses = fit_stack(rows, Models.of(width, smoothing=smoothing, penalty=penalty), classes, table, decay, iterations)
    return w[0], [float(x[0]) for x in losses]


def fit_multinomial(df: DataFrame, decay: float = 1e-4, max_iter: int = 80, features: str = "features", label: str = "y"):
    """MLlib's multinomial regression on features that are scaled already, with class weights (M1). MLlib divides the
    loss by the sum of weights, hence the scaled penalty. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    weights = F.broadcast(class_weights(df, label).select(F.col("label").alias("_l"), "weight"))
    data = df.join(weights, q(label) == F.col("_l")).select(array_to_vector(q(features)).alias("features"), q(label).cast("double").alias("label"), "weight")
    n, total = data.agg(F.count(F.lit(1)), F.sum("weight")).head()
    return LogisticRegression(family="multinomial", weightCol="weight", standardization=False, maxIter=max_iter, regParam=decay * n / total).fit(data)
