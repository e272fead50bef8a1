"""Client updates: stress transforms, robust aggregation and per-client training.

A client is a real key of the table (a site, a device, a user). Updates are a long table (client, coord, value, n)."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import hash_order, q
from .metrics import BINS, evaluation_sums, scores_of
from .sampling import distributed_row_number, hash_bucket
from .train import AT_ONCE, cut_off, matrix, softmax_rows, stored, summed

UPDATE = "client int, coord int, value double, n long"


def malicious(client: Column, clients: int, ratio: float) -> Column:
    """The clients with the lowest ids, floor(clients * ratio) of them."""
    return client < math.floor(clients * ratio)


def flip_labels(y: Column, classes: int, chosen: Column) -> Column:
    """(y + 1) mod k on the chosen rows."""
    return F.when(chosen, F.pmod(y + 1, F.lit(classes))).otherwise(y)


def scale_updates(updates: DataFrame, base: DataFrame, chosen: Column, by: float) -> DataFrame:
    """Chosen clients' values as base + by * (value - base) (P14); base: coord, value, one row a coordinate."""
    b = base.select(F.col("coord").alias("_c"), F.col("value").alias("_b"))
    joined = updates.join(b, F.col("coord") == F.col("_c"))
    return joined.withColumn("value", F.when(chosen, F.col("_b") + by * (F.col("value") - F.col("_b"))).otherwise(F.col("value"))).select(*updates.columns)


def weighted_average(updates: DataFrame) -> DataFrame:
    """coord, value."""
    return updates.groupBy("coord").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))


def coordinate_median(updates: DataFrame) -> DataFrame:
    """coord, value; an even number of clients averages the middle two."""
    return updates.groupBy("coord").agg(F.median("value").alias("value"))


def trimmed_mean(updates: DataFrame, ratio: float = 0.2) -> DataFrame:
    """coord, value: the mean without the floor(ratio * m) least and greatest, or the plain mean where that leaves
    nothing (A19)."""
    w = Window.partitionBy("coord")
    ranked = updates.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy("value", "client"))).withColumn("_t", F.floor(F.lit(ratio) * F.col("_m")))
    keep = (F.col("_t") <= 0) | (2 * F.col("_t") >= F.col("_m")) | ((F.col("_r") > F.col("_t")) & (F.col("_r") <= F.col("_m") - F.col("_t")))
    return ranked.where(keep).groupBy("coord").agg(F.avg("value").alias("value"))


#: Coordinates that a task multiplies at once, and clients of a block.
COORDS, CLIENTS = 4096, 256


def client_distances(updates: DataFrame, clients_at_once: int = CLIENTS, coords_at_once: int = COORDS) -> DataFrame:
    """a, b, distance: squared distance of every two clients (J5), by blocked Gram matrices. The coordinates are cut into
    slices and the clients into blocks; each pair of blocks of a slice is one matrix product in a task, and the partial
    inner products are summed by client pair, so no row is made for a pair and a coordinate."""
    slices = updates.select("client", F.floor(F.col("coord") / coords_at_once).cast("int").alias("slice"), F.pmod("coord", F.lit(coords_at_once)).cast("int").alias("at"), "value")
    rows = slices.groupBy("client", "slice").agg(F.collect_list(F.struct("at", "value")).alias("x"))  # coords_at_once entries at most
    blocks = max(1, -(-updates.select("client").distinct().count() // clients_at_once))
    block = F.pmod(F.xxhash64("client"), F.lit(blocks)).cast("int")
    # a block meets each block of at least its own number
    ends = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = rows.withColumn("block", block).withColumn("other", ends).select("client", "slice", "x.at", "x.value", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def run(key, table):
        client, of = table.column("client").to_numpy(), table.column("block").to_numpy()
        m = np.zeros((len(client), coords_at_once))
        at, value = table.column("at").combine_chunks(), table.column("value").combine_chunks()
        m[np.repeat(np.arange(len(client)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = value.flatten().to_numpy()
        low, high = np.flatnonzero(of == key[1].as_py()), np.flatnonzero(of == key[2].as_py())
        # |a|^2 - 2ab + |b|^2 of vectors that lie close together and far from zero would lose digits
        centre = m[int(np.argmin(client))]
        left, right = m[low] - centre, m[high] - centre
        d = (left * left).sum(axis=1)[:, None] - 2 * (left @ right.T) + (right * right).sum(axis=1)[None, :]
        i, j = np.meshgrid(client[low], client[high], indexing="ij")
        keep = (i < j) if key[1].as_py() == key[2].as_py() else np.ones(i.shape, dtype=bool)
        return pa.table({"a": i[keep], "b": j[keep], "distance": np.maximum(d[keep], 0.0)}, schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("distance", pa.float64())]))

    part = sent.groupBy("slice", "low", "high").applyInArrow(run, "a int, b int, distance double")
    pairs = part.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    half = pairs.groupBy("a", "b").agg(F.sum("distance").alias("distance"))
    return half.select(F.explode(F.array(F.struct("a", "b", "distance"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))).alias("p")).select("p.*")


def krum_scores(updates: DataFrame, faulty: int) -> DataFrame:
    """client, score: the sum of the m - f - 2 nearest distances."""
    m = updates.select("client").distinct().count()
    f = min(faulty, max(0, (m - 3) // 2))
    keep = max(1, m - f - 2)
    near = client_distances(updates).withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b")))
    return near.where(F.col("_r") <= keep).groupBy(F.col("a").alias("client")).agg(F.sum("distance").alias("score"))


def krum(updates: DataFrame, faulty: int) -> DataFrame:
    """coord, value of the client with the least score, the lowest id on ties."""
    best = krum_scores(updates, faulty).orderBy("score", "client").limit(1).select(F.col("client").alias("_best"))
    return updates.join(F.broadcast(best), F.col("client") == F.col("_best")).select("coord", "value")


def aggregate(updates: DataFrame, how: str, trim: float = 0.2, faulty: int = 0) -> DataFrame:
    ways = {"avg": weighted_average, "median": coordinate_median, "trimmed_mean": lambda u: trimmed_mean(u, trim), "krum": lambda u: krum(u, faulty)}
    return ways[how](updates)


def communication_mb(features: int, classes: int, clients: int) -> float:
    """Float32 weights and biases to and from every client, in MiB."""
    return (features * classes + classes) * 4 / 2**20 * clients * 2


#: Numbers of partial gradients that a task holds before it passes them on, and of weights that are broadcast.
HELD = 4_000_000


def batched(df: DataFrame, client: str, key: str, rows: int | None, seed: int = 42, salt: str = "batch") -> DataFrame:
    """df plus `batch`: each client's rows in hash order, cut into runs of `rows` (one run without). No client is sorted in
    one task."""
    if not rows:
        return df.withColumn("batch", F.lit(0))
    hashed = df.withColumn("_h", hash_order(seed, salt, q(key)))
    numbered = distributed_row_number(hashed, [F.col("_h"), q(key)], [q(client), hash_bucket(F.col("_h"))], "_n", within=1)
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / rows).cast("int")).drop("_h", "_n")


def with_batches(df: DataFrame, client: str, key: str, rows: int | None, seeds: tuple[int, ...], salt: str = "batch") -> DataFrame:
    """df plus the array `batches`: for every seed the number that `batched` gives, without a shuffle of df. The last (hash,
    key) of each batch of a client is found first: a histogram of hash prefixes tells the prefixes that hold one, and only
    the keys under these are ranked. There are seeds x clients x batches of them; keys don't repeat."""
    if not rows:
        return df.withColumn("batches", F.array(*[F.lit(0)] * len(seeds)))
    hashes = [hash_order(seed, salt, q(key)) for seed in seeds]
    narrow = df.select(q(client).alias("_c"), q(key).alias("_k"), F.posexplode(F.array(*hashes)).alias("_s", "_h")).withColumn("_b", hash_bucket(F.col("_h")))
    own = Window.partitionBy("_c", "_s").orderBy("_b")
    sizes = narrow.groupBy("_c", "_s", "_b").agg(F.count(F.lit(1)).alias("_m")).withColumn("_start", F.sum("_m").over(own) - F.col("_m"))
    holding = sizes.where(F.floor((F.col("_start") + F.col("_m")) / rows) > F.floor(F.col("_start") / rows)).drop("_m")
    ranked = narrow.join(F.broadcast(holding), ["_c", "_s", "_b"]).withColumn("_n", F.col("_start") + F.row_number().over(Window.partitionBy("_c", "_s", "_b").orderBy("_h", "_k")))
    last = ranked.where(F.col("_n") % rows == 0).groupBy("_c").agg(*[F.collect_list(F.when(F.col("_s") == k, F.struct("_h", "_k"))).alias(f"_l{k}") for k in range(len(seeds))])

    def before(k: int) -> Column:
        at = F.struct(hashes[k].alias("_h"), q(key).alias("_k"))
        return F.when(F.col(f"_l{k}").isNull(), 0).otherwise(F.size(F.filter(f"_l{k}", lambda e: e < at)))

    numbers = [before(k) for k in range(len(seeds))]
    return df.join(F.broadcast(last), q(client) == F.col("_c"), "left").withColumn("batches", F.array(*numbers)).select(*df.columns, "batches")


def client_gradients(rows: DataFrame, shape: tuple[int, int], classes: int) -> DataFrame:
    """client, coord, gradient, n: summed over the rows (client, x, y, and w: the client's weights) of each client. A
    partial gradient per partition and client, so no client's rows meet in one task."""
    deep = shape[0]

    def run(batches):
        sums: dict[int, tuple[np.ndarray, int]] = {}

        def passed():
            size, clients = deep * classes, np.array(list(sums))
            out = [np.repeat(clients, size), np.tile(np.arange(size), len(sums)), np.concatenate([g.ravel() for g, _ in sums.values()]), np.repeat([n for _, n in sums.values()], size)]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["client", "coord", "gradient", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(start, AT_ONCE)
                client, y = piece.column(0).to_numpy(), piece.column(2).to_numpy()
                x, w = matrix(piece.column(1), deep - 1), matrix(piece.column(3), deep * classes)
                for c in np.unique(client):
                    own = np.flatnonzero(client == c)
                    xs = np.column_stack([x[own], np.ones(len(own))])
                    p = softmax_rows(xs @ w[own[0]].reshape(shape))
                    p[np.arange(len(own)), y[own]] -= 1
                    g, n = sums.get(int(c), (0.0, 0))
                    sums[int(c)] = g + xs.T @ p, n + len(own)
                    if len(sums) * deep * classes > HELD:
                        yield passed()
        if sums:
            yield passed()

    partial = rows.select("client", "x", "y", "w").mapInArrow(run, "client int, coord int, gradient double, n long")
    return partial.groupBy("client", "coord").agg(F.sum("gradient").alias("gradient"), F.sum("n").alias("n"))


def train_clients(df: DataFrame, weights: np.ndarray, classes: int, lr: float = 0.05, epochs: int = 1, mu: float = 0.0, batch_rows: int | None = None, seed: int = 42, client: str = "client_id", features: str = "features", label: str = "y", key: str = "key") -> DataFrame:
    """Updates of every client after `epochs` passes of mini-batch steps from `weights` (features + 1 rows, the last the
    bias), with the proximal term mu * (w - w0) (M3). Each epoch cuts each client's rows anew, in hash order, into batches
    of `batch_rows`. A step is one job over the rows of one batch number of all clients: their weights come from a state
    table with a row a client, partial gradients are summed by client and coordinate, and the new state is cut off from
    what it was made of. Clients without rows left in an epoch keep their weights; rows without a client are left out."""
    rows = df.where(q(client).isNotNull()).select(q(client).cast("int").alias("client"), q(features).alias("x"), q(label).cast("long").alias("y"), q(key).alias("key"))
    first = F.lit([float(v) for v in weights.ravel()])
    state = cut_off(rows.groupBy("client").agg(F.count(F.lit(1)).alias("n")).select("client", "n", first.alias("w")))
    few = state.count() * weights.size <= HELD  # then rows needn't be dealt out by client to meet the weights
    for epoch in range(epochs):
        # sorted by batch, so that a step skips the cached blocks of the others
        cut = batched(rows, "client", "key", batch_rows, seed, f"batch{epoch}").sortWithinPartitions("batch").persist()
        steps = cut.agg(F.max("batch")).head()[0]
        for b in range(0 if steps is None else steps + 1):
            own = state.select("client", "w")
            some = cut.where(F.col("batch") == b).join(F.broadcast(own) if few else own, "client")
            sums = client_gradients(some, weights.shape, classes).groupBy("client").agg(F.sort_array(F.collect_list(F.struct("coord", "gradient"))).getField("gradient").alias("g"), F.first("n").alias("m"))
            joined = state.join(sums, "client", "left")
            w0 = F.transform(F.arrays_zip("w", "g", first.alias("w0")), lambda v: v["w"] - lr * (v["g"] / F.col("m") + mu * (v["w"] - v["w0"])))
            before, state = state, cut_off(joined.select("client", "n", F.when(F.col("g").isNull(), F.col("w")).otherwise(w0).alias("w")))
            before.unpersist()
        cut.unpersist()
    return state.select("client", F.posexplode("w").alias("coord", "value"), "n")


@dataclass(frozen=True)
class Run:
    """A scenario of the matrix; every seed makes a model of its own of it."""

    name: str
    aggregator: str = "avg"
    attack: str = "none"
    mu: float = 0.0
    ratio: float = 0.0
    rounds: int = 30


#: The scenarios, clean ones over 50 rounds and 20 % of attackers over 30.
MATRIX = (
    Run("clean_fedavg", rounds=50), Run("clean_fedprox", mu=0.01, rounds=50),
    *(Run(f"{attack}_{how}", how, attack, 0.0, 0.2) for attack in ("label_flip", "update_scale") for how in ("avg", "median", "trimmed_mean", "krum")),
)
SEEDS = (42, 43, 44)
#: Weights of all clients of all runs that the driver holds.
MOST_WEIGHTS = 50_000_000


def merged(updates: np.ndarray, sizes: np.ndarray, how: str, trim: float = 0.2, faulty: int = 0) -> np.ndarray:
    """One model from clients x numbers, as the aggregators of the update table do it."""
    m = len(updates)
    if how == "avg":
        return (updates * (sizes / sizes.sum())[:, None]).sum(axis=0)
    if how == "median":
        return np.median(updates, axis=0)
    if how == "trimmed_mean":
        t = math.floor(trim * m)
        return np.sort(updates, axis=0)[t : m - t].mean(axis=0) if 0 < 2 * t < m else updates.mean(axis=0)
    if how != "krum":
        raise ValueError(how)
    d = ((updates[:, None] - updates[None, :]) ** 2).sum(axis=2)
    keep = max(1, m - min(faulty, max(0, (m - 3) // 2)) - 2)
    return updates[int(np.argmin(np.sort(d + np.where(np.eye(m) > 0, np.inf, 0.0), axis=1)[:, :keep].sum(axis=1)))]


def _stack_pass(rows: DataFrame, local: np.ndarray, whole: np.ndarray, step: int, seed_of: np.ndarray, flips: np.ndarray, test: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan for all models: (gradients models x clients x weights, rows seeds x clients of batch number `step`, and with
    `test` the evaluation sums of the test rows). rows: client (-1 for test rows), x, y, batches (one a seed), times (how
    many equal rows a row stands for)."""
    n_models, clients, deep, classes = local.shape
    seeds, cells = int(seed_of.max()) + 1, classes * classes + 3 * BINS + 1
    held = rows.sparkSession.sparkContext.broadcast((local, whole))

    def part(batches):
        local, whole = held.value
        g, n, e = np.zeros(local.shape), np.zeros((seeds, clients)), np.zeros((n_models, cells))
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(start, AT_ONCE)
                client, x, y = piece.column(0).to_numpy(), matrix(piece.column(1), deep - 1), piece.column(2).to_numpy()
                x, number, times = np.column_stack([x, np.ones(len(x))]), matrix(piece.column(3), seeds).astype(np.int64), piece.column(4).to_numpy().astype(float)
                for c in np.unique(client):
                    for s in range(seeds) if c >= 0 else ():
                        own = np.flatnonzero((client == c) & (number[:, s] == step))
                        if not len(own):
                            continue
                        n[s, c] += times[own].sum()
                        xs, of = x[own], np.flatnonzero(seed_of == s)
                        z = (xs @ local[of, c].transpose(1, 0, 2).reshape(deep, -1)).reshape(len(own), len(of), classes)
                        p = np.exp(z - z.max(axis=2, keepdims=True))
                        p /= p.sum(axis=2, keepdims=True)
                        said = np.where(flips[of, c][None, :], (y[own, None] + 1) % classes, y[own, None])
                        np.put_along_axis(p, said[:, :, None], np.take_along_axis(p, said[:, :, None], 2) - 1, 2)
                        p *= times[own, None, None]
                        g[of, c] += (xs.T @ p.reshape(len(own), -1)).reshape(deep, len(of), classes).transpose(1, 0, 2)
                if test and len(own := np.flatnonzero(client < 0)):
                    z = (x[own] @ whole.transpose(1, 0, 2).reshape(deep, -1)).reshape(len(own), n_models, classes)
                    p = np.exp(z - z.max(axis=2, keepdims=True))
                    p /= p.sum(axis=2, keepdims=True)
                    e += evaluation_sums(p, y[own], times[own])
        return np.concatenate([g.ravel(), n.ravel(), e.ravel()])

    flat = summed(rows, part, local.size + seeds * clients + n_models * cells)
    return flat[: local.size].reshape(local.shape), flat[local.size : local.size + seeds * clients].reshape(seeds, clients), flat[local.size + seeds * clients :].reshape(n_models, cells)


def federated_rounds(df: DataFrame, test: DataFrame, classes: int, width: int, clients: int, runs: tuple[Run, ...] = MATRIX, seeds: tuple[int, ...] = SEEDS, lr: float = 0.05, epochs: int = 1, batch_rows: int | None = None, scale: float = 5.0, trim: float = 0.2, spread: float = 0.01, benign: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[dict]]:
    """(last weights runs x seeds x (width + 1) x classes, a row a run, seed and round) of all runs and seeds together (M4,
    M5). A step is one scan for all of them: each row meets the weights of its client in every model, and the first step of
    a round also judges the weights of the round before on the test rows. So there are as many scans as steps of the
    longest run, and they go over the distinct rows with their numbers: rows of a client that are equal in features, label
    and batches are one, which weighs as much. Weights and gradients of the models (runs x seeds x clients of them, checked
    against MOST_WEIGHTS) travel by the driver; rows stay where they are. df: client_id (0 .. clients - 1), features, y, key;
    test: features, y. Each seed has its own first weights (normal, `spread`) and its own batches, which all runs and rounds
    share."""
    n_models, spark = len(runs) * len(seeds), df.sparkSession
    shape = (n_models, clients, width + 1, classes)
    if math.prod(shape) > MOST_WEIGHTS:
        raise ValueError(f"{math.prod(shape)} weights are more than MOST_WEIGHTS; train_clients takes any number of clients")
    rows = df.where(F.col("client_id").between(0, clients - 1)).select(F.col("client_id").cast("int").alias("client"), F.col("features").alias("x"), F.col("y").cast("long").alias("y"), "key")
    rows = with_batches(rows, "client", "key", batch_rows, seeds).drop("key")
    both = rows.unionByName(test.select(F.lit(-1).alias("client"), F.col("features").alias("x"), F.col("y").cast("long").alias("y"), F.array(*[F.lit(-1)] * len(seeds)).alias("batches")))
    both = stored(both.groupBy("client", "x", "y", "batches").agg(F.count(F.lit(1)).alias("times")))
    steps = max(1, (both.agg(F.max(F.array_max("batches"))).head()[0] or 0) + 1)
    seed_of = np.tile(np.arange(len(seeds)), len(runs))
    runs_of = [r for r in runs for _ in seeds]
    bad = [math.floor(clients * r.ratio) if r.attack != "none" else 0 for r in runs_of]
    flips = np.array([[r.attack == "label_flip" and c < b for c in range(clients)] for r, b in zip(runs_of, bad, strict=True)])
    mu = np.array([r.mu for r in runs_of])[:, None, None, None]
    whole = np.stack([np.vstack([np.random.default_rng(seeds[s]).normal(0.0, spread, (width, classes)), np.zeros((1, classes))]) for s in seed_of])
    rounds, out, seconds = max(r.rounds for r in runs), [], 0.0

    def judged(cells: np.ndarray, after: int) -> None:
        for m, r in enumerate(runs_of):
            if 0 < after <= r.rounds:
                out.append({"scenario": r.name, "aggregator": r.aggregator, "attack": r.attack, "mu": r.mu, "seed": int(seeds[seed_of[m]]), "round": after, **scores_of(cells[m], classes, benign), "comm_mb_round": communication_mb(width, classes, clients), "round_seconds": seconds})

    for t in range(rounds):
        began = time.monotonic()
        local, sizes = np.repeat(whole[:, None], clients, axis=1), np.zeros((len(seeds), clients))
        for k in range(epochs * steps):
            g, n, cells = _stack_pass(both, local, whole, k % steps, seed_of, flips, k == 0 and t > 0)
            if k == 0:
                judged(cells, t)
            if k < steps:
                sizes += n
            have = n[seed_of][:, :, None, None]
            local = np.where(have > 0, local - lr * (g / np.maximum(have, 1) + mu * (local - whole[:, None])), local)
        for m, r in enumerate(runs_of):
            if t < r.rounds:
                held = np.flatnonzero(sizes[seed_of[m]])
                base, sent = whole[m].ravel(), local[m].reshape(clients, -1).copy()
                if r.attack == "update_scale":
                    sent[: bad[m]] = base + scale * (sent[: bad[m]] - base)
                if len(held):
                    whole[m] = merged(sent[held], sizes[seed_of[m]][held], r.aggregator, trim, bad[m]).reshape(whole[m].shape)
        seconds = time.monotonic() - began
    judged(_stack_pass(both, np.repeat(whole[:, None], clients, axis=1), whole, -2, seed_of, flips, True)[2], rounds)
    both.unpersist()
    return whole.reshape(len(runs), len(seeds), width + 1, classes), out


ROUNDS = "scenario string, aggregator string, attack string, mu double, seed int, round int, accuracy double, macro_f1 double, normal_fpr double, ece double, brier double, mean_confidence double, comm_mb_round double, round_seconds double"


def scenario_matrix(df: DataFrame, test: DataFrame, classes: int, width: int, clients: int, **options) -> DataFrame:
    """A row a scenario, seed and round with all figures of the test rows (M5); options as federated_rounds."""
    _, rows = federated_rounds(df, test, classes, width, clients, **options)
    names = [f.split()[0] for f in ROUNDS.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in sorted(rows, key=lambda r: (r["scenario"], r["seed"], r["round"]))], ROUNDS)
