"""Toxicity by a classifier chain.

The labelled categories are predicted one after the other by linear models over words and word beginnings. A later
model also sees the log-odds of the earlier categories; in training these come from models that did not see the row
(out-of-fold), in use from the models fitted on all rows.

Fitting takes a bounded sample of labelled rows (`sample_rows`, the least by hash of doc_id) and the `features` most
telling features of each category, picked anew without each held-out fold; scoring takes all rows.

Defined results: texts without any known feature, null and empty ones too, get the base rates and are not rejected; without labelled rows, or with
labels of one kind only, no document is rejected; labels repeated for a doc_id count once, a category as soon as one
row has it; of documents that share an id the one with the least text is fitted on; repeated documents get equal scores; clashing columns are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, col, filtered, stored
from .decontaminate import words_of

CATEGORIES = ("low_quality", "toxic")
SAMPLE_ROWS = 20_000
FEATURES = 2_000
FOLDS = 3
PREFIXES = (4, 5, 6)
LEAST_ROWS = 4
#: Rows whose features a fit expands at once.
BLOCK = 1024


@dataclass
class Chain:
    """vocabulary: feature to index; one weight row per category: features, then earlier categories, then the bias."""

    categories: tuple[str, ...]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    base: list[float] = field(default_factory=list)
    threshold: float = 2.0
    key: str = ""


def features_of(text: str | None) -> set[bytes]:
    found: set[bytes] = set()
    for w in set(words_of(text.lower())) if text else ():
        found.add(w)
        found.update(b"^" + w[:n] for n in PREFIXES if len(w) > n)
    return found


def _blocks(starts: np.ndarray, index: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """BLOCK rows at a time: which, the row of each of their features within the block, the features."""
    for a in range(0, len(starts) - 1, BLOCK):
        at = starts[a : a + BLOCK + 1]
        yield slice(a, a + len(at) - 1), np.repeat(np.arange(len(at) - 1), np.diff(at)), index[at[0] : at[-1]].astype(np.intp)


def fit_linear(starts: np.ndarray, index: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, steps: int = 160, rate: float = 0.15, l2: float = 2e-5) -> np.ndarray:
    """Logistic regression over sparse 0/1 rows and dense extra columns, by full-batch Adam from zero."""
    n, m = len(y), extra.shape[1]
    w = np.zeros(width + m + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        grad = np.zeros_like(w)
        for at, rows, features in _blocks(starts, index):
            z = np.bincount(rows, w[features], at.stop - at.start) + extra[at] @ w[width:-1] + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / n
            grad += np.concatenate([np.bincount(features, g[rows], width), extra[at].T @ g, [g.sum()]])
        grad[:-1] += l2 * w[:-1]
        first += 0.1 * (grad - first)
        second += 0.02 * (grad * grad - second)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.98**t)) + 1e-9)
    return w


def logits(starts: np.ndarray, index: np.ndarray, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = [np.bincount(rows, w[features], at.stop - at.start) + extra[at] @ w[-1 - extra.shape[1] : -1] + w[-1] for at, rows, features in _blocks(starts, index)]
    return np.clip(np.concatenate([np.zeros(0), *z]), -12, 12)


def _take(starts: np.ndarray, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are marked."""
    lengths = np.diff(starts)
    return np.concatenate([[0], np.cumsum(lengths[rows])]), index[np.repeat(rows, lengths)]


def pick_features(starts: np.ndarray, index: np.ndarray, labels: np.ndarray, width: int, features: int) -> np.ndarray:
    """Which of `width` candidates speak most for or against a category in these rows: the `features` of the greatest
    signed root of the 2 x 2 chi-square, of each category."""
    n, counts = len(labels), np.zeros((1 + labels.shape[1], width))
    for at, rows, found in _blocks(starts, index):
        counts += [np.bincount(found, minlength=width), *[np.bincount(found, y[rows], width) for y in labels[at].T]]
    df, picked = counts[0], np.zeros(width, dtype=bool)
    for y, hits in zip(labels.T.astype(float), counts[1:], strict=True):
        expected = df * y.mean()
        score = np.abs(hits - expected) / np.sqrt(expected * (1 - y.sum() / n) + 0.5)
        score[df < LEAST_ROWS] = -1
        best = np.argsort(-score, kind="stable")[:features]
        picked[best[score[best] >= 0]] = True
    return picked


def _only(starts: np.ndarray, index: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the picked features alone, numbered anew."""
    number, lengths, kept = (np.cumsum(picked) - 1).astype(np.uint32), [np.zeros(1, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    for at, rows, features in _blocks(starts, index):
        keep = picked[features]
        lengths.append(np.bincount(rows[keep], minlength=at.stop - at.start))
        kept.append(number[features[keep]])
    return np.cumsum(np.concatenate(lengths)), np.concatenate(kept)


def fit_part(starts: np.ndarray, index: np.ndarray, labels: np.ndarray, held_out: np.ndarray, held: np.ndarray, width: int, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model of the category that follows those of `held` (log-odds by category), fitted on the rows that aren't
    held out, with features picked on these alone: picked of the `width` candidates, weights, log-odds of the others.
    Beside the rows' features, which may be of 4 bytes, only blocks of rows are held."""
    fit, k = ~held_out, held.shape[1]
    if not fit.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(len(labels))
    rows = _take(starts, index, fit)
    picked = pick_features(*rows, labels[fit], width, features)
    rows = _only(*rows, picked)
    w = fit_linear(*rows, held[fit], labels[fit, k].astype(float), int(picked.sum()))
    del rows
    return np.flatnonzero(picked), w, logits(*_only(*_take(starts, index, held_out), picked), held[held_out], w)


#: What a task gives the driver: of a fold the places of its rows, their labels and log-odds, of all rows the model.
_FITTED = "part int, picked binary, weights binary, at binary, y binary, odds binary"


def _fitter(names: list[str], held: np.ndarray, width: int, features: int) -> Callable:
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        starts = np.concatenate([[0], np.cumsum([len(i) // 4 for i in frame["i"]])]).astype(np.int64)
        index = np.frombuffer(b"".join(frame["i"]), dtype="<u4")
        labels, out, none = frame[names].to_numpy(), frame["fold"].to_numpy() == key[0], np.zeros(0)
        picked, w, odds = fit_part(starts, index, labels, out, held, width, features) if key[0] < 0 or out.any() else (none, none, none)
        sent = [*((picked, w) if key[0] < 0 else (none, none)), np.flatnonzero(out), labels[out, -1], odds]
        return pd.DataFrame([[key[0], *[x.astype(t).tobytes() for x, t in zip(sent, ("<u4", "<f8", "<u4", "<u1", "<f8"), strict=True)]]], columns=["part", "picked", "weights", "at", "y", "odds"])

    return run


def fit_rows(rows: DataFrame, n: int, chain: Chain, candidates: list[bytes], features: int, folds: int) -> np.ndarray:
    """Fits chain.weights and the threshold of the last category on `n` rows with `i`, their candidate features, and
    returns the out-of-fold log-odds, by doc_id. Each model is fitted in a task of its own: without one of the folds, or (-1) on
    all rows. Features are picked without the fold that is held out, as the weights are."""
    names, width, held = [f"y_{c}" for c in chain.categories], len(candidates), np.zeros((n, 0))
    # more partitions than parts, so that no two parts share a range
    dealt = rows.withColumn("part", F.explode(F.array(*[F.lit(f) for f in range(-1, folds)]))).repartitionByRange(4 * (folds + 1), "part")
    for _ in chain.categories:
        out, y = np.zeros(n), np.zeros(n, dtype=bool)
        for r in dealt.groupBy("part").applyInPandas(_fitter(names, held, width, features), _FITTED).collect():
            at = np.frombuffer(r["at"], dtype="<u4")
            out[at], y[at] = np.frombuffer(r["odds"], dtype="<f8"), np.frombuffer(r["y"], dtype="<u1") > 0
            if r["part"] < 0:
                chain.vocabulary = {candidates[i]: k for k, i in enumerate(np.frombuffer(r["picked"], dtype="<u4").tolist())}
                chain.weights.append(np.frombuffer(r["weights"], dtype="<f8"))
        held = np.column_stack([held, out])
    p = held[:, -1]
    if y.any() and not y.all():
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * y.sum())  # F 0.5: a clean document lost weighs more
        best = int(np.argmax(f1))
        below = p[order[best + 1]] if best + 1 < len(p) else p[order[best]] - 1
        chain.threshold = float(1 / (1 + np.exp(-(p[order[best]] + below) / 2)))
    return held


def fit_chain(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """docs: doc_id, text; labels: doc_id and a 0/1 column per category. Only a sample of at most `sample_rows` rows is
    fitted on, in tasks; the driver gets the candidate features, the models, and a number a row and category."""
    chain = Chain(CATEGORIES, key=uuid.uuid4().hex)
    marked = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(col(c).cast("int"), F.lit(0))).alias(f"y_{c}") for c in CATEGORIES])
    order = F.xxhash64("doc_id")
    chosen = marked.orderBy(order, "doc_id").limit(sample_rows)
    rows = docs.where("doc_id IS NOT NULL")
    # rows that share an id count once, by their least text, so that the sample has `sample_rows` rows at most
    labelled = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = stored(labelled.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(f"y_{c}").alias(f"y_{c}") for c in CATEGORIES]).repartition(24, "doc_id"), "toxicity-sample")
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{c}").alias(c) for c in CATEGORIES]).head()
    if not total["n"] or not 0 < (total[CATEGORIES[-1]] or 0) < total["n"]:
        return chain
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(folds)).cast("int")
    named = add_columns(sample.withColumn("fold", fold), ["text"], [T.StructField("f", T.ArrayType(T.BinaryType()))], lambda texts: [[list(features_of(t)) for t in texts]])
    # candidates: features that the picking of any fold can prefer, by their counts in the rows of all other folds
    counts = [F.count(F.when(F.col("fold") != f, 1)).alias(f"d{f}") for f in range(folds)]
    counts += [F.coalesce(F.sum(F.when(F.col("fold") != f, F.col(f"y_{c}"))), F.lit(0)).alias(f"d{f}_{c}") for f in range(folds) for c in CATEGORIES]
    seen = named.select("fold", F.explode("f").alias("f"), *[f"y_{c}" for c in CATEGORIES]).groupBy("f").agg(F.count(F.lit(1)).alias("df"), *[F.sum(f"y_{c}").alias(c) for c in CATEGORIES], *counts).where(F.col("df") >= LEAST_ROWS)
    sizes = sample.withColumn("fold", fold).agg(*[F.count(F.when(F.col("fold") != f, 1)).alias(f"d{f}") for f in range(folds)], *[F.coalesce(F.sum(F.when(F.col("fold") != f, F.col(f"y_{c}"))), F.lit(0)).alias(f"d{f}_{c}") for f in range(folds) for c in CATEGORIES]).head()
    seen = seen.persist()
    picked: set[bytes] = set()
    for c in CATEGORIES:
        for df, hits, n, y in [("df", c, total["n"], total[c] or 0), *[(f"d{f}", f"d{f}_{c}", sizes[f"d{f}"], sizes[f"d{f}_{c}"]) for f in range(folds)]]:
            expected, rest = F.col(df) * F.lit(y / max(n, 1)), F.lit(1 - y / max(n, 1))
            score = F.abs(F.col(hits) - expected) / F.sqrt(expected * rest + 0.5)
            picked |= {bytes(r["f"]) for r in seen.where(F.col(df) >= LEAST_ROWS).select("f", score.alias("s")).orderBy(F.desc("s"), "f").limit(features).collect()}
    seen.unpersist()
    candidates = sorted(picked)
    numbers = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(candidates)})
    indexed = add_columns(sample.select("doc_id", "text", *[f"y_{c}" for c in CATEGORIES]), ["text"], [T.StructField("i", T.BinaryType())], lambda texts: [[np.array(sorted(numbers.value[f] for f in features_of(t) if f in numbers.value), dtype="<u4").tobytes() for t in texts]])
    chain.base = [(total[c] or 0) / total["n"] for c in CATEGORIES]
    fit_rows(stored(indexed.select("doc_id", "i", fold.alias("fold"), *[f"y_{c}" for c in CATEGORIES]), "toxicity-rows"), total["n"], chain, candidates, features, folds)
    return chain


_WORDS: dict[str, dict[bytes, tuple[int, ...]]] = {}


def _indices(text: str | None, chain: Chain) -> list[int]:
    """As features_of, by a per-worker memory of each word's features (mostly none)."""
    if chain.key not in _WORDS:
        _WORDS.clear()
        _WORDS[chain.key] = {}
    memo, vocabulary, found = _WORDS[chain.key], chain.vocabulary, set()
    if len(memo) > 100_000:
        memo.clear()
    for w in set(words_of(text.lower())) if text else ():
        if (x := memo.get(w)) is None:
            x = memo[w] = tuple(i for f in (w, *(b"^" + w[:n] for n in PREFIXES if len(w) > n)) if (i := vocabulary.get(f)) is not None)
        if x:
            found.update(x)
    return list(found)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs plus p_<category> of each category and is_<last category>."""
    fields = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"is_{chain.categories[-1]}", T.BooleanType())]
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts):
        c = held.value
        if not c.weights:
            return [[0.0] * len(texts) for _ in c.categories] + [[False] * len(texts)]
        lists = [sorted(_indices(t, c)) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        index = np.array([i for x in lists for i in x], dtype=np.int64)
        z = np.zeros((len(texts), 0))
        for w in c.weights:
            z = np.column_stack([z, logits(starts, index, z, w)])
        p = 1 / (1 + np.exp(-z))
        p[np.diff(starts) == 0] = c.base  # nothing to go by
        toxic = (p[:, -1] >= c.threshold) & (np.diff(starts) > 0)
        return [p[:, k].tolist() for k in range(p.shape[1])] + [toxic.tolist()]

    return add_columns(docs, [text], fields, run)


def category_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that the chain doesn't reject, with their own columns."""
    return filtered(docs, {"text": "text"}, lambda rows: score(rows, chain).where(f"NOT is_{chain.categories[-1]}"))
