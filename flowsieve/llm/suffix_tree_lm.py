"""Language-model scores from a probabilistic suffix tree over words.

Counts of every word are gathered over all training documents. Words that occur `LEAST_SYMBOL` times are symbols of
their own; the others share a symbol with words of the same ending or first non-ASCII letter, within which a word has
its smoothed relative frequency. The tree's contexts are up to `DEPTH` symbols long. A context becomes a state if it
occurs `LEAST_CONTEXT` times and its next-symbol distribution diverges from that of its longest suffix state: count
times Kullback-Leibler divergence exceeds half the number of next symbols times the logarithm of the count. State
distributions are smoothed towards the suffix state by the Witten-Bell rule, so every distribution sums to one. A token
is scored by the longest suffix of its history that is a state.

The least counts are absolute: the tree grows with the corpus and is never in one place. For each depth a part sends
every shard the next symbols it saw behind the shard's contexts, with their counts and their probabilities by the suffix
state, and gets back the totals over all parts, which contexts are states, and numbers for the pairs that are contexts of
the next depth: numbers without gaps, by which their keys are short to send. A frequent context is dealt to several
shards by its next symbols; its sums (count, next symbols, divergence) meet on the driver, a few numbers a shard. Answers are
stored in the buckets of the parts, so that every depth meets those of all depths before it without shuffling them again.
Words and contexts are told apart by 64-bit hashes.

Defined results: null and empty texts are the end token alone; a row without doc_id is never held out (there is no
number to take); without training documents all probabilities come from the smoothing; repeated rows count and are
scored row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added_in_buckets, table_name
from .parts import by_shard, expand, in_shards, make_parts, map_rows, part_buckets, shard_count, squeeze, with_answers
from .tokens import LOWER, joined, words

DEPTH, LEAST_SYMBOL, LEAST_CONTEXT = 3, 2, 4
CLASSES = 64
#: A context is dealt to one shard for each share of a shard's tokens over this that it makes up.
SPREAD = 4
END = np.uint64(0x656E64)

PART = T.StructType([T.StructField(n, t) for n, t in (("ids", T.ArrayType(T.LongType())), ("held", T.BinaryType()), ("lengths", T.BinaryType()), ("tokens", T.BinaryType()), ("hashes", T.BinaryType()), ("classes", T.BinaryType()), ("counts", T.BinaryType()))])
MESSAGE = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("classes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
ANSWER = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in "abc"]])
ASKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("keys", "kinds", "spread", "entries", "counts", "parents")]])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of unsigned integers, which for sorted hashes are short; climb() undoes them."""
    return np.diff(x, prepend=x.dtype.type(0))


def climb(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; a place of each; the number of each entry's value)."""
    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(y), dtype=bool)
    np.not_equal(y[1:], y[:-1], out=new[1:])
    number = np.empty(len(x), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return y[new], order[new], number


def names(shard: int, numbers: np.ndarray, shards: int) -> np.ndarray:
    """Keys, not 0, of the contexts that a shard has numbered: dealt evenly over the ranges of all shards, and in each of them as
    close together as the numbers of the shards where they come from."""
    whole = numbers // np.uint32(shards) * np.uint32(shards)
    at = numbers - whole + np.uint32(shard)
    at[at >= shards] -= np.uint32(shards)
    return at * np.uint64((1 << 64) // shards) + (whole + np.uint64(shard + 1))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokenise(ids: list, texts: list[bytes]) -> tuple:
    """A part: for each document its tokens as indices into the part's sorted distinct hashes."""
    raw, begin = joined([t.translate(LOWER) for t in texts])
    starts, ends, hashes = words(raw)
    data = np.frombuffer(raw, dtype=np.uint8)
    at = np.searchsorted(starts, begin)
    lengths = np.diff(at) + 1
    stream = np.insert(hashes, at[1:], END)
    distinct, first, index = grouped(stream)
    classes = np.zeros(len(stream), dtype=np.uint8)
    if len(starts):
        high = data >= 128
        nth = np.concatenate([[0], np.cumsum(high)])
        where = np.append(np.flatnonzero(high), 0)
        letter = where[np.minimum(nth[starts], len(where) - 1)]  # the first non-ASCII byte at or after the word's start
        foreign = nth[ends] > nth[starts]
        point = (data[letter].astype(np.int64) << 6) + (data[np.minimum(letter + 1, len(data) - 1)] & 63)
        of_word = np.where(foreign, 32 + point % 32, data[ends - 1] % 32).astype(np.uint8)
        classes = np.insert(of_word, at[1:], 0)
    held = np.array([is_held_out(i) for i in ids], dtype=bool)
    trained = np.bincount(index[np.repeat(~held, lengths)], minlength=len(distinct))
    return ids, squeeze(held), squeeze(lengths.astype(np.int32)), squeeze(index.astype(np.uint32)), squeeze(steps(distinct)), squeeze(classes[first]), squeeze(trained.astype(np.uint32))


def _ask(shards: int):
    def run(row):
        hashes, classes, counts = climb(expand(row["hashes"], np.uint64)), expand(row["classes"], np.uint8), expand(row["counts"], np.uint32)
        for s, a, b in by_shard(hashes, shards):
            yield row["part"], s, squeeze(steps(hashes[a:b])), squeeze(classes[a:b]), squeeze(counts[a:b])

    return run


def _total(frame):
    """A shard: totals of its words, sent back to each part in the order it asked, and what the model needs of them."""
    asked = [climb(expand(x, np.uint64)) for x in frame["hashes"]]
    flat, counts = np.concatenate(asked), np.concatenate([expand(x, np.uint32) for x in frame["counts"]]).astype(np.int64)
    classes = np.concatenate([expand(x, np.uint8) for x in frame["classes"]])
    distinct, first, index = grouped(flat)
    total = np.bincount(index, counts, len(distinct)).astype(np.int64)
    at = 0
    for part, x in zip(frame["part"], asked, strict=True):
        yield "counts", int(part), int(frame["shard"].iloc[0]), squeeze(total[index[at : at + len(x)]]), None, None
        at += len(x)
    own = total >= LEAST_SYMBOL
    rare = (total > 0) & ~own
    found = np.zeros((3, CLASSES), dtype=np.int64)
    found[0] = np.bincount(classes[first][rare], total[rare], CLASSES).astype(np.int64)
    found[1] = np.bincount(classes[first][rare], minlength=CLASSES)
    found[2, 0], found[2, 1] = total[own].sum(), own.sum()
    yield "classes", -1 - int(frame["shard"].iloc[0]), int(frame["shard"].iloc[0]), squeeze(found), None, None


@dataclass
class Vocabulary:
    tokens: int
    types: int
    symbols: int  # words that are symbols
    class_tokens: np.ndarray  # of the words that aren't
    class_types: np.ndarray
    spread: int  # tokens behind a context for each shard that it is dealt to

    def mass(self) -> float:
        return self.tokens + 0.5 * (self.symbols + CLASSES)


def _vocabulary(answers: DataFrame, shards: int) -> Vocabulary:
    found = np.zeros((3, CLASSES), dtype=np.int64)
    for r in answers.where("kind = 'classes'").select("a").collect():  # per shard 3 * CLASSES numbers
        found += expand(bytes(r["a"]), np.int64).reshape(3, CLASSES)
    tokens, symbols = int(found[0].sum() + found[2, 0]), int(found[2, 1])
    return Vocabulary(tokens, int(found[1].sum()) + symbols, symbols, found[0], found[1], max(256, tokens // (SPREAD * shards)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """A part's tokens on their way down the tree. At each depth `n` is how often a token's context occurs in training
    documents, `key` names the context, and `p` is the token's probability by the longest suffix that is a state."""

    def __init__(self, row, total: np.ndarray, v: Vocabulary):
        self.v, lengths, index = v, expand(row["lengths"], np.int32), expand(row["tokens"], np.uint32)
        hashes, classes, held = climb(expand(row["hashes"], np.uint64)), expand(row["classes"], np.uint8), expand(row["held"], bool)
        self.lengths, self.begin, self.held = lengths, np.cumsum(lengths) - lengths, held
        self.trained = np.repeat(~held, lengths)
        self.position = np.arange(len(index)) - np.repeat(self.begin, lengths)
        own = total >= LEAST_SYMBOL
        count = np.where(own, total, v.class_tokens[classes])
        self.base = np.log10((total + 0.5) / (v.tokens + 0.5 * (v.types + 1)))[index]
        self.rare = np.where(own, 0.0, np.log10((total + 0.5) / (v.class_tokens[classes] + 0.5 * (v.class_types[classes] + 1))))[index]
        self.known = (total > 0).astype(np.int64)[index]
        self.symbol = _mix(np.where(own, hashes, classes.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))[index]
        self.p = ((count + 0.5) / v.mass())[index]
        self.depth, self.entry, self.c = 0, self.symbol, count[index]

    def ask(self):
        """Down to the next depth: the keys that deal out the contexts that may be states, and behind one another the
        distinct next symbols of each."""
        self.depth += 1
        n = np.concatenate([[0], self.c[:-1]])
        n[self.position < self.depth] = 0
        self.at = np.flatnonzero(n >= LEAST_CONTEXT)
        self.n, self.context = n[self.at], self.entry[self.at - 1]
        pair = _mix(self.context * np.uint64(0x9E3779B97F4A7C15) + self.symbol[self.at])
        spread = (self.n // self.v.spread + 1).astype(np.uint64)
        key = self.context
        if (several := np.flatnonzero(spread > 1)).size:
            key = key.copy()
            key[several] = _mix(key[several] + pair[several] % spread[several])
        self.keys, _, number = grouped(key)
        self.entries, self.first, self.place = grouped(number.astype(np.uint64) << np.uint64(32) | pair >> np.uint64(32))
        run = self.entries >> np.uint64(32)
        self.runs = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        self.kinds = np.diff(np.append(self.runs, len(run)))
        of = self.first[self.runs]
        self.spread_of = np.where(spread[of] > 1, self.context[of], np.uint64(0))

    def asked(self):
        """(keys, entries, counts, logarithms of the probabilities by the suffix states) to send."""
        counts = np.bincount(self.place, self.trained[self.at], len(self.entries)).astype(np.uint32)
        parents = np.where(counts > 0, np.log(self.p[self.at[self.first]]), 0).astype(np.float16)
        return self.keys, self.entries.astype(np.uint32), counts, parents

    def answer(self, totals: np.ndarray, mass: np.ndarray, named: np.ndarray, spread: tuple[np.ndarray, np.ndarray]) -> None:
        """Totals of the pairs asked for, the smoothing mass of their contexts (0: not a state), names of the pairs that
        are contexts of the next depth, and the smoothing mass of all contexts that were spread."""
        self.c, self.entry = np.zeros(len(self.p), dtype=np.int64), np.zeros(len(self.p), dtype=np.uint64)
        if not len(self.at):
            return
        keys, of_spread = spread
        if len(keys):
            where = np.minimum(np.searchsorted(keys, self.spread_of), len(keys) - 1)
            mass = np.where(self.spread_of == 0, mass, np.where(keys[where] == self.spread_of, of_spread[where], 0))
        m, c = np.repeat(mass, self.kinds)[self.place], totals[self.place]
        self.c[self.at] = c
        if len(named):
            name = np.zeros(len(totals), dtype=np.uint64)
            name[totals >= LEAST_CONTEXT] = named
            self.entry[self.at] = name[self.place]
        self.p[self.at] = np.where(m > 0, (c + m * self.p[self.at]) / (self.n + m), self.p[self.at])


def _walk(row, answers, model, shards: int) -> Walk:
    """A part's tokens after the depths that are answered."""
    v, spreads = model
    by = {k: x.sort_values("shard") for k, x in answers.groupby("kind")}
    gather = lambda kind, name: np.concatenate([np.zeros(0, np.int64), *[expand(x, np.int64) for x in (by[kind][name] if kind in by else ())]])
    walk = Walk(row, gather("counts", "a"), v)
    for d, spread in enumerate(spreads, 1):
        walk.ask()
        found = by.get(f"depth{d}")
        named = [] if found is None else [names(int(s), climb(expand(x, np.uint32)), shards) for s, x in zip(found["shard"], found["c"], strict=True) if x is not None]
        walk.answer(gather(f"depth{d}", "a"), gather(f"depth{d}", "b"), np.concatenate([np.zeros(0, np.uint64), *named]), spread)
    return walk


def _ask_depth(model, shards: int):
    def run(row, answers):
        walk = _walk(row, answers, model.value, shards)
        walk.ask()
        keys, entries, counts, parents = walk.asked()
        runs = np.append(walk.runs, len(entries))
        for s, a, b in by_shard(keys, shards):
            x, y = runs[a], runs[b]
            yield int(row["part"]), s, squeeze(steps(keys[a:b])), squeeze(walk.kinds[a:b].astype(np.uint32)), squeeze(walk.spread_of[a:b]), squeeze(steps(entries[x:y])), squeeze(counts[x:y]), squeeze(parents[x:y])

    return run


def _states(depth: int, last: bool):
    """A shard: totals of its pairs, the smoothing mass of its contexts and the numbers of the next ones to each part; sums
    of the spread ones. Below the last depth only totals behind states are asked for."""

    def run(frame):
        asked = [climb(expand(x, np.uint32)) for x in frame["entries"]]
        keys, kinds = [climb(expand(x, np.uint64)) for x in frame["keys"]], [expand(x, np.uint32) for x in frame["kinds"]]
        key, k = np.concatenate(keys), np.concatenate(kinds)
        spread = np.concatenate([expand(x, np.uint64) for x in frame["spread"]])
        contexts, first, of_run = grouped(key)
        spread = spread[first]
        pairs = np.repeat(of_run, k).astype(np.uint64) << np.uint64(32) | np.concatenate(asked)
        pairs, _, index = grouped(pairs)
        context = (pairs >> np.uint64(32)).astype(np.int64)
        c = np.bincount(index, np.concatenate([expand(x, np.uint32) for x in frame["counts"]]), len(pairs))
        parent = np.zeros(len(pairs))  # each part that counted the pair sends the same, the others 0
        np.minimum.at(parent, index, np.concatenate([expand(x, np.float16) for x in frame["parents"]]).astype(np.float64))
        seen = c > 0
        n = np.bincount(context, c, len(contexts))
        followers = np.bincount(context[seen], minlength=len(contexts))
        gain = np.bincount(context[seen], c[seen] * (np.log(c[seen]) - parent[seen]), len(contexts))
        mass = np.where(spread == 0, smoothing_mass(n, followers, gain), 0)
        c, at, run = c.astype(np.int64), 0, 0
        if last:
            c[(mass[context] == 0) & (spread[context] == 0)] = 0
        often = c >= LEAST_CONTEXT
        number = (np.cumsum(often) - 1).astype(np.uint32)
        for part, x, y in zip(frame["part"], asked, keys, strict=True):
            own = index[at : at + len(x)]
            yield f"depth{depth}", int(part), int(frame["shard"].iloc[0]), squeeze(c[own]), squeeze(mass[of_run[run : run + len(y)]]), None if last else squeeze(steps(number[own[often[own]]]))
            at, run = at + len(x), run + len(y)
        if (parts := spread > 0).any():
            yield f"spread{depth}", -1 - int(frame["shard"].iloc[0]), int(frame["shard"].iloc[0]), squeeze(spread[parts]), squeeze(np.stack([n[parts], followers[parts], gain[parts]])), None

    return run


def smoothing_mass(n: np.ndarray, followers: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The number of next symbols of each context that passes the divergence test, else 0. gain: the sum of count times
    log(count / probability by the suffix state)."""
    gain = gain - n * np.log(np.maximum(n, 1))
    return np.where((n >= LEAST_CONTEXT) & (gain > 0.5 * followers * np.log(np.maximum(n, 2))), followers, 0).astype(np.int64)


def _spread(answers: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts that were dealt to several shards, their smoothing mass); at most 2 * SPREAD rows a shard."""
    rows = answers.where(f"kind = 'spread{depth}'").select("a", "b").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *[expand(bytes(r["a"]), np.uint64) for r in rows]])
    sums = np.concatenate([np.zeros((3, 0)), *[expand(bytes(r["b"]), np.float64).reshape(3, -1) for r in rows]], axis=1)
    keys, index = np.unique(keys, return_inverse=True)
    return keys, smoothing_mass(*[np.bincount(index, x, len(keys)) for x in sums])


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score of every row of docs."""
    spark = docs.sparkSession
    parts = make_parts(docs, tokenise, PART, "tokens", bucketed=True)
    shards, buckets = shard_count(parts), part_buckets(docs)
    table = table_name("answers")
    kept = lambda found: added_in_buckets(found.repartition(buckets, "part"), "part", buckets, table)
    answers = kept(in_shards(map_rows(parts.select("part", "hashes", "classes", "counts"), _ask(shards), MESSAGE), "shard", _total, ANSWER))
    v, spreads = _vocabulary(answers, shards), []
    parts = parts.drop("counts")
    for d in range(1, depth + 1):
        model = spark.sparkContext.broadcast((v, list(spreads)))
        messages = with_answers(parts.drop("ids"), answers.where("part >= 0"), _ask_depth(model, shards), ASKED)
        answers = kept(in_shards(messages, "shard", _states(d, d == depth), ANSWER))
        spreads.append(_spread(answers, d))
    model = spark.sparkContext.broadcast((v, spreads))

    def run(row, answers):
        walk = _walk(row, answers, model.value, shards)
        sums = [np.add.reduceat(x, walk.begin) for x in (walk.known, walk.base, np.log10(walk.p) + walk.rare)]
        for i, x in enumerate(row["ids"]):
            yield None if x is None or x != x else int(x), bool(walk.held[i]), int(walk.lengths[i]), int(sums[0][i]), float(sums[1][i]), float(sums[2][i])

    scored = with_answers(parts, answers.where("part >= 0"), run, SCORED)
    return scored.withColumn("train_tokens", F.lit(v.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
