"""Word-level deduplication by matching statistics over a compressed FM-index per shard.

A shard holds the distinct contents that may repeat, as one sequence of word numbers with an end mark behind each. Its
Burrows-Wheeler transform (suffixes sorted to the length of the longest content) is kept in a wavelet matrix of packed
bits with sampled ranks. The streamed contents are searched backwards from every word at once, one word and one rank
pair a step, for as long as the suffix interval holds an occurrence that starts earlier in the order of (doc_id, word).
The first steps are taken together: sorting the suffixes ranks them by a power of two of words on its way, and the run of
an equal rank is the suffix interval of as many words. The steps taken are the matching statistics; those of at least a
window are reported as intervals, which are removed.

Statistics are cut at `DEPTH` words. That loses nothing: behind a match of DEPTH words that ends at one word stands one of
at least DEPTH that ends at the next, or it has ended.

Defined results: null and empty texts have no words; texts shorter than a window keep all; documents without an id
count as the last ones; rows that share a doc_id and place remove nothing from one another; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .repeats import Reader, apply, merge_intervals, merged
from .suffix_dedup import doubled, ranks
from .tokens import words

WINDOW, GRAM, DEPTH = 20, 5, 40
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


class Words(Reader):
    window, gram, places = WINDOW, GRAM, True

    def units(self, texts):
        split = [t.split() for t in texts]
        buffer = b" ".join([b" ".join(w) for w in split if w])
        begin, end, hashes = words(buffer)
        return hashes, np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64), buffer, begin, end


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers below 2^levels: a packed bit row per level, counts every 64 bits."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.bits, self.counts, self.zeros = levels, [], [], []
        v = values
        for level in range(levels - 1, -1, -1):
            bit = (v >> np.uint64(level)) & np.uint64(1)
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, np.uint64)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position, plus where its run begins in the last row."""
        for k in range(self.levels):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> np.uint64(self.levels - 1 - k)) & np.uint64(1), self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a sequence of numbers from 1, in which 0 marks ends (the last number has to be 0). `begin` and
    `end` are the suffix interval of the `head` numbers from each place on; `head` is the greatest width up to `window`
    by which the suffixes were ranked."""

    def __init__(self, sequence: np.ndarray, longest: int, window: int = 1):
        n, width = len(sequence), 1
        r = ranks(np.concatenate([sequence, np.zeros(longest, np.uint64)]))
        self.head, head = width, r[:n]
        while width < longest and int(r[:n].max()) + 1 < n:
            step = min(width, longest - width)
            r = doubled(r, step)
            width += step
            if width <= window:
                self.head, head = width, r[:n]
        ends = np.cumsum(np.bincount(head))
        self.begin, self.end = np.concatenate([[0], ends])[head], ends[head]
        self.order = np.argsort(r[:n], kind="stable")
        transform = np.roll(sequence, 1)[self.order]  # the symbol before each suffix
        levels = max(1, int(sequence.max()).bit_length())
        self.matrix = WaveletMatrix(transform, levels)
        counts = np.bincount(sequence.astype(np.int64), minlength=(1 << levels) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: len(counts)]
        # the last row groups symbols by reversed bits; where the run of each begins there
        symbols = np.arange(len(counts), dtype=np.uint64)
        self.run = self.matrix.rank(symbols, np.zeros(len(counts), np.int64))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.rank(symbol, at) - self.run[symbol]


class Minima:
    """Least entry of any range, from the minima of all runs of a power of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << len(self.rows) <= 2 * len(x):
            y, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(y[:-half], y[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b); no range is empty."""
        row = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        for k in np.unique(row):
            at = row == k
            y = self.rows[k]
            out[at] = np.minimum(y[a[at]], y[b[at] - (1 << k)])
        return out


def matching_statistics(index: FMIndex, sequence: np.ndarray, key: np.ndarray, window: int, depth: int) -> np.ndarray:
    """For the place behind each word the length, to `depth`, of the longest match that ends there and has an occurrence
    of a lesser key than its own; lengths under `window` may be greater, as their keys aren't compared."""
    least = Minima(key[index.order])
    length = np.zeros(len(sequence) + 1, np.int64)
    ends = np.concatenate([[0], np.cumsum(sequence == 0)])
    live = np.flatnonzero(ends[index.head :] == ends[: len(ends) - index.head]) + index.head
    a, b = index.begin[live - index.head], index.end[live - index.head]
    for k in range(index.head, depth + 1):
        if k > index.head:
            there = live >= k
            there[there] = sequence[live[there] - k] > 0
            live, a, b = live[there], a[there], b[there]
            symbol = sequence[live - k]
            a, b = index.step(symbol, a), index.step(symbol, b)
        more = b - a > 1
        if k >= window:
            more[more] = least.least(a[more], b[more]) < key[live[more] - k]
        live, a, b = live[more], a[more], b[more]
        if not len(live):
            break
        length[live] = k
    return length


def word_numbers(raw: bytes, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers from 1 of equal words. Words with one hash are compared byte by byte with the first of them."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    data, length, of = np.frombuffer(raw, dtype=np.uint8), end - begin, first[number]
    same = np.array_equal(length, length[of])
    if same and len(length):
        offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        same = np.array_equal(data[np.repeat(begin, length) + offset], data[np.repeat(begin[of], length) + offset])
    if not same:
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return number.astype(np.uint64) + np.uint64(1)


def earlier_intervals(contents: list[bytes], ids: np.ndarray, starts: np.ndarray, window: int = WINDOW, depth: int = DEPTH):
    raw = b"\n".join(contents)
    begin, end, hashes = words(raw)
    lengths = np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum([len(c) + 1 for c in contents])])))
    sequence = np.insert(word_numbers(raw, begin, end, hashes), np.cumsum(lengths), np.uint64(0))
    first = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(contents)), lengths + 1)
    place = np.arange(len(sequence)) - first[owner]
    word, document = starts[owner] + place, ids[owner]
    order = np.lexsort((word, document))
    step = np.concatenate([[False], (word[order][1:] != word[order][:-1]) | (document[order][1:] != document[order][:-1])])
    key = np.empty(len(sequence), dtype=np.int64)
    key[order] = np.cumsum(step)  # order of (doc_id, word)
    length = matching_statistics(FMIndex(sequence, int(lengths.max()) + 1, window), sequence, key, window, depth)
    hit = np.flatnonzero(length >= window)
    content = owner[hit - 1]
    stop = hit - first[content]
    start = stop - length[hit]
    order = np.lexsort((start, content))
    return merge_intervals(content[order], start[order], stop[order])


def _finish(keep_text: bool):
    def run(doc_id, text, ranges):
        split, kept, at = text.split(), [], 0
        for a, b in merged(ranges):
            kept += split[at:a]
            at = b
        kept += split[at:]
        out = b" ".join(kept)
        return doc_id, len(split), len(split) - len(kept), hashlib.sha256(out).hexdigest(), out if keep_text else None

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every row of docs (doc_id, text)."""
    return apply(docs, Words(), earlier_intervals, _finish(keep_text), RESULT, "word-parts")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS x FROM d, unnest(range(1, len(w) - 18)) t(s)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
