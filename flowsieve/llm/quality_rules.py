"""Quality rules by suffix-array repetition.

The words of a text are sorted by their suffixes (prefix doubling, many texts at once, no order across texts); ranks of
all doublings give the longest common prefix of neighbours. The LCP intervals of at least `LEAST` words are the repeated
substrings; those that can be extended neither to the right nor to the left are maximal. Their spans are united, and a
text is rejected where the union covers more than `MOST_COVERED` of its word characters, or where the longest maximal
repeat has more than `LONGEST` words. Since each repeated window lies in a maximal repeat, the union also gives the words
in repeated windows of the base rule.

`unit="char"` sorts code points instead, for scripts without blanks; lengths are then in code points.

Defined results: null and empty texts have no words, fail the base rule and have no repeats; rows are judged one by one,
so repeated rows give equal results; an empty table gives an empty table; columns that clash with the new ones are
replaced; a text may be of any length and of one word only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, filtered
from .suffix_dedup import previous_smaller

#: Words in the least repeat, word characters that repeats may cover (percent), words in the longest repeat allowed.
LEAST, MOST_COVERED, LONGEST = 8, 30, 50
#: Fixed values of the base rule: least words, and percent of words that may be in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Characters of texts that are sorted at once; a longer text is sorted by itself.
AT_ONCE = 2_000_000

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MAXIMAL = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "times")])
FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")],
    T.StructField("repeat_spans", T.ArrayType(SPAN)),
    T.StructField("maximal_repeats", T.ArrayType(MAXIMAL)),
]


@dataclass
class Repeats:
    """Disjoint ascending spans [start, end) of repeated symbols, and of each maximal repeat its first place in suffix
    order, length and number of occurrences; all in symbols of the batch."""

    starts: np.ndarray
    ends: np.ndarray
    place: np.ndarray
    length: np.ndarray
    times: np.ndarray


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first entry of each entry's group, whether the group has several) of sorted entries."""
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(new)))
    return np.repeat(begin, size), np.repeat(size > 1, size)


def suffix_ranks(symbols: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Rank arrays of the suffixes by their first 1, 2, 4 ... symbols; in the last one all ranks differ.

    A rank is the place of the first suffix of its group, so that a group that is alone keeps its rank from then on and
    leaves the work. Groups never hold suffixes of two texts: the text number sorts first. One more entry stands behind
    the last symbol."""
    n = len(symbols)
    key = text.astype(np.uint64) * np.uint64(int(symbols.max(initial=0)) + 1) + symbols.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, several = _groups(np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = first, n
    levels, live, step = [rank], order[several], 1
    ends_at = np.searchsorted(text, text, side="right")  # where the text of each symbol ends
    while len(live):
        there = live + step
        second = np.where(there < ends_at[live], rank[np.minimum(there, n)] + 1, 0)
        key = rank[live] * np.int64(n + 2) + second
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        first, several = _groups(np.concatenate([[True], key[1:] != key[:-1]]))
        held = rank[live]
        of_old, _ = _groups(np.concatenate([[True], held[1:] != held[:-1]]))
        rank = rank.copy()
        rank[live] = held + first - of_old
        levels.append(rank)
        live, step = live[several], 2 * step
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray, least: int) -> np.ndarray:
    """Of each suffix in order the symbols that it shares with the one before it, or 0 if fewer than `least`."""
    shared = np.zeros(len(order), dtype=np.int64)
    top = least.bit_length() - 1  # the largest doubling within `least`
    if len(levels) <= top:
        return shared
    at = 1 + np.flatnonzero(levels[top][order[1:]] == levels[top][order[:-1]])
    a, b, length = order[at - 1].copy(), order[at].copy(), np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        a[equal] += 1 << k
        b[equal] += 1 << k
        length[equal] += 1 << k
    shared[at] = np.where(length >= least, length, 0)
    return shared


def find_repeats(symbols: np.ndarray, text: np.ndarray, least: int = LEAST) -> Repeats:
    """The repeats of at least `least` symbols within each text (text: ascending number of the text of each symbol)."""
    none = np.zeros(0, dtype=np.int64)
    if len(symbols) <= least:
        return Repeats(none, none, none, none, none)
    levels = suffix_ranks(symbols, text)
    order = np.empty(len(symbols), dtype=np.int64)
    order[levels[-1][:-1]] = np.arange(len(symbols))
    lcp = common_prefixes(levels, order, least)
    if not lcp.any():
        return Repeats(none, none, none, none, none)
    # the suffixes that share something with a neighbour, runs of them parted by zeros
    held = np.flatnonzero((lcp > 0) | np.append(lcp[1:] > 0, False))
    h, suffix = lcp[held], order[held]
    behind = np.append(h[1:], 0)
    left = previous_smaller(h)
    right = len(h) - 1 - previous_smaller(h[::-1])[::-1]
    some = np.flatnonzero(h > 0)
    intervals = np.unique(np.stack([left[some], right[some]], axis=1), axis=0, return_index=True)
    lo, hi, length = intervals[0][:, 0], intervals[0][:, 1], h[some[intervals[1]]]
    # left-maximal: not all occurrences have the same symbol before them
    before = np.where((suffix > 0) & (text[suffix] == text[np.maximum(suffix - 1, 0)]), symbols[np.maximum(suffix - 1, 0)].astype(np.int64), -1)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    maximal = changes[hi - 1] > changes[lo]
    place, times, length = suffix[lo[maximal]], (hi - lo)[maximal], length[maximal]
    # each suffix is covered by its deepest interval
    by_place = np.argsort(suffix)
    at, until = suffix[by_place], np.maximum.accumulate((suffix + np.maximum(h, behind))[by_place])
    new = np.flatnonzero(np.concatenate([[True], (at[1:] > until[:-1]) | (text[at[1:]] != text[at[:-1]])]))
    return Repeats(at[new], until[np.append(new[1:], len(until)) - 1], place, length, times)


def _symbols(words: list) -> np.ndarray:
    """Numbers of equal words, from 0."""
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def _cut(texts: list[str], unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, text, start, end in code points of the joined texts) of each unit of the texts."""
    joined = "\n".join(texts)
    if unit == "char":
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        at = np.arange(len(points))
        keep = ~np.isin(points, [ord(c) for c in BLANKS])
        symbols, starts, ends = points[keep].astype(np.int64), at[keep], at[keep] + 1
    else:
        data = joined.encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        symbols = _symbols(data.split())
        if not joined.isascii():  # from bytes to code points
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            starts, ends = points[starts], points[ends]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[: len(texts)]
    return symbols, np.searchsorted(begins, starts, side="right") - 1, starts, ends


def _judged(texts: list[str], unit: str, least: int) -> list[tuple]:
    symbols, text, starts, ends = _cut(texts, unit)
    found = find_repeats(symbols, text, least)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    chars = np.concatenate([[0], np.cumsum(ends - starts)])
    units = np.searchsorted(text, np.arange(len(texts) + 1))
    spans, repeats = np.searchsorted(found.starts, units), np.argsort(found.place, kind="stable")
    place, length, times = found.place[repeats], found.length[repeats], found.times[repeats]
    of_text = np.searchsorted(place, units)
    out = []
    for k, t in enumerate(texts):
        s, e = found.starts[spans[k] : spans[k + 1]], found.ends[spans[k] : spans[k + 1]]
        p, m, c = (x[of_text[k] : of_text[k + 1]] for x in (place, length, times))
        lines = [line for line in t.split("\n") if line.strip(BLANKS)]
        n_words = int(units[k + 1] - units[k]) if unit == "word" else len(t.encode().split())
        out.append((
            n_words, len(t) - sum(t.count(b) for b in BLANKS), sum(t.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), int((e - s).sum()), int((chars[e] - chars[s]).sum()), int(m.max(initial=0)),
            [{"start": int(a), "end": int(b)} for a, b in zip(starts[s] - begins[k], ends[e - 1] - begins[k], strict=True)] if len(s) else [],
            [{"start": int(a), "length": int(b), "times": int(x)} for a, b, x in zip(starts[p] - begins[k], m, c, strict=True)] if len(p) else [],
        ))
    return out


def repetition(docs: DataFrame, text: str = "text", unit: str = "word", least: int = LEAST, detail: bool = True) -> DataFrame:
    """docs plus the base counts, the units (`n_repeat_words`) and characters (`covered_chars`) in the union of repeats,
    the units of the longest repeat, and with `detail` the united spans (code points, end exclusive) and the maximal
    repeats (start of one occurrence, units, occurrences)."""

    def fn(texts):
        out, held, size = [], [], 0
        for t in [*((t or "") for t in texts), None]:
            if held and (t is None or size + len(t) > AT_ONCE):
                out += _judged(held, unit, least)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)
        columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in FIELDS]
        return columns if detail else columns[:-2]

    return add_columns(docs, [text], FIELDS if detail else FIELDS[:-2], fn)


def judge(repeated: DataFrame, most_covered: int = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """Plus base_failed and kept: false where the base rule fails, the covered share of word characters is over
    `most_covered` percent, or the longest repeat has more than `longest` units."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    repetitive = (100 * F.col("covered_chars") > most_covered * F.col("word_chars")) | (F.col("longest_repeat") > longest)
    return repeated.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~repetitive)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    return filtered(docs, {"text": text}, lambda d: judge(repetition(d, detail=False)).where("kept"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars")


#: A repeat of more than LONGEST words is a window of LONGEST + 1 words that occurs twice.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT k, i, array_to_string(ws[i:i + 7], ' ') AS g, CASE WHEN i + 50 <= len(ws) THEN array_to_string(ws[i:i + 50], ' ') END AS long_g FROM (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
r AS (SELECT k, i FROM x QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
hit AS (SELECT DISTINCT k, i + j AS i FROM r, range(8) o(j)),
c AS (SELECT hit.k, count(*) AS n, sum(length(ws[i])) AS chars FROM hit JOIN w ON hit.k = w.k GROUP BY 1),
far AS (SELECT k, count(long_g) > count(DISTINCT long_g) AS too_long FROM x GROUP BY 1),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(coalesce(c.chars, 0) AS BIGINT) AS covered_chars, coalesce(too_long, false) AS too_long
  FROM d JOIN w ON d.k = w.k LEFT JOIN dup ON d.k = dup.k LEFT JOIN c ON d.k = c.k LEFT JOIN far ON d.k = far.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, covered_chars,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * covered_chars > 30 * word_chars OR too_long) AS kept FROM b
"""
