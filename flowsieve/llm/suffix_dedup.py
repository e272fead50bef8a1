"""Byte-level deduplication by longest-previous-factor arrays.

In each shard the distinct contents stand in ascending order of their first document. The suffixes at window starts are
sorted; suffixes that share no window with another one leave early. In suffix order, the nearest places before and
behind each suffix that belong to a smaller document (previous and next smaller values) are the ones with which it
shares most of all earlier ones, so the longer of the two common prefixes is its longest factor that also starts in a
document with a smaller doc_id. Factors of at least a window are removed from the later copy; the first one stays.

The order is exact to `DEPTH` bytes and factors are cut there. That loses nothing: behind a factor of DEPTH bytes at one
byte stands one of at least DEPTH - 1 at the next.

Defined results: null and empty texts have no bytes; texts shorter than a window keep all; documents without an id
count as the last ones; rows that share a doc_id remove nothing from one another; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .repeats import Reader, apply, merge_intervals, merged
from .tokens import mix

WINDOW, GRAM = 50, 20
DEPTH = WINDOW + 48
END = b"\xff"  # no byte of UTF-8
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


class Bytes(Reader):
    window, gram, places = WINDOW, GRAM, False

    def units(self, texts):
        buffer = b"".join(texts)
        at = np.arange(len(buffer) + 1)
        return _BYTE[np.frombuffer(buffer, dtype=np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), buffer, at, at + 1


def ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks from 0, as 32-bit numbers where they fit."""
    order = np.argsort(x)
    y = x[order]
    step = np.empty(len(x), dtype=bool)
    step[:1] = False
    np.not_equal(y[1:], y[:-1], out=step[1:])
    del y
    small = np.uint32 if len(x) < 1 << 32 else np.uint64
    out = np.empty(len(x), dtype=small)
    out[order] = np.cumsum(step, dtype=small)
    return out


def doubled(r: np.ndarray, step: int) -> np.ndarray:
    """Ranks of what r stands for together with what follows `step` further on."""
    key = r[: len(r) - step].astype(np.uint64)
    key *= np.uint64(int(r.max()) + 1)
    key += r[step:]
    return ranks(key)


def packed_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the eight bytes from each position on."""
    n = len(text) - 7
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight <<= np.uint64(8)
        eight |= text[k : k + n]
    return ranks(eight)


def _refined(run: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a new run begins) of runs parted by a second rank."""
    key = run.astype(np.uint64)
    key *= np.uint64(int(by.max()) + 1)
    key += by
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(len(key), dtype=bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return order, new


def suffix_order(eight: np.ndarray, at: np.ndarray, room: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes from positions `at` that share their first `window` bytes with another one, sorted to `depth` bytes:
    (indices into `at`, run of equal windows of each). room: bytes from each position to the end of its content."""
    run, live = eight[at], np.arange(len(at))
    for d in [*range(8, window - 7, 8), window - 8]:
        order, new = _refined(run, eight[at[live] + d])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(new)))
        several = np.repeat(size > 1, size)
        live, run = live[order[several]], np.cumsum(new[several], dtype=np.uint32) - np.uint32(1)
        if not len(live):
            return live, run
    windows, finer = run, run
    for d in range(window, depth, 8):
        there = np.minimum(at[live] + d, len(eight) - 1)
        order, new = _refined(finer, np.where(room[live] > d, eight[there], 0))
        live, windows, finer = live[order], windows[order], np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        if new.all():
            break
    return live, windows


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Of each entry the place of the nearest one before it that is less, or -1; by a tree of minima, all at once."""
    tree = [x]
    while len(tree[-1]) > 1:
        y = tree[-1]
        y = np.append(y, np.iinfo(x.dtype).max) if len(y) % 2 else y
        tree.append(np.minimum(y[::2], y[1::2]))
    found, level, open_ = np.full(len(x), -1), np.full(len(x), -1, dtype=np.int8), np.arange(len(x))
    for k, y in enumerate(tree):  # up, until the neighbour on the left holds something less
        left = (open_ >> k) - 1
        hit = (left % 2 == 0) & (left >= 0)
        hit &= y[np.maximum(left, 0)] < x[open_]
        found[open_[hit]], level[open_[hit]] = left[hit], k
        open_ = open_[~hit]
    for k in range(len(tree) - 1, 0, -1):  # down, to the right as long as that holds something less
        go = np.flatnonzero(level == k)
        y, right = tree[k - 1], 2 * found[go] + 1
        take = (right < len(y)) & (y[np.minimum(right, len(y) - 1)] < x[go])
        found[go], level[go] = np.where(take, right, right - 1), k - 1
    return found


def common_prefix(text: np.ndarray, eight: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Length of what the suffixes at a and b share, `known` of it for sure, to `depth` and some more."""
    length = np.full(len(a), known)
    for step, ranked, times in ((8, eight, -(-(depth - known) // 8)), (1, text, 7)):
        live = np.arange(len(a))
        for _ in range(times):
            x, y = a[live] + length[live], b[live] + length[live]
            inside = np.maximum(x, y) < len(ranked)
            live = live[inside][ranked[x[inside]] == ranked[y[inside]]]
            length[live] += step
    return length


def longest_previous(contents: list[bytes], ids: np.ndarray, window: int = WINDOW, depth: int = DEPTH):
    """(content, place, length, content of the source): of each window start whose longest factor with a smaller document
    reaches the window, sorted by content and place. Contents are in ascending order of ids."""
    lengths = np.array([len(c) for c in contents])
    text = np.frombuffer(END.join(contents) + END * 8, dtype=np.uint8)
    first = np.cumsum(lengths + 1) - lengths - 1
    count = lengths - window + 1
    owner = np.repeat(np.arange(len(contents)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at, room = first[owner] + place, lengths[owner] - place
    eight = packed_ranks(text)
    live, run = suffix_order(eight, at, room, window, depth)
    if not len(live):
        return (np.zeros(0, np.int64),) * 4
    document = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))[owner[live]]
    sources, factors = np.full(len(live), -1), np.zeros(len(live), np.int64)
    for back in (False, True):
        near = len(live) - 1 - previous_smaller(document[::-1])[::-1] if back else previous_smaller(document)
        near = np.where(near == len(live), -1, near)
        k = np.flatnonzero((near >= 0) & (run[near] == run))
        shared = common_prefix(text, eight, at[live[k]], at[live[near[k]]], window, depth)
        shared = np.minimum(np.minimum(shared, depth), np.minimum(room[live[k]], room[live[near[k]]]))
        better = shared > factors[k]
        factors[k[better]], sources[k[better]] = shared[better], near[k[better]]
    hit = np.flatnonzero(factors >= window)
    hit = hit[np.argsort(live[hit])]
    return owner[live[hit]], place[live[hit]], factors[hit], owner[live[sources[hit]]]


def earlier_intervals(contents: list[bytes], ids: np.ndarray, starts: np.ndarray):
    content, place, length, _ = longest_previous(contents, ids)
    return merge_intervals(content, place, place + length)


def _finish(keep_text: bool):
    def run(doc_id, text, ranges):
        spans = merged(ranges)
        kept, at = [], 0
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        kept = b"".join(kept) + text[at:] if spans else text
        return doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row of docs (doc_id, text)."""
    return apply(docs, Bytes(), earlier_intervals, _finish(keep_text), RESULT, "byte-parts")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s - 1, 100) AS x FROM d, unnest(range(1, len(h) // 2 - 48)) t(s)),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS m FROM w) WHERE m < doc_id),
step AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM step),
spans AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM numbered GROUP BY ALL),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM spans),
kept AS (SELECT d.doc_id, count(*) AS n_spans, string_agg(substr(h, CAST(2 * since - 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a) || any_value(substr(h, CAST(2 * e - 1 AS BIGINT))) AS k
  FROM d JOIN piece ON d.doc_id = piece.doc_id JOIN (SELECT doc_id, max(b) AS e FROM spans GROUP BY 1) z ON d.doc_id = z.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST((len(h) - len(coalesce(k, h))) // 2 AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
