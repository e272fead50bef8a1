"""Repeated passages over the whole corpus: what the word-level and the byte-level operators share.

Every window of `window` units (words or bytes) is led by its minimizer, the least hash of the `gram`-unit grams in
it; windows in a row with the same minimizer form a fragment. Equal windows have equal minimizers, so
1. each part sends its minimizers to shards by hash range and learns which occur again anywhere,
2. sends the fragments of those, each distinct content of the part once with its earliest place, to the shard of the
   minimizer, where an index over the distinct contents, in the order of their earliest places, finds the intervals of
   each that also start earlier,
3. and gets these back, or that the whole content has an earlier place, and removes what they cover.
Messages go from part to shard and back; a content occurs once per part, whatever the number of its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .parts import by_shard, expand, in_shards, make_parts, map_rows, shard_count, squeeze, with_answers
from .tokens import mix

NO_ID = np.iinfo(np.int64).max
SEGMENT = 1 << 20
PART = T.StructType([T.StructField(n, t) for n, t in (("ids", T.ArrayType(T.LongType())), ("lengths", T.BinaryType()), ("texts", T.BinaryType()), ("anchors", T.BinaryType()), ("again", T.BinaryType()))])
MESSAGE = T.StructType([T.StructField("part", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def rolling(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n units from each position on, by doubling."""
    by, done, out, level, width = np.uint64(0x9E3779B97F4A7C15), 0, None, units, 1
    powers = np.array([by])  # an array, so that it wraps in silence
    while True:
        if n & width:
            if out is None:
                out, done = level, width
            else:
                size = len(units) - done - width + 1
                out, done = out[:size] * powers + level[done : done + size], done + width
        if width * 2 > n:
            return mix(out) >> np.uint64(16)
        level = level[: len(level) - width] * powers + level[width:]
        powers = powers * powers * np.uint64(0xD1B54A32D192ED03)
        width *= 2


def least_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` entries from each position on."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


@dataclass
class Fragments:
    """Of one segment: first unit, number of windows, minimizer and document (its place in the part) of each."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def anchors_of(units: np.ndarray, first: np.ndarray, reader) -> np.ndarray:
    """The minimizers of a segment, once per fragment; twice for a fragment that holds its own more than once and so may
    repeat a window within itself, where places count."""
    f = fragments(units, first, reader.window, reader.gram)
    if not reader.places or not len(f.start):
        return f.anchor
    grams = mix(rolling(units, reader.gram)) >> np.uint64(16)
    width = f.windows + reader.window - reader.gram
    begin = np.cumsum(width) - width
    at = np.repeat(f.start - begin, width) + np.arange(int(width.sum()))
    held = np.add.reduceat((grams[at] == np.repeat(f.anchor, width)).astype(np.int64), begin)
    return np.concatenate([f.anchor, f.anchor[held > 1]])


def fragments(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> Fragments:
    """units of documents behind one another; first: where each begins, and the end."""
    none = np.zeros(0, np.int64)
    if len(units) < window:
        return Fragments(none, none, np.zeros(0, np.uint64), none)
    low = least_in(rolling(units, gram), window - gram + 1)
    ends = np.repeat(first[1:], np.diff(first))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + window <= ends)
    if not len(at):
        return Fragments(none, none, np.zeros(0, np.uint64), none)
    low = mix(low[at]) >> np.uint64(16)  # minima crowd at the low end; mixed again, they spread evenly over the shards
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])]))
    return Fragments(at[new], np.diff(np.append(new, len(at))), low[new], np.searchsorted(first, at[new], "right") - 1)


class Reader:
    """How an operator sees a segment of texts. units() gives (unit hashes, first unit of each document, the buffer,
    begin and end of each unit in it)."""

    window: int
    gram: int
    places: bool  # whether the place within a document counts, or the document alone

    def units(self, texts: list[bytes]):
        raise NotImplementedError


def segments(ids: list, texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first document, texts) of about SEGMENT bytes."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= SEGMENT or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, held = i + 1, 0


def _unpacked(row) -> tuple[np.ndarray, list[bytes]]:
    raw, lengths = expand(row["texts"]), expand(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    ids = np.array([NO_ID if i is None or i != i else i for i in row["ids"]], dtype=np.int64)
    return ids, [raw[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def parts_of(docs: DataFrame, reader: Reader, name: str) -> DataFrame:
    def fn(ids, texts):
        found = [anchors_of(u, f, reader) for _, some in segments(ids, texts) for u, f, *_ in [reader.units(some)]]
        anchors, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
        return ids, squeeze(np.array([len(t) for t in texts], dtype=np.int64)), squeeze(b"".join(texts)), squeeze(np.diff(anchors, prepend=np.uint64(0))), squeeze(np.packbits(n > 1))

    return make_parts(docs, fn, PART, name)


def _anchors(row) -> tuple[np.ndarray, np.ndarray]:
    anchors = np.cumsum(expand(row["anchors"], np.uint64), dtype=np.uint64)
    return anchors, np.unpackbits(expand(row["again"], np.uint8))[: len(anchors)].astype(bool)


def _shard_edges(anchors: np.ndarray, shards: int):
    return by_shard(anchors << np.uint64(16), shards)


def repeated_anchors(parts: DataFrame, shards: int) -> DataFrame:
    """(part, shard, bits): which of the part's anchors in the shard's range occur again."""

    def ask(row):
        anchors, again = _anchors(row)
        for s, a, b in _shard_edges(anchors, shards):
            yield row["part"], s, squeeze(np.diff(anchors[a:b], prepend=np.uint64(0))), squeeze(np.packbits(again[a:b]))

    def answer(frame):
        asked = [np.cumsum(expand(x, np.uint64), dtype=np.uint64) for x in frame["a"]]
        again = np.concatenate([np.unpackbits(expand(b, np.uint8))[: len(x)] for b, x in zip(frame["b"], asked, strict=True)])
        _, index, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        often = n > 1
        np.logical_or.at(often, index, again.astype(bool))
        bits, at = often[index], 0
        for part, x in zip(frame["part"], asked, strict=True):
            yield int(part), int(frame["shard"].iloc[0]), squeeze(np.packbits(bits[at : at + len(x)])), None
            at += len(x)

    return in_shards(map_rows(parts.select("part", "anchors", "again"), ask, MESSAGE), "shard", answer, MESSAGE)


def _marked(row, answers, shards: int) -> np.ndarray:
    """The part's anchors that occur again, sorted."""
    anchors, _ = _anchors(row)
    bits = {int(s): x for s, x in zip(answers["shard"], answers["a"], strict=True)}
    flags = np.zeros(len(anchors), dtype=bool)
    for s, a, b in _shard_edges(anchors, shards):
        flags[a:b] = np.unpackbits(expand(bits[s], np.uint8))[: b - a]
    return anchors[flags]


@dataclass
class Contents:
    """The distinct contents of a part's marked fragments, by shard; uses: (content, document, first unit, windows)."""

    contents: list[list[bytes]]
    ids: list[list[int]]
    starts: list[list[int]]
    uses: list[tuple[int, int, int, int, int]]


def contents_of(ids: np.ndarray, texts: list[bytes], marked: np.ndarray, reader: Reader, shards: int) -> Contents:
    """In a fixed order, so that the part finds its contents again by their number."""
    out = Contents([[] for _ in range(shards)], [[] for _ in range(shards)], [[] for _ in range(shards)], [])
    number: dict[bytes, tuple[int, int]] = {}
    share = np.uint64((1 << 64) // shards)
    for at, some in segments(ids, texts):
        units, first, buffer, begin, end = reader.units(some)
        f = fragments(units, first, reader.window, reader.gram)
        if not len(f.start) or not len(marked):
            continue
        place = np.minimum(np.searchsorted(marked, f.anchor), len(marked) - 1)
        keep = np.flatnonzero(marked[place] == f.anchor)
        start, windows = f.start[keep], f.windows[keep]
        shard = np.minimum((f.anchor[keep] << np.uint64(16)) // share, np.uint64(shards - 1)).astype(np.int64)
        where = start - first[f.doc[keep]]
        for s, d, w, n, a, b in zip(shard.tolist(), (f.doc[keep] + at).tolist(), where.tolist(), windows.tolist(), begin[start].tolist(), end[start + windows + reader.window - 2].tolist(), strict=True):
            content, i = buffer[a:b], int(ids[d])
            if (known := number.get(content)) is None:
                known = number[content] = (s, len(out.contents[s]))
                out.contents[s].append(content)
                out.ids[s].append(i)
                out.starts[s].append(w)
            else:
                s, k = known
                if (i, w) < (out.ids[s][k], out.starts[s][k]):
                    out.ids[s][k], out.starts[s][k] = i, w
            out.uses.append((*known, d, w, n))
    return out


def earlier_places(parts: DataFrame, reader: Reader, index: Callable, shards: int) -> DataFrame:
    """(part, shard, intervals): of contents of the part, as rows content, begin, end in units; an end of -1 stands for the
    whole content, where it has an earlier place than the part's own. index(contents, ids, starts) gets the distinct
    contents in ascending order of their earliest (id, start) and gives (content, begin, end) of the intervals whose
    windows also start earlier, sorted by content."""

    def send(row, answers):
        ids, texts = _unpacked(row)
        found = contents_of(ids, texts, _marked(row, answers, shards), reader, shards)
        for s in range(shards):
            if found.contents[s]:
                yield row["part"], s, squeeze(np.array([found.ids[s], found.starts[s], [len(c) for c in found.contents[s]]], dtype=np.int64)), squeeze(b"".join(found.contents[s]))

    def look(frame):
        number: dict[bytes, int] = {}
        best: list[tuple[int, int]] = []
        asked = []
        for a, b in zip(frame["a"], frame["b"], strict=True):
            ids, starts, lengths = expand(a, np.int64).reshape(3, -1)
            raw, ends = expand(b), np.cumsum(lengths).tolist()
            which = []
            for i, s, e, n in zip(ids.tolist(), starts.tolist(), ends, lengths.tolist(), strict=True):
                k = number.setdefault(raw[e - n : e], len(best))
                if k == len(best):
                    best.append((i, s))
                elif (i, s) < best[k]:
                    best[k] = (i, s)
                which.append(k)
            asked.append((ids, starts, np.array(which, dtype=np.int64)))
        order = np.array(sorted(range(len(best)), key=best.__getitem__), dtype=np.int64)
        names = list(number)
        best_id, best_start = np.array(best, dtype=np.int64).reshape(-1, 2).T
        content, begin, end = index([names[k] for k in order], best_id[order], best_start[order])
        intervals = np.bincount(content, minlength=len(order))
        first = np.cumsum(intervals) - intervals
        begin, end = np.append(begin, 0), np.append(end, -1)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        for part, (ids, starts, which) in zip(frame["part"], asked, strict=True):
            later = ids > best_id[which]
            if reader.places:
                later |= (ids == best_id[which]) & (starts > best_start[which])
            c = back[which]
            n = np.where(later, 1, intervals[c])
            mine = np.repeat(np.arange(len(c)), n)
            at = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at[np.repeat(later, n)] = len(begin) - 1
            if len(at):
                yield int(part), int(frame["shard"].iloc[0]), squeeze(np.stack([mine, begin[at], end[at]])), None

    sent = with_answers(parts, repeated_anchors(parts, shards), send, MESSAGE)
    return in_shards(sent, "shard", look, MESSAGE)


def mark(row, answers, places, reader: Reader, shards: int):
    """(ids, texts, removed): for every document of the part the ranges of units to remove, as a list of pairs."""
    ids, texts = _unpacked(row)
    found = contents_of(ids, texts, _marked(row, answers, shards), reader, shards)
    intervals: dict[tuple[int, int], list] = {}
    for s, x in zip(places["shard"], places["a"], strict=True):
        for k, a, b in expand(x, np.int64).reshape(3, -1).T.tolist():
            intervals.setdefault((int(s), k), []).append((a, b))
    removed: list[list[tuple[int, int]]] = [[] for _ in texts]
    for s, k, d, at, n in found.uses:
        i, whole = int(ids[d]), n + reader.window - 1
        first, where = found.ids[s][k], found.starts[s][k]
        if first < i or (reader.places and first == i and where < at):
            removed[d].append((at, at + whole))
            continue
        removed[d] += [(at + a, at + (b if b >= 0 else whole)) for a, b in intervals.get((s, k), ())]
    return ids, texts, removed


def merge_intervals(content: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals of each content; they are sorted by (content, begin)."""
    if not len(begin):
        return content, begin, end
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(content * wide + end)
    new = np.flatnonzero(np.concatenate([[True], (content * wide + begin)[1:] > reach[:-1]]))
    return content[new], begin[new], np.append(reach[new[1:] - 1], reach[-1]) - content[new] * wide


def apply(docs: DataFrame, reader: Reader, index: Callable, finish: Callable, schema: T.StructType, name: str) -> DataFrame:
    """finish(doc_id, text, ranges) gives the row of a document."""
    parts = parts_of(docs, reader, name)
    shards = shard_count(parts)
    answers = repeated_anchors(parts, shards)
    places = earlier_places(parts, reader, index, shards)
    tagged = answers.selectExpr("part", "shard", "a", "false AS placed").unionByName(places.selectExpr("part", "shard", "a", "true AS placed"))

    def done(row, frame):
        ids, texts, removed = mark(row, frame[~frame["placed"]], frame[frame["placed"]], reader, shards)
        for i, t, r in zip(ids.tolist(), texts, removed, strict=True):
            yield finish(None if i == NO_ID else i, t, r)

    return with_answers(parts, tagged, done, schema)


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
