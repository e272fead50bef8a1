"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark windows, one scan per text.

Text is normalised byte by byte (A-Z lower-cased, other ASCII that is no digit or letter to a blank), so each offset
of the normalised text is an offset of the original. A window is `ngram` consecutive words of an item, or a shorter
item as a whole. A document word inside any occurrence of a window is hit.

Defined results: null and empty texts have no words and no hits; items without words, text or id give no window;
repeated rows give equal results; an empty benchmark hits nothing; clashing columns are replaced.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, col, filtered

NGRAM = 10
#: Bytes of windows in one automaton. A larger benchmark is split into more of them, each with its own scan.
AUTOMATON_BYTES = 32 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BUILT: dict[str, ahocorasick.Automaton] = {}

FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("hit_items", T.ArrayType(T.LongType())), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(text: str | None, ngram: int = NGRAM) -> list[str]:
    """Windows as the automaton sees them: words with one blank before, between and after, a character per byte."""
    words = words_of(text)
    return [(b" " + b" ".join(words[i : i + ngram]) + b" ").decode("latin-1") for i in range(max(1, len(words) - ngram + 1))] if words else []


def _automaton(key: str, windows: list[tuple[str, list[int]]]) -> ahocorasick.Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        auto = ahocorasick.Automaton()
        for window, items in windows:
            auto.add_word(window, (len(window), tuple(items)))
        if windows:
            auto.make_automaton()
        _BUILT[key] = auto
    return _BUILT[key]


def _original(text: str, first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Word indices to code point spans of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], folded.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in zip(first, last, strict=True)]


def scan_text(text: str | None, auto: ahocorasick.Automaton, before: tuple | None) -> tuple:
    """(words, hit word ranges, items, spans); `before` holds what earlier automata found."""
    words = words_of(text)
    ranges, items = [(r["first"], r["last"]) for r in before[0]] if before else [], set(before[1]) if before else set()
    found = list(auto.iter((b" " + b" ".join(words) + b" ").decode("latin-1"))) if words and len(auto) else []
    if found:
        begin = np.cumsum([1] + [len(w) + 1 for w in words])  # where each word starts in the normalised text
        ends = np.array([e for e, _ in found])
        first = np.searchsorted(begin, ends + 2 - np.array([n for _, (n, _) in found]))
        last = np.searchsorted(begin, ends + 1) - 1
        ranges += list(zip(first.tolist(), last.tolist(), strict=True))
        for x in {i for _, (_, i) in found}:
            items.update(x)
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    spans = _original(text, [m[0] for m in merged], [m[1] for m in merged]) if merged else []
    return len(words), [{"first": a, "last": b} for a, b in merged], sorted(items), [{"start": a, "end": b} for a, b in spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", ngram: int = NGRAM, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs plus n_words, hit_words (ranges of word indices), hit_items (ids) and hit_spans (code points)."""
    spark = docs.sparkSession
    parts = add_columns(benchmark.select(col("item_id").cast("long").alias("item_id"), col("text").alias("text")).where("item_id IS NOT NULL"), ["text"], [T.StructField("w", T.ArrayType(T.StringType()))], lambda texts: [[list(set(windows_of(t, ngram))) for t in texts]])
    windows = parts.select("item_id", F.explode("w").alias("w")).groupBy("w").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    size = windows.agg(F.sum(F.length("w") + 8 * F.size("items"))).head()[0] or 0
    slices = max(1, -(-int(size) // automaton_bytes))
    out = docs
    for k in range(slices):
        held = spark.sparkContext.broadcast([(r["w"], list(r["items"])) for r in windows.where(F.pmod(F.xxhash64("w"), F.lit(slices)) == k).collect()])

        def scan(texts, ranges=None, items=None, held=held, key=uuid.uuid4().hex):
            auto = _automaton(key, held.value)
            rows = [scan_text(t, auto, (ranges[i], items[i]) if ranges else None) for i, t in enumerate(texts)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

        out = add_columns(out, [text] + (["hit_words", "hit_items"] if k else []), FOUND, scan)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    return filtered(docs, {"text": text}, lambda rows: find_contamination(rows, benchmark, "text", ngram).where(F.size("hit_items") == 0))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS x FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS x FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT doc_id, s, dw.n AS n, item_id FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
