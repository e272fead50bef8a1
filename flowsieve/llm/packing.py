"""Packing by minimum bin slack.

Documents become token ids and are cut only where they exceed a sequence: full pieces, then one rest. The rests are
packed by their length alone: a bitset subset-sum over the multiset of remaining lengths, always with the longest
one in, finds the filling closest to the capacity; backtracking gives the count of each length, and the filling is
repeated as long as the counts last. The number of distinct fillings is bounded by the capacity and not by the corpus,
so the plan is made from a histogram of at most `capacity` lengths; pieces find their places by their rank within
their length.

Defined results: null and empty texts are the end id alone; repeated rows and repeated or null ids are packed row by
row; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, ranked, stored

CAPACITY = 4096
END_ID = 2
#: Words, and runs of letters in them, whose ids a worker remembers.
REMEMBERED = 1_000_000
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Latin letters that NFC keeps and that fold, each by itself, to letters (the dotted capital I doesn't).
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_WORDS: dict[str, _Words] = {}


class _Words(dict):
    """Ids of words between blanks, made when first asked for. A run of Latin letters is a token run of its own, and so
    are the ASCII marks behind it: the model takes the folded letters as they are, without the normaliser's and the
    splitter's patterns. Every other word goes to the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.letters: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        # the byte-level alphabet: how the model sees each character
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {c: spell(chr(c))[0][0] for c in range(128, 0x2E80) if chr(c).isalpha()}

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if _LATIN.fullmatch(core):
            low = core.lower()
            if (ids := self.letters.get(low)) is None:
                if len(self.letters) >= REMEMBERED:
                    self.letters.clear()
                found = self.tokenize(low if low.isascii() else low.translate(self.alphabet))
                ids = self.letters[low] = array("I", [t.id for t in found]).tobytes()
            if len(core) < len(word):
                ids += self[word[len(core) :]]
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids


def encode(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text. The tokenizer drops white space before it merges, so the ids of a
    text are those of its words."""
    if path not in _WORDS:
        _WORDS[path] = _Words(path)
    of_word, end = _WORDS[path].__getitem__, array("I", [end_id]).tobytes()
    return [b"".join(map(of_word, t.replace("\n", " ").split(" "))) + end if t else end for t in texts]


def best_fill(left: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """Counts by length, within `left`, of a multiset whose sum is as near to `room` as can be, from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        have = min(left.get(n, 0), room // n)
        k = 1
        while have > 0 and not reach >> room & 1:
            take = min(k, have)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & mask
            have -= take
            k *= 2
        if reach >> room & 1:
            break
    total, counts = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            counts[n] = counts.get(n, 0) + take
            total -= n * take
    return counts


def plan_fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(counts by length, how often) until all lengths are used up."""
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left, reverse=True)
    fillings = []
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        counts = best_fill(left, lengths, capacity - longest)
        left[longest] += 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(left[n] // c for n, c in counts.items())
        for n, c in counts.items():
            left[n] -= c * times
        fillings.append((counts, times))
        if not all(left[n] for n in counts):
            lengths = [n for n in lengths if left[n]]
    return fillings


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length: key (length and first rank), pieces per sequence, first sequence, offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for counts, times in fillings:
        offset = 0
        for n in sorted(counts, reverse=True):
            rows.append(((n << 44) + used.get(n, 0), counts[n], sequence, offset))
            used[n] = used.get(n, 0) + counts[n] * times
            offset += n * counts[n]
        sequence += times
    rows.sort()
    return dict(zip(("key", "per", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 4).T.copy(), strict=True))


def pieces_of(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    piece = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType())]))

    def run(texts):
        made, tokens = [], []
        for ids in encode(texts, tokenizer, end_id):
            tokens.append(len(ids) // 4)
            made.append([{"start": s // 4, "length": min(len(ids) - s, 4 * capacity) // 4, "crc": zlib.crc32(ids[s : s + 4 * capacity])} for s in range(0, len(ids), 4 * capacity)])
        return [tokens, made]

    cut = add_columns(docs.select("doc_id", F.col(text).alias("text")), ["text"], [T.StructField("doc_tokens", T.LongType()), T.StructField("p", piece)], run)
    return cut.select("doc_id", "doc_tokens", F.explode("p").alias("p")).select("doc_id", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), "doc_tokens")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences hold at most `capacity` ids."""
    pieces = stored(pieces_of(docs, tokenizer, text, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    held = docs.sparkSession.sparkContext.broadcast(places(plan_fillings(histogram, capacity)))
    spread = max(64, sum(histogram.values()) // 20_000)
    order = ranked(pieces, F.col("length"), [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")], "_rank", spread)

    def place(lengths, ranks):
        p, n, r = held.value, np.array(lengths, dtype=np.int64), np.array(ranks, dtype=np.int64)
        at = np.searchsorted(p["key"], (n << 44) + r, "right") - 1
        r = r - (p["key"][at] & ((1 << 44) - 1))
        return [(p["sequence"][at] + r // p["per"][at]).tolist(), (p["offset"][at] + r % p["per"][at] * n).tolist()]

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return add_columns(order, ["length", "_rank"], fields, place).drop("_rank")
