"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of at most `FRAME_UNITS` code points, each with the number of code
points before it. A cut finds its frame by that number: only the frames that hold a cut are decompressed, split and
compressed again, whole frames between cuts go into the output as they are. Digests stream the frames in the order of the
output, or of the text that is rebuilt from it; no output text is ever whole in memory.

A text is cut into prefix, middle and suffix by the hash of its document's id and written as psm or spm, or plain.

Defined results: a null text counts as empty, an empty text is plain; a null id counts as an empty one; rows are
transformed one by one, so repeated rows give equal results; an empty table gives an empty table; columns that clash with
the new ones are replaced; texts may have any length and may hold the marks (they are plain then).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, col, stored

FRAME_UNITS, LEVEL = 16_384, 3
#: Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

FRAME = T.StructType([T.StructField("start", T.LongType()), T.StructField("units", T.LongType()), T.StructField("data", T.BinaryType())])
FRAMES = T.ArrayType(FRAME)
Frames = list[dict]


def compress(pieces: Iterator[str] | list[str], start: int = 0) -> Frames:
    """Each piece as a frame of its own."""
    packer, out = zstandard.ZstdCompressor(level=LEVEL), []
    for piece in pieces:
        if piece:
            out.append({"start": start, "units": len(piece), "data": packer.compress(piece.encode())})
            start += len(piece)
    return out


def cut_frames(text: str, units: int = FRAME_UNITS) -> Frames:
    return compress([text[k : k + units] for k in range(0, len(text), units)])


def stream(frames: Frames) -> Iterator[bytes]:
    """The bytes of the frames in order, one frame at a time."""
    opener = zstandard.ZstdDecompressor()
    for f in frames:
        yield opener.decompress(f["data"])


def select(frames: Frames, start: int, end: int) -> Frames:
    """The frames of code points [start, end): those that hold a bound are cut, the others stay compressed."""
    if start >= end:
        return []
    starts = [f["start"] for f in frames]
    out: Frames = []
    for f in frames[bisect_right(starts, start) - 1 : bisect_right(starts, end - 1)]:
        a, b = max(0, start - f["start"]), min(f["units"], end - f["start"])
        out += [f] if b - a == f["units"] else compress([next(stream([f])).decode()[a:b]])
    return out


def joined(parts: list[Frames]) -> Frames:
    """Frames one behind the other, with the code points before each."""
    at, out = 0, []
    for f in (f for p in parts for f in p):
        out.append({**f, "start": at})
        at += f["units"]
    return out


def digest_of(frames: Frames) -> str:
    h = hashlib.sha256()
    for piece in stream(frames):
        h.update(piece)
    return h.hexdigest()


def transform(frames: Frames, form: str, prefix: int, middle_end: int) -> Frames:
    """The output of a text in its form: whole frames are moved, cut frames split."""
    if form == "plain":
        return frames
    mark = {m: compress([m]) for m in (PREFIX, SUFFIX, MIDDLE)}
    end = frames[-1]["start"] + frames[-1]["units"]
    p, m, s = select(frames, 0, prefix), select(frames, prefix, middle_end), select(frames, middle_end, end)
    first = [mark[PREFIX], p, mark[SUFFIX], s] if form == "psm" else [mark[SUFFIX], s, mark[PREFIX], p]
    return joined([*first, mark[MIDDLE], m])


def find_mark(frames: Frames, mark: str, start: int) -> int:
    """The place of the first mark at or behind `start`, also where it lies across frames."""
    tail = ""
    for f in frames[max(0, bisect_right([f["start"] for f in frames], start) - 1) :]:
        begin = f["start"] - len(tail)
        text = tail + next(stream([f])).decode()
        if (at := text.find(mark, max(0, start - begin))) >= 0:
            return begin + at
        tail = text[-(len(mark) - 1) :]
    raise ValueError(f"{mark} is missing")


def restore(output: Frames, form: str) -> Frames:
    """The frames of the text that an output was made of, by its marks."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, end = len(first), output[-1]["start"] + output[-1]["units"]
    b = find_mark(output, second, a)
    c = find_mark(output, MIDDLE, b + len(second))
    one, two = select(output, a, b), select(output, b + len(second), c)
    middle = select(output, c + len(MIDDLE), end)
    return joined([one, middle, two] if form == "psm" else [two, middle, one])


def frame_texts(docs: DataFrame, text: str = "text", out: str = "frames", units: int = FRAME_UNITS) -> DataFrame:
    """docs with the text as `out` instead, and its code points `n` and whether it holds a mark, `marked`."""
    fields = [T.StructField(out, FRAMES), T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType())]

    def fn(texts):
        texts = [t or "" for t in texts]
        return [cut_frames(t, units) for t in texts], [len(t) for t in texts], [any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts]

    framed = add_columns(docs, [text], fields, fn)
    return framed.select(*[col(c) for c in framed.columns if c.lower() != text.lower() or c == out])


def texts_of(framed: DataFrame, frames: str, out: str = "text") -> DataFrame:
    """framed plus the text of its frames."""
    return add_columns(framed, [frames], [T.StructField(out, T.StringType())], lambda rows: [[b"".join(stream(f or [])).decode() for f in rows]])


def plan(framed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Plus form, prefix_chars and middle_chars (both null if plain) by the hash of the id."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(col(doc_id).cast("string"), F.lit(""))), 256)

    def group(k: int) -> Column:
        return F.conv(F.substring(key, 8 * k - 7, 8), 16, 10).cast("long")

    a, b = group(1) % (F.col("n") + 1), group(2) % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (group(3) % 100 >= PLAIN_FROM), "plain").when(group(4) % 100 < SPM_BELOW, "spm").otherwise("psm")
    told = framed.withColumn("form", form)
    return told.withColumn("prefix_chars", F.when(F.col("form") != "plain", F.least(a, b))).withColumn("middle_chars", F.when(F.col("form") != "plain", F.greatest(a, b) - F.least(a, b)))


def fill_in_middle(planned: DataFrame, frames: str = "frames", out: str = "output_frames", keep_frames: bool = True) -> DataFrame:
    """Plus the output's frames (if kept), its sha256, and that of the text rebuilt from output and form."""
    fields = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]

    def fn(held, forms, prefixes, middles):
        made = [transform(f or [], form, p or 0, (p or 0) + (m or 0)) for f, form, p, m in zip(held, forms, prefixes, middles, strict=True)]
        digests = [digest_of(f) for f in made], [digest_of(restore(f, form)) for f, form in zip(made, forms, strict=True)]
        return (*digests, made) if keep_frames else digests

    return add_columns(planned, [frames, "form", "prefix_chars", "middle_chars"], [*fields, *([T.StructField(out, FRAMES)] if keep_frames else [])], fn)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document of docs (doc_id, text), by way of its stored frames."""
    framed = stored(frame_texts(docs.select("doc_id", "text")), "frames")
    return fill_in_middle(plan(framed), keep_frames=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS m,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, m + 1) || '<M>' || substr(t, p + 1, m - p)
    ELSE '<S>' || substr(t, m + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, m - p) END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""
