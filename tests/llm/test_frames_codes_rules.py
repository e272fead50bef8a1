"""Fill-in-middle frames, vector codes and quality rules against brute force: nulls, empty and long texts, ties, repeats,
clashing columns, empty tables."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import fim_frames, quality_rules, vector_codes

SCHEMA = "doc_id long, text string"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA)


def against_sql(df, con, sql):
    names = sorted(df.columns)
    cur = con.execute(sql)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    assert len(at) == len(cur.description)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, (tuple(r[k] for k in at) for r in cur.fetchall())))


def documents(con, texts):
    con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))


# ---- fill-in-middle ------------------------------------------------------------------------------------------------

TEXTS = [None, "", "a", "ab", "é𝄞漢" * 50, "x" * 50_000, "<P>", "no <M> here", "<<S", "S><M", "line\n" * 9000, "日本語のテキスト" * 5000, *[f"text number {k} " * (k % 40) for k in range(200)]]


@pytest.mark.parametrize("units", [1, 3, 64, fim_frames.FRAME_UNITS])
def test_frames_are_seekable(units):
    rng = random.Random(units)
    for text in ("", "a", "<S", "é𝄞漢字" * 40, "ab<S<M>c" * 30):
        frames = fim_frames.cut_frames(text, units)
        assert b"".join(fim_frames.stream(frames)).decode() == text and all(f["units"] <= units for f in frames)
        for _ in range(20):
            a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
            assert b"".join(fim_frames.stream(fim_frames.select(frames, a, b))).decode() == text[a:b]
            if not any(m in text for m in ("<P>", "<S>", "<M>")) and text:
                for form, want in (("psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"), ("spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"), ("plain", text)):
                    out = fim_frames.transform(frames, form, a, b)
                    assert b"".join(fim_frames.stream(out)).decode() == want and [f["start"] for f in out] == list(np.cumsum([0] + [f["units"] for f in out])[:-1])
                    assert b"".join(fim_frames.stream(fim_frames.restore(out, form))).decode() == text


def test_only_cut_frames_are_opened(monkeypatch):
    frames = fim_frames.cut_frames("abcdefgh" * 1000, 100)
    opened = []
    whole = fim_frames.stream
    monkeypatch.setattr(fim_frames, "stream", lambda fs: (opened.extend(fs), whole(fs))[1])
    out = fim_frames.transform(frames, "psm", 1234, 5678)
    assert {f["start"] for f in opened} == {1200, 5600}
    assert sum(f["data"] is g["data"] for f in out for g in frames) == len(frames) - 2


def test_fill_in_middle_against_sql(spark):
    con = duckdb.connect()
    documents(con, TEXTS)
    got = fim_frames.digest(frame(spark, TEXTS))
    against_sql(got, con, fim_frames.ORACLE)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert all(r["restored_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest() for r in got.collect())


def test_fill_in_middle_takes_odd_rows(spark):
    docs = spark.createDataFrame([(None, "abc " * 20, 1, "x"), (7, None, 2, "y"), (7, "same", 3, None), (7, "same", 3, None)], "doc_id long, text string, N long, `frames.x` string")
    framed = fim_frames.frame_texts(docs)
    assert framed.columns == ["doc_id", "frames.x", "frames", "n", "marked"]
    made = fim_frames.texts_of(fim_frames.fill_in_middle(fim_frames.plan(framed)), "output_frames", "made").collect()
    assert len(made) == 4 and all(r["output_sha256"] == hashlib.sha256(r["made"].encode()).hexdigest() for r in made)
    assert fim_frames.digest(docs.limit(0)).count() == 0


# ---- vector codes --------------------------------------------------------------------------------------------------


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """(codes and errors by row, codebooks) of rows (id, vector): plain loops over every part and entry."""
    kept = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]] for p in range(parts)]
            out.append([(f.index(min(f)), min(f)) for f in far])
        return out

    for _ in range(rounds):
        told = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                members = [c[p] for c, t in zip(cut, told) if t[p][0] == e]
                if members:
                    books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    return [("".join(f"{e:02x}" for e, _ in t), sum(d for _, d in t)) for t in assign()], books


@pytest.mark.parametrize(("n", "entries", "spread"), [(300, 256, 1.0), (40, 256, 0.02), (500, 16, 2e4)])
def test_codes_by_brute_force(spark, n, entries, spread):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(12, 8)) * spread
    vectors = [list(map(float, centres[k % 12] + rng.normal(size=8) * spread / 4)) for k in range(n)]
    vectors[5:9] = [vectors[4]] * 4  # ties
    vectors[n // 2 :] = [vectors[3] if k % 3 == 0 else v for k, v in enumerate(vectors[n // 2 :])]  # copies
    rows = [(None if k == 17 else (k // 2 if k < 20 else k), v) for k, v in enumerate(vectors)]
    kept = vector_codes.prepared(spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, row int").repartition(5))
    width, first = vector_codes.seeds(kept, entries=entries)
    assert width == 8 and first.shape == (4, min(entries, n), 2)
    books = vector_codes.train(kept, first)
    want, want_books = codes_by_hand(rows, entries=entries)
    assert books.tolist() == want_books
    got = {r["row"]: (r["code"], r["error"]) for r in vector_codes.encode(kept, books, ["vec_id", "row"]).collect()}
    assert [got[k] for k in range(n)] == want


def test_only_changed_parts_migrate(spark):
    """After the first round a member is sent again only if its entry changes, and nothing is lost or repeated."""
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(k, list(map(float, rng.normal(size=8)))) for k in range(400)], "vec_id long, embedding array<double>")
    kept = vector_codes.prepared(table)
    _, books = vector_codes.seeds(kept, entries=8)
    members = vector_codes.placed(kept, books, "vec_id", 4, 6)
    for _ in range(4):
        count, total = vector_codes.sums(members, books.shape)
        assert count.sum() == 1600
        new = vector_codes.renewed(books, count, total)
        old = Counter((int(p), int(e)) for _, b in members.collect() for p, e in zip(b[0], b[1]))
        assert {(p, e): c for (p, e), c in old.items()} == {(p, e): int(count[p, e]) for p, e in np.argwhere(count)}
        members, told = vector_codes.reassigned(members, new, 6)
        changed = sum(len(b[0]) for kept_, b in told.collect() if not kept_)
        assert members.getNumPartitions() == 6 and 0 < changed < 1600
        blocks = members.glom().map(lambda rows: [b for _, b in rows]).collect()
        for at, held in enumerate(blocks):  # everyone lives with the owner of its entry
            for position, entry, salt, _ in held:
                assert (vector_codes.owner(position, entry, salt, 6) == at).all()
        books = new


def test_codes_take_odd_rows(spark):
    rows = [(1, [1.0] * 8, 0), (2, None, 0), (3, [1.0] * 7 + [None], 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, None), (6, [1.0] * 4, 0), (7, [], 0), (None, [2.0] * 8, None), (9, [1e30] * 8, None), (1, [1.0] * 8, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_codes.digest(table.withColumn("code", F.lit("mine"))).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 1), (False, 1), (False, 9), (True, 0)]
    assert all(r["error"] == 0 and r["label_error"] == 0 and len(r["code"]) == 8 for r in got)
    assert vector_codes.digest(table.limit(0)).count() == 0 and vector_codes.digest(table.where("vec_id IN (2, 3)")).count() == 0


def test_label_errors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, list(map(float, rng.normal(size=8))), [None, 1, 2, 2, 2, 2][k % 6]) for k in range(600)]
    got = vector_codes.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want, books = codes_by_hand([r[:2] for r in rows])
    totals = Counter()
    for (_, _, label), (_, error) in zip(rows, want):
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got} == {r[0]: (*w, totals[r[2]], digest) for r, w in zip(rows, want)}


# ---- quality rules -------------------------------------------------------------------------------------------------


def repeats_by_hand(words, least):
    """(covered words, longest repeat, maximal repeats as (length, times))."""
    n, places = len(words), {}
    for length in range(least, n):
        for k in range(n - length + 1):
            places.setdefault(tuple(words[k : k + length]), []).append(k)
    found = {w: at for w, at in places.items() if len(at) > 1}
    covered = {k + j for w, at in found.items() for k in at for j in range(len(w))}
    maximal = [(len(w), len(at)) for w, at in found.items() if len({words[k - 1] if k else None for k in at}) > 1 and len({words[k + len(w)] if k + len(w) < n else None for k in at}) > 1]
    return covered, max(map(len, found), default=0), sorted(maximal)


@pytest.mark.parametrize("seed", range(6))
def test_repeats_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(["a", "bb", "é", "漢字"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 36))) for _ in range(rng.randint(1, 6))]
        least = rng.randint(2, 5)
        for text, got in zip(texts, quality_rules._judged(texts, "word", least)):
            words = text.split()
            covered, longest, maximal = repeats_by_hand(words, least)
            assert (got[0], got[4], got[5], got[6]) == (len(words), len(covered), sum(len(words[k]) for k in covered), longest)
            assert sorted((r["length"], r["times"]) for r in got[8]) == maximal
            assert {w for s in got[7] for w in text[s["start"] : s["end"]].split()} == {words[k] for k in covered} and sum(len(text[s["start"] : s["end"]].split()) for s in got[7]) == len(covered)


def test_repeats_of_code_points():
    text = "这是一个重复的句子没有空格" * 2 + "完"
    got = quality_rules._judged([text, "abc"], "char", 4)
    covered, longest, maximal = repeats_by_hand(list(text), 4)
    assert (got[0][4], got[0][6]) == (len(covered), longest) and sorted((r["length"], r["times"]) for r in got[0][8]) == maximal
    assert got[1][4] == 0


def sentences(rng, n):
    return ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(9)) for _ in range(n))


def test_quality_rules_against_sql(spark):
    rng = random.Random(3)
    clean = [sentences(rng, 40) for _ in range(30)]
    passage = sentences(rng, 6)
    texts = [
        None, "", " \n\t ", "one", "word " * 19, "\xa0".join(["no", "blank"] * 30), *clean, passage + ". " + sentences(rng, 60) + ". " + passage, " ".join(["same"] * 3000), "\n".join([clean[0]] * 4),
        *[c + "\n" + "\n".join(["a line of nine words that comes again"] * k) for k, c in enumerate(clean[:12])], "# * $ % & | < > " * 9, "x" * 30_000, clean[5] + "\r\n\r\n\x0b\x0c a b \x1c \x85 é",
    ]
    con = duckdb.connect()
    documents(con, texts)
    got = quality_rules.digest(quality_rules.judge(quality_rules.repetition(frame(spark, texts))))
    against_sql(got, con, quality_rules.ORACLE)
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[k]["kept"] for k in range(6, 36)) and not by[36]["kept"] and not by[36]["base_failed"] and by[37]["base_failed"]


def test_quality_rules_take_odd_rows(spark):
    rng = random.Random(4)
    good = sentences(rng, 30)
    docs = spark.createDataFrame([(1, good, 5, "a"), (1, good, 5, "a"), (None, None, None, None), (2, "short", 6, "b")], "doc_id long, text string, Kept long, `n.words` string")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, good, 5, "a")] * 2
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
