"""The text operators against brute force on small rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import chat, components, decontaminate, fm_dedup, jaccard_join, packing, secret_scan, simhash, suffix_dedup, suffix_tree_lm, toxicity

SCHEMA = "doc_id long, text string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t) for i, t in enumerate(texts)], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def word_text(rng, n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


# ---- secret scan ---------------------------------------------------------------------------------------------------


def test_secret_base_spans():
    text = 'x password=abcdefgh1 TOKEN : "short" api-key=abcdefghi AKIA' + "A1" * 8 + " " + "0a" * 16 + "g ſecret=abcdefghij"
    kinds = [(k, text[s:e]) for k, s, e, *_ in secret_scan.base_spans(text)]
    assert kinds == [("assign", "password=abcdefgh1"), ("access", "AKIA" + "A1" * 8), ("hex", "0a" * 16)]


def test_secret_propagation():
    text = 'part = "Zx91kfQw"\nother = "plain words here"\nDB_PASSWORD = part + "7711aaZZ"\n{"authToken": "q8Zr2LmN4x"}\nsecret_url = "${part}/v1x9"\npassword = "changeme"'
    found = {text[s:e]: name for k, s, e, name, _ in secret_scan.lexed_spans(text)}
    assert found["Zx91kfQw"] in ("DB_PASSWORD", "secret_url") and "7711aaZZ" in found and found["q8Zr2LmN4x"] == "authToken"
    assert "changeme" not in found and "plain words here" not in found


def test_secret_lexing():
    text = (
        'db:\n  credentials:\n    value: "Zx91kfQw77aa"\n  note: "Zx91kfQw77ab"\n'  # nested keys by indentation
        'tokens = ["q8Zr2LmN4x1", "q8Zr2LmN4x2"]\n'  # items of a list
        'API_KEY = os.getenv("NAME", "k8Zr2LmN4x3")\n'  # arguments of a call
        '# secret = "c8Zr2LmN4x4"\n'  # a comment
        'url = "see password: not here"\n'  # no assignment within a string
        'function f() { inner = "n8Zr2LmN4x5"; }\nAUTH_SECRET = inner\n'  # constants end with their braces
        'private_key = """\nMIIEvgIBADANBg7kqhk\n"""\n{"oauth": {"clientSecret": "s8Zr2LmN4x6"}}\n'
    )
    found = {text[s:e].strip(): name for _, s, e, name, _ in secret_scan.lexed_spans(text)}
    assert found.pop("Zx91kfQw77aa") == "db.credentials.value" and "Zx91kfQw77ab" not in found
    assert {"q8Zr2LmN4x1", "q8Zr2LmN4x2", "k8Zr2LmN4x3", "c8Zr2LmN4x4", "s8Zr2LmN4x6"} <= set(found)
    assert "n8Zr2LmN4x5" not in found and not any("not here" in f for f in found)


@pytest.mark.parametrize("seed", range(4))
def test_secret_base_columns_by_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    bits = ["password", "PassWD", "secret", "TOKEN", "api_key", "apikey", "api-key", "ſecret", '"', "'", " ", "  ", "\t", ":", "=", "abcdefgh", "A1b2", "=", ".", "é", "AKIA", "AKIA" + "Z9" * 6, "Z9", "0a1b2c3d", "f" * 31, "G", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]

    def assign(t):
        """Leftmost matches by a hand-written scan."""
        low, at, out = "".join(c.lower() if c.isascii() else c for c in t), 0, []
        value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
        while at < len(t):
            for n in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if not low.startswith(n, at):
                    continue
                k = at + len(n)
                for optional in (1, 0):  # the quotes may be there or not; blanks are all taken
                    j = k + 1 if optional and t[k : k + 1] in ('"', "'") and k < len(t) else k
                    while t[j : j + 1] == " ":
                        j += 1
                    if j < len(t) and t[j] in ":=":
                        break
                else:
                    continue
                j += 1
                while t[j : j + 1] == " ":
                    j += 1
                j += t[j : j + 1] in ('"', "'") and j < len(t)
                e = j
                while e < len(t) and t[e] in value:
                    e += 1
                if e > j:
                    if e - j >= 8:
                        out.append(("assign", at, e))
                    at = e - 1
                    break
            at += 1
        return out

    def runs(t, kind, chars, start, least):
        at, out = 0, []
        while at < len(t):
            if t.startswith(start, at) and t[at] in chars:
                e = at + len(start)
                while e < len(t) and t[e] in chars:
                    e += 1
                if e - at >= least and e > at + len(start):
                    out.append((kind, at, e))
                at = max(e, at + 1)
            else:
                at += 1
        return out

    got = rows(secret_scan.digest(secret_scan.scan_secrets(frame(spark, texts))))
    for i, t in enumerate(texts):
        spans = assign(t) + runs(t, "access", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), "AKIA", 16) + runs(t, "hex", set("0123456789abcdef"), "", 32)
        spans.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")], repr(t)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))


def test_secret_of_any_length():
    rng = np.random.default_rng(16)
    key = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789+/"), 5000))
    text = f'signing = "{key}"\nprivate_key = "{key[::-1]}"\nAUTH_SECRET = signing\npassword = "{"x" * 5000}"\n'
    found = {text[s:e]: name for _, s, e, name, _ in secret_scan.lexed_spans(text)}
    assert found == {key: "AUTH_SECRET", key[::-1]: "private_key"}
    pieces = [f"p{k}Q{k * 7}" for k in range(100)]
    text = "db_password = " + " + ".join(f'"{p}"' for p in pieces)
    assert [text[s:e] for _, s, e, *_ in secret_scan.all_spans(text)] == pieces


def test_secret_chains_stay_linear():
    doublings = 'a0 = "Zx91kfQw"\n' + "".join(f"a{k + 1} = a{k} + a{k}\n" for k in range(300)) + "password = a300"
    assert [doublings[s:e] for _, s, e, *_ in secret_scan.lexed_spans(doublings)] == ["Zx91kfQw"]
    chain = 'secret0 = "Zx91kfQw"\n' + "".join(f'secret{k + 1} = secret{k} + "y{k}"\n' for k in range(20_000))
    assert len(secret_scan.lexed_spans(chain)) == 20_001


def test_secret_table(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "é password=abcdefgh1", "c"), (3, "é password=abcdefgh1", "c"), (None, "token=" + "x" * 200_000, "d")], "doc_id long, text string, secret_spans string")
    got = secret_scan.digest(secret_scan.scan_secrets(docs)).collect()
    assert len(got) == 5 and sorted(r["n_assign"] for r in got) == [0, 0, 1, 1, 1]
    one = next(r for r in got if r["doc_id"] == 3)
    assert one["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 3").head()["text"] == "é [SECRET]"
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1 << 25, 600])
def test_contamination(spark, size):
    rng = np.random.default_rng(1)
    items = [word_text(rng, 30), "Short ONE, item!", None, "", word_text(rng, 12)]
    w = items[0].split()
    docs = ["a b " + " , ".join(w[3:20]) + " z", "x short-one item y short one", None, "", items[4] + " . " + items[0], word_text(rng, 3000), "Été " + items[4].upper()]
    bench = spark.createDataFrame([(i * 7, t) for i, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, docs), bench, automaton_bytes=size)
    got = rows(decontaminate.digest(found))
    windows = {}
    for i, t in enumerate(items):
        x = decontaminate.words_of(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            windows.setdefault(tuple(x[k : k + 10]), set()).add(str(i * 7))
    for d, t in enumerate(docs):
        x, hit, ids = decontaminate.words_of(t), set(), set()
        for win, of in windows.items():
            for k in range(len(x) - len(win) + 1):
                if tuple(x[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids |= of
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(x), len(hit), len(ids), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    span = rows(found)[6]["hit_spans"][0]
    assert docs[6][span["start"] : span["end"]] == items[4].upper()
    kept = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 5} and kept.columns == ["doc_id", "text"]


# ---- packing -------------------------------------------------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(2)
    texts = [word_text(rng, n) for n in (1, 5, 40, 900, 2500)] + [None, "", "It's, ok...\t<|endoftext|> Été!! İ ﬁ", "same text."] + ["same text."] * 30
    got = packing.pack(frame(spark, texts), path).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array((whole.encode(t, add_special_tokens=False).ids if t else []) + [2], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    assert sum(sum(n for _, n in x) < 4096 for x in by.values()) <= 2
    assert packing.pack(frame(spark, ["a"]).limit(0), path).count() == 0


def test_best_fill_is_best():
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(60):
        left = {int(n): int(rng.integers(1, 4)) for n in rng.integers(3, 30, 5)}
        room = int(rng.integers(5, 70))
        best = max(s for c in itertools.product(*[range(k + 1) for k in left.values()]) if (s := sum(a * n for a, n in zip(c, left, strict=True))) <= room)
        got = packing.best_fill(left, sorted(left, reverse=True), room)
        assert sum(n * c for n, c in got.items()) == best and all(c <= left[n] for n, c in got.items())


# ---- near copies ---------------------------------------------------------------------------------------------------


def test_jaccard_classes(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        base = word_text(rng, 120, 5000).split()
        texts.append(" ".join(base))
        for k in range(int(rng.integers(0, 4))):
            edited = list(base)
            for at in rng.integers(0, 120, k + 1):
                edited[at] = f"x{rng.integers(0, 999)}"
            texts.append(" ".join(edited))
    texts += [texts[0], "", None, "one two", "One, two!", word_text(rng, 5000)]
    got = rows(jaccard_join.near_classes(frame(spark, texts), block=4))
    sets = [frozenset(s.tolist()) for s in jaccard_join.shingle_sets(texts)]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in texts]
    for a in range(len(texts)):
        for b in range(a):
            same = (texts[a] or "") == (texts[b] or "")
            if same or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(top(a), top(b))] = min(top(a), top(b))
                if not same:
                    links[a].add(texts[b])
                    links[b].add(texts[a])
    for i in range(len(texts)):
        assert (got[i]["class_id"], got[i]["n_links"]) == (top(i), len(links[i]))
    kept = jaccard_join.drop_near_copies(frame(spark, texts).unionByName(frame(spark, texts[:1])))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({top(i) for i in range(len(texts))})
    assert jaccard_join.near_classes(frame(spark, ["a"]).limit(0)).count() == 0


def test_forest_finds_all_similar_pairs(spark):
    """Families of texts around 0.8 that share boilerplate of about 0.45 with all others, walked in slots."""
    rng = np.random.default_rng(12)
    shared = word_text(rng, 90, 10**6).split()
    texts = []
    for _ in range(300):
        base = shared + word_text(rng, 60, 10**6).split()
        for _ in range(3):
            edited = list(base)
            for at in rng.choice(150, int(rng.integers(1, 3)), replace=False):
                edited[at] = f"y{rng.integers(0, 10**6)}"
            texts.append(" ".join(edited))
    sets = [frozenset(x.tolist()) for x in jaccard_join.shingle_sets(texts)]
    want = {(a, b) for f in range(0, 900, 3) for a in range(f, f + 3) for b in range(a) if b >= f and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    depth = jaccard_join.prefix_length()
    signed = jaccard_join.signatures(frame(spark, texts), jaccard_join.TREES, jaccard_join.LABEL, depth).persist()
    node = {r["node"]: r["doc_id"] for r in signed.select("node", "doc_id").collect()}
    parent = list(range(900))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for slot in (jaccard_join.SLOT, 2):
        parent[:] = range(900)
        for r in jaccard_join.candidate_links(signed, jaccard_join.LABEL - depth, slot).collect():
            x, y = top(node[r["a"]]), top(node[r["b"]])
            parent[max(x, y)] = min(x, y)
        found = sum(top(a) == top(b) for a, b in want)
        assert len(want) > 400 and found >= 0.99 * len(want), (slot, found, len(want))
    signed.unpersist()


def test_prefix_reaches_recall():
    depth = jaccard_join.prefix_length()
    recall = lambda d: 1 - (1 - 0.8**d) ** jaccard_join.TREES
    assert recall(depth) >= jaccard_join.RECALL > recall(depth + 1)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 5000 + i) for i in range(80)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


# ---- fingerprints --------------------------------------------------------------------------------------------------


def test_simhash(spark):
    rng = np.random.default_rng(6)
    texts = [word_text(rng, int(n)) for n in rng.integers(1, 300, 40)] + ["", None, "é€😀 x", "same", "same"]
    ids = sorted(int(x) for x in rng.choice(100_000, len(texts), replace=False))
    got = rows(simhash.fingerprints(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA), query_step=1))
    prints = {}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        n = len(t) // 4
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(1 - bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1") / 64)
        assert r["near_next"] == pytest.approx(1 - bin(int(r["fingerprint"], 16) ^ int(got[ids[(k + 1) % len(ids)]]["fingerprint"], 16)).count("1") / 64)
        assert r["n_near"] == sum(bin(int(r["fingerprint"], 16) ^ int(x["fingerprint"], 16)).count("1") <= 3 for x in got.values()) - 1
    odd = spark.createDataFrame([(None, "a b c d e f g h"), (1, "x"), (1, "x")], SCHEMA)
    assert simhash.fingerprints(odd).count() == 3 and simhash.fingerprints(odd.limit(0)).count() == 0


def test_simhash_finds_similar_texts(spark):
    """Pairs at a shingle similarity of 0.8, against brute force over the shingles."""
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(150):
        words = [f"v{i}" for i in rng.integers(0, 5000, 300)]
        texts += [" ".join(words), " ".join(words[:-32] + [f"v{i}" for i in rng.integers(0, 5000, 32)])]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    similar = [sum(len(a & b) >= 0.8 * len(a | b) for b in shingles) - 1 for a in shingles]
    got = rows(simhash.fingerprints(frame(spark, texts), query_step=1))
    near = [got[i]["n_near"] for i in range(len(texts))]
    assert sum(similar) == 300 and max(near) == 1
    assert sum(near) >= 0.95 * sum(similar)


def simhash_by_hand(text):
    """(64 bits, 64 further bits) of a text by plain votes over its shingles."""
    import xxhash

    def chained(values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v, h)
        return h

    words = [chained([w.encode()]).to_bytes(8, "little") for w in text.lower().split()]
    terms = [chained([words[k + j] if k + j < len(words) else None for j in range(5)]) for k in range(max(1, len(words) - 4))]
    more = [chained([t.to_bytes(8, "little"), (1).to_bytes(4, "little")]) for t in terms]
    return tuple(sum(1 << b for b in range(64) if sum(1 if t >> b & 1 else -1 for t in ts) > 0) for ts in (terms, more))


def test_simhash_by_hand(spark):
    rng = np.random.default_rng(21)
    texts = [word_text(rng, int(n), 60) for n in [*rng.integers(0, 40, 20), 127, 131, 132, 260, 700]] + ["Été ÉTÉ x", "a a a a a a a"]
    df = simhash.with_fingerprint(frame(spark, texts), F.col("text"), "a", "b").select("doc_id", "a", "b").collect()
    assert {r["doc_id"]: (r["a"] % 2**64, r["b"] % 2**64) for r in df} == {k: simhash_by_hand(t) for k, t in enumerate(texts)}


def test_block_tables_find_all(spark, capsys):
    """All fingerprints within the radius and no other, against every pair."""
    rng = np.random.default_rng(7)
    word = lambda: int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
    base = [word() | word() << 64 for _ in range(40)]
    near = [b ^ sum(1 << int(k) for k in rng.choice(128, n, replace=False)) for b in base for n in (1, 5, 20, 27, 28, 29, 30, 31)]
    prints = sorted({*base, *near})
    df = spark.createDataFrame([(simhash._signed(p % 2**64), simhash._signed(p >> 64), k % 3 + 1) for k, p in enumerate(prints)], "fp long, fp_more long, n long")
    found = simhash.count_near(df, df.select("fp", "fp_more"))
    got = {(r["fp"] % 2**64) | (r["fp_more"] % 2**64) << 64: r["n_found"] for r in found.collect()}
    assert got == {a: sum(k % 3 + 1 for k, b in enumerate(prints) if (a ^ b).bit_count() <= simhash.NEAR) for a in prints}
    found.explain()
    assert "NestedLoop" not in capsys.readouterr().out
    assert simhash.radius_recall(simhash.SIMILAR, 128, simhash.NEAR) > 0.95


@pytest.mark.parametrize("ids", [[7], list(range(300)), [-(2**62), -5, 0, 3, 2**40, 2**62]])
def test_next_ids(spark, ids):
    import random

    rows_ = ids * 2 + [None]
    random.Random(1).shuffle(rows_)
    got = {r["doc_id"]: r["next_id"] for r in simhash.next_ids(spark.createDataFrame([(i,) for i in rows_], "doc_id long")).collect()}
    assert got == dict(zip(sorted(ids), sorted(ids)[1:] + [min(ids)]))


# ---- language model ------------------------------------------------------------------------------------------------


def test_suffix_tree_scores(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(["the cat", "A dog", "le chat"][int(k)] + f" w{k}{int(j) % 7}" for k, j in zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60), strict=True)) for _ in range(60)] + [None, "", "ŝtrange Word"]
    got = rows(suffix_tree_lm.score(frame(spark, texts)))
    tokens = [(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() + [None] for t in texts]
    counts = {}
    for i, t in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(w in counts for w in t), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in t))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree_lm.score(frame(spark, ["a"]).limit(0)).count() == 0


def suffix_tree_by_hand(tokens, held, depth=3):
    """log10 probabilities by the definition, from dictionaries of all contexts."""
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    words = {}
    for t in train:
        for w in t:
            words[w] = words.get(w, 0) + 1
    rare = lambda w: 0 if w is None else ord(w[-1]) % 32
    symbol = lambda w: w if words.get(w, 0) >= 2 else ("class", rare(w))
    count, own = {("class", k): 0 for k in range(64)}, {}
    for w, n in words.items():
        count[symbol(w)] = count.get(symbol(w), 0) + n
        if n < 2:
            own[symbol(w)] = own.get(symbol(w), 0) + 1
    total = sum(n + 0.5 for n in count.values())
    nexts = {}
    for t in [[symbol(w) for w in t] for t in train]:
        for i, s in enumerate(t):
            for d in range(1, min(depth, i) + 1):
                at = nexts.setdefault(tuple(t[i - d : i]), {})
                at[s] = at.get(s, 0) + 1
    states = {}

    def p(context, s):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (count[s] + 0.5) / total
        at = states[context]
        n = sum(at.values())
        return (at.get(s, 0) + len(at) * p(context[1:], s)) / (n + len(at))

    for context, at in sorted(nexts.items(), key=lambda x: len(x[0])):
        n = sum(at.values())
        if n >= 4 and sum(c * np.log(c / n / p(context[1:], s)) for s, c in at.items()) > 0.5 * len(at) * np.log(n):
            states[context] = at
    within = lambda w: 1.0 if words.get(w, 0) >= 2 else (words.get(w, 0) + 0.5) / (count[symbol(w)] + 0.5 * (own.get(symbol(w), 0) + 1))
    for context in states:  # a distribution
        assert sum(p(context, s) for s in count) == pytest.approx(1)
    return [sum(np.log10(p(tuple(symbol(x) for x in t[max(0, i - depth) : i]), symbol(w)) * within(w)) for i, w in enumerate(t)) for t in tokens], len(states)


def test_suffix_tree_by_hand(spark):
    rng = np.random.default_rng(18)
    phrases = [word_text(rng, int(n), 300) for n in rng.integers(2, 7, 60)]
    texts = [" ".join(phrases[int(k)] for k in rng.zipf(1.5, 30) % 60) + f" rare{i}x only{i}" for i in range(120)] + [None, "", "one"]
    tokens = [(t or "").split() + [None] for t in texts]
    held = [suffix_tree_lm.is_held_out(i) for i in range(len(texts))]
    want, states = suffix_tree_by_hand(tokens, held)
    got = rows(suffix_tree_lm.score(frame(spark, texts).repartition(6)))
    assert states > 100
    for i, x in enumerate(want):
        assert got[i]["score"] == pytest.approx(x, rel=1e-4)


@pytest.mark.parametrize("shards", [4, 7, 1 << 15])
def test_names_of_contexts_are_short_to_send(shards):
    """All shards number their contexts: names differ, are dealt evenly, and stand close together in each range."""
    n = 5 * shards
    got = [suffix_tree_lm.names(s, np.arange(n, dtype=np.uint32), shards) for s in (0, 1, shards - 1)]
    keys = np.sort(np.concatenate(got))
    runs = suffix_tree_lm.by_shard(keys, shards)
    assert len(np.unique(keys)) == 3 * n and keys[0] > 0 and len(runs) == shards
    assert all(b - a == 15 and keys[b - 1] - keys[a] < n for _, a, b in runs)


def test_answers_meet_parts_without_an_exchange(spark):
    scored = suffix_tree_lm.score(frame(spark, ["a b c a b c", "a b c d", None] * 9))
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 27


def test_grouped():
    x = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    for y in (x, x[:0]):
        distinct, at, number = suffix_tree_lm.grouped(y)
        assert np.array_equal(distinct, np.unique(y)) and np.array_equal(y[at], distinct) and np.array_equal(distinct[number], y)


def test_suffix_tree_grows_with_the_corpus(spark):
    """Sequences of words that are a vanishing share of the tokens are still learnt."""
    rng = np.random.default_rng(19)
    texts = [" ".join(f"s{k}w{j}" for k in part for j in range(5)) for _ in range(8) for part in rng.permutation(6000).reshape(-1, 30)]
    got = [r for r in suffix_tree_lm.score(frame(spark, texts)).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] - r["base_score"] for r in got) / n > 2


# ---- repeated passages ---------------------------------------------------------------------------------------------


def repeated_texts():
    rng = np.random.default_rng(9)
    passage = word_text(rng, 60)
    texts = [word_text(rng, 200), passage + " tail", "head " + passage, word_text(rng, 30) + " " + passage + "\n\n" + word_text(rng, 30), "la " * 90, "x " * 25, None, "", "été " * 40]
    return [*texts, texts[0], "b " + texts[0][40:700] + " c", word_text(rng, 19), passage + " " + passage]


def test_word_repeats(spark):
    texts = repeated_texts()
    got = rows(fm_dedup.remove_repeats(frame(spark, texts)))
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(split):
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, w in enumerate(split):
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (i, p):
                gone.update(range(p, p + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert fm_dedup.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def test_byte_repeats(spark):
    texts = repeated_texts()
    got = rows(suffix_dedup.remove_repeats(frame(spark, texts)))
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, t in enumerate(raw):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    twice = frame(spark, ["z" * 80]).unionByName(frame(spark, ["z" * 80]))
    assert [r["n_removed"] for r in suffix_dedup.remove_repeats(twice).collect()] == [0, 0]


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0 if seed % 2 else 1, 4, 300).astype(np.uint64)
    s[-1] = 0
    key = rng.integers(0, 150, 300)
    for k in range(1, 300):  # places grow within a content
        key[k] = key[k - 1] + 1 if s[k - 1] else key[k]
    got = fm_dedup.matching_statistics(fm_dedup.FMIndex(s, 301), s, key, 4, 9)
    for e in range(1, 301):
        best = 0
        for k in range(4, 10):
            if e >= k and s[e - k : e].all():
                mine = s[e - k : e]
                if any((s[p : p + k] == mine).all() and key[p] < key[e - k] for p in range(301 - k)):
                    best = k
        assert best == (got[e] if got[e] >= 4 else 0)


@pytest.mark.parametrize("window", [1, 4, 5, 16, 20])
def test_statistics_begin_at_the_ranked_width(window):
    """Passages of all lengths around the window: the search begins at the greatest ranked width and finds the same."""
    rng = np.random.default_rng(window)
    base = rng.integers(1, 9, 60).astype(np.uint64)
    s = np.concatenate([np.append(base[a : a + n], 0) for a in range(0, 30, 3) for n in (1, window - 1, window, window + 1, 30)]).astype(np.uint64)
    key, depth = np.arange(len(s)) // 2, window + 6
    index = fm_dedup.FMIndex(s, 31, window)
    assert index.head == 1 << (window.bit_length() - 1)
    one, got = (fm_dedup.matching_statistics(i, s, key, window, depth) for i in (fm_dedup.FMIndex(s, 31), index))
    assert np.array_equal(np.where(one >= window, one, 0), np.where(got >= window, got, 0)) and (got >= window).sum() > 20
    for p in range(0, len(s) - index.head, 7):
        same = [q for q in range(len(s)) if np.array_equal(s[q : q + index.head], s[p : p + index.head])]
        if s[p : p + index.head].all():
            assert sorted(index.order[index.begin[p] : index.end[p]]) == same


def test_words_with_one_hash_are_told_apart():
    raw = b"aa bb aa cc"
    begin, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    assert fm_dedup.word_numbers(raw, begin, end, np.zeros(4, np.uint64)).tolist() == [1, 2, 1, 3]


@pytest.mark.parametrize("seed", range(8))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(97, 99 + 8 * (seed % 3), 60).astype(np.uint8))
    contents, ids = [], []
    for k in range(12):
        a, b = sorted(rng.integers(0, 60, 2))
        contents.append(base[a:b] + bytes(rng.integers(97, 100, 9).astype(np.uint8)) + base[b // 2 :][:20])
        ids.append(int(rng.integers(0, 6)))
    order = sorted(range(12), key=lambda k: ids[k])
    contents, ids = [contents[k] for k in order if len(contents[k]) >= 10], np.array([ids[k] for k in order if len(contents[k]) >= 10])
    got = {(int(c), int(p)): (int(n), int(s)) for c, p, n, s in zip(*suffix_dedup.longest_previous(contents, ids, 10, 26), strict=True)}
    for c, text in enumerate(contents):
        for p in range(len(text) - 9):
            best = 0
            for o in range(c):
                if ids[o] < ids[c]:
                    while best < 26 and p + best < len(text) and text[p : p + best + 1] in contents[o]:
                        best += 1
            assert best == got.get((c, p), (best, 0))[0] and (best >= 10) == ((c, p) in got)
            if best >= 10:
                assert text[p : p + best] in contents[got[c, p][1]] and ids[got[c, p][1]] < ids[c]


def test_previous_smaller():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 333):
        x = rng.integers(0, 9, n)
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
        assert suffix_dedup.previous_smaller(x).tolist() == want


@pytest.mark.parametrize("seed", range(3))
def test_packing_ids_are_the_tokenizers(seed):
    import random

    from tokenizers import Tokenizer

    from flowsieve.llm.queries import tokenizer_path

    whole, rng = Tokenizer.from_file(tokenizer_path()), random.Random(seed)
    odd = list("abcXYZ éÉñİıßŒœĀǅΣσςאب日本𝔘İ-.\"'\n\t1٣½₂ªµﬁKÅŉẞ😀|<>~ǰȺ𐐀Ꭰა") + ["\u0307", "\u0301", "\u030a", "'s", "'T", "'LL", "<|startoftext|>", "<|endoftext|>", *" \xa0\u3000\u200b\u2028\x85\x1c"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["İ-", "İ.", 'İ"', "", None]
    for t, ids in zip(texts, packing.encode(texts, tokenizer_path()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2], repr(t)


# ---- columns of their own ------------------------------------------------------------------------------------------

EXTRA = "doc_id long, text string, n_words string, `a.b` int, p_toxic int, _n long, _id long, node long, class_id long, hit_items int, secret_spans int, n_chars int, k0 int"


def stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    return [(name, lambda docs, stage=stage: stage(spark, docs, sf)) for name, stage in corpus_pipeline.STAGES]


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_columns_nulls_repeats(spark, at):
    row = lambda i, t: (i, t, "own", 1, 2, 3, 4, 5, 6, 7, 8, len(t or ""), 9)
    long = " ".join(f"word{k}" for k in range(30_000))
    texts = [(1, None), (2, ""), (3, "a quiet sentence about gardens and rivers"), (3, "a quiet sentence about gardens and rivers"), (None, "nothing to see here at all"), (4, long), (5, "  \n\t ")]
    docs = spark.createDataFrame([row(i, t) for i, t in texts], EXTRA)
    name, stage = stages(spark)[at]
    out = stage(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    want = [row(i, t) for i, t in texts]
    if name == "ngram_jaccard_join":  # the texts without words are not copies of one another: null and "" are one text
        want = [row(1, None), *want[2:3], *want[4:]]
    key = lambda r: str(r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert stage(docs.limit(0)).count() == 0


def test_packing_takes_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, "ab", 3), (1, "ab", 3)], "doc_id long, text string, `x.y` int")
    got = sorted((r["sequence_id"], r["offset"], r["length"]) for r in stages(spark)[4][1](docs).collect())
    assert [g[2] for g in sorted(got)] and sum(g[2] for g in got) == 2 * 1 + 2 * 2 and len({g[:2] for g in got}) == 4


# ---- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_chain(spark):
    rng = np.random.default_rng(11)
    texts, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        texts.append(word_text(rng, 60) + (" you foulword" + "xyz"[i % 3] if bad else ""))
        marks.append((i, int(i % 7 != 0), int(bad)))
    docs = frame(spark, [*texts, None, ""])
    found = spark.createDataFrame(marks[:300] + marks[:10], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, toxicity.category_labels(found))
    got = rows(toxicity.score(docs, chain))
    rest = range(300, 400)
    assert sum(got[i]["is_toxic"] == (i % 5 == 0) for i in rest) >= 98
    assert not got[400]["is_toxic"] and not got[401]["is_toxic"]
    assert len(chain.weights) == 2 and len(chain.weights[1]) == len(chain.weights[0]) + 1
    # rows that share an id are one row of the sample
    again = docs.unionByName(spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.lit("zzz").alias("text")))
    same = toxicity.fit_chain(again, toxicity.category_labels(found))
    assert same.vocabulary == chain.vocabulary and all(np.array_equal(a, b) for a, b in zip(same.weights, chain.weights, strict=True))
    none = toxicity.fit_chain(docs, toxicity.category_labels(found.limit(0)))
    assert toxicity.drop_toxic(docs, none).count() == 402


def test_toxicity_chain_is_fitted_in_tasks(spark, monkeypatch):
    """The driver fits nothing and holds no row's features; the chain is that of a plain loop over the folds."""
    rng = np.random.default_rng(12)
    texts = [word_text(rng, 30) + (" foulword" if i % 5 == 0 else "") + (" spam" if i % 3 == 0 else "") for i in range(300)]
    marks = [(i, int(i % 3 != 0), int(i % 5 == 0 or i % 17 == 0)) for i in range(300)]
    docs, found = frame(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    fold = np.array([r["f"] for r in found.select("doc_id", F.expr("int(pmod(xxhash64(doc_id, 7), 3))").alias("f")).orderBy("doc_id").collect()])
    labels = np.array([(int(q == 0), t) for _, q, t in marks])
    names = sorted(set().union(*map(toxicity.features_of, texts)))
    lists = [[k for k, f in enumerate(names) if f in has] for has in map(toxicity.features_of, texts)]

    def flat(at):
        return np.concatenate([[0], np.cumsum([len(lists[i]) for i in at])]), np.array([k for i in at for k in lists[i]])

    def fitted(at, k, held):
        picked = toxicity.pick_features(*flat(at), labels[at], len(names), toxicity.FEATURES)
        return picked, toxicity.fit_linear(*toxicity._only(*flat(at), picked), held[at], labels[at, k].astype(float), int(picked.sum()))

    held, weights = np.zeros((300, 0)), []
    for k in range(2):
        odds = np.zeros(300)
        for f in range(3):
            rest = np.flatnonzero(fold == f)
            picked, w = fitted(np.flatnonzero(fold != f), k, held)
            odds[rest] = toxicity.logits(*toxicity._only(*flat(rest), picked), held[rest], w)
        picked, w = fitted(np.arange(300), k, held)
        weights.append(w)
        held = np.column_stack([held, odds])

    def in_driver(*_):
        raise AssertionError("fitted in the driver")

    for name in ("fit_linear", "pick_features", "logits"):
        monkeypatch.setattr(toxicity, name, in_driver)
    chain = toxicity.fit_chain(docs, toxicity.category_labels(found))
    assert list(chain.vocabulary) == [names[i] for i in np.flatnonzero(picked)] and chain.base == [labels[:, k].mean() for k in range(2)]
    assert all(np.allclose(a, b, rtol=0, atol=1e-9) for a, b in zip(chain.weights, weights, strict=True))
    p = 1 / (1 + np.exp(-held[:, -1]))
    f_half = lambda said: 1.25 * (said & (labels[:, 1] > 0)).sum() / (said.sum() + 0.25 * labels[:, 1].sum())
    assert f_half(p >= chain.threshold) == max(f_half(p >= x) for x in p)


def test_toxicity_fit_expands_few_rows_at_once():
    """Beside the 4 bytes a feature of its rows, a fit holds blocks only, and blocks give what all rows at once give."""
    rng = np.random.default_rng(13)
    n, width = 8000, 3000
    starts, index = np.arange(n + 1) * 100, rng.integers(0, width, n * 100).astype(np.uint32)
    y = np.column_stack([rng.random(n) < 0.2, rng.random(n) < 0.1]).astype(int)
    tracemalloc.start()
    picked, w, odds = toxicity.fit_part(starts, index, y, np.arange(n) % 3 == 0, np.zeros((n, 0)), width, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * index.nbytes, peak
    dense = np.zeros((n, width))
    np.add.at(dense, (np.repeat(np.arange(n), 100), index), 1)
    assert np.allclose(odds, np.clip(dense[::3][:, picked] @ w[:-1] + w[-1], -12, 12), atol=1e-9)


# ---- chat ----------------------------------------------------------------------------------------------------------


def test_preferences(spark):
    said = [(0, True, 0, "user", "hi"), (0, False, 0, "user", "hi"), (0, True, 1, "assistant", "good <|end|>"), (0, False, 1, "assistant", "bad"), (0, False, 2, "user", None), (1, True, 0, "user", "alone"), (2, True, 0, "user", "x"), (2, False, 0, "user", "x"), (None, True, 0, "user", "x"), (0, True, 0, "user", "hi")]
    got = {r["pair_id"]: r for r in chat.format_preferences(spark.createDataFrame(said, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(got) == {0, 2} and got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["prompt_turns"] == 1
    assert got[0]["chosen"] == "<|assistant|>\ngood < |end|><|end|>\n"
    assert [tuple(s) for s in got[0]["rejected_mask"]] == [(0, len("<|assistant|>\nbad<|end|>\n"))]
    assert got[2]["chosen"] == "" and got[2]["rejected_mask"] == []
    long = spark.range(600).select(F.lit(1).cast("long").alias("pair_id"), (F.col("id") % 2 == 0).alias("chosen"), (F.col("id") / 2).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("t" * 3000).alias("text"))
    assert sorted(r["prompt_turns"] for r in chat.format_preferences(long).collect()) == [300]
    assert chat.format_preferences(long.withColumn("turn", F.col("turn") * 1_000_000)).count() == 1  # sparse numbers
    assert chat.format_preferences(long.limit(0)).count() == 0
    assert chat.format_preferences(long.withColumn("role", F.lit(None).cast("string"))).head()["prompt"].startswith("<||>")
