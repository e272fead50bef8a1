"""SimHash fingerprints with DataFrame functions only.

Terms are shingles of five lower-cased words, weighted by how often they occur; each term's hash votes on 64 signed
bits. Votes are added in eight longs of eight 8-bit counters per run of 127 terms, so no row needs 64 sums per term.

Near documents are those of a shingle similarity (Jaccard) of `SIMILAR`. Of two such texts 15 % of the bits differ, ten of
64, which many unrelated fingerprints of a large table do as well; so 64 more bits are voted on for the search. The 128
bits are cut into `BLOCKS` blocks; if two fingerprints differ in at most `NEAR` bits, some block of them differs in at most
`ERRORS`. So there is a table for each block in which that block stands first, as the key: every fingerprint is in each of
the tables once, an asked one is looked up with its block and with all blocks that differ from it in at most ERRORS bits,
and what is found is counted in the first table that finds it. That gives all fingerprints within NEAR and no other; of
the pairs at exactly SIMILAR it is `radius_recall` of them (99 %), above it more.

Defined results: null texts count as empty; texts of under five words are one term, the empty text too; equal texts
have equal fingerprints. The next document is that of the next greater doc_id (of repeated ids the least text), after
the last the first; a row without doc_id has no next one and nothing takes the place of its last quarter.
"""

from __future__ import annotations

import json
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WORDS, BITS, RUN = 5, 64, 127
_LANES = 0x0101010101010101
SIMILAR = 0.8
BLOCKS, ERRORS = 10, 2
#: The greatest radius at which one of the blocks differs in no more than ERRORS bits.
NEAR = BLOCKS * (ERRORS + 1) - 1
#: Ids of a range in which neighbours are found, and ranges at most.
IDS_A_RANGE, RANGES = 250_000, 4096


def radius_recall(similarity: float, bits: int, radius: int) -> float:
    """The share of the pairs of this Jaccard similarity that differ in at most `radius` bits; two sets of one size have the
    cosine 2 J / (1 + J), and a bit differs with the probability angle / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return sum(math.comb(bits, r) * p**r * (1 - p) ** (bits - r) for r in range(radius + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, text: Column, name: str, more: str | None = None) -> DataFrame:
    """df plus the 64-bit fingerprint (long) of `text`, and in `more` 64 further bits from other hashes of its terms."""
    words = F.transform(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    df = df.withColumn("_w", words)
    terms = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WORDS)]))
    df = df.withColumn("_t", terms)
    for seed, column in enumerate([name, more] if more else [name]):
        if seed:
            df = df.withColumn("_t", F.transform("_t", lambda t: F.xxhash64(t, F.lit(1))))
        df = _with_bits(df, column)
    return df.drop("_w", "_t", "_r", "_n")


def _with_bits(df: DataFrame, name: str) -> DataFrame:
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{k}") for k in range(8)])
    add = lambda s, h: F.struct(*[(s[f"s{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"s{k}") for k in range(8)])
    runs = F.transform(F.sequence(F.lit(0), ((F.size("_t") - 1) / RUN).cast("int")), lambda c: F.aggregate(F.slice("_t", c * RUN + 1, RUN), zero, add))
    df = df.withColumn("_r", runs).withColumn("_n", F.size("_t"))
    bit = None
    for b in range(BITS):
        votes = F.aggregate("_r", F.lit(0), _counter(b))
        x = F.when(votes * 2 > F.col("_n"), F.lit(_signed(1 << b)).cast("long")).otherwise(F.lit(0).cast("long"))
        bit = x if bit is None else bit.bitwiseOR(x)
    return df.withColumn(name, bit)


def _counter(bit: int):
    return lambda n, r: n + F.shiftrightunsigned(r[f"s{bit % 8}"], bit - bit % 8).bitwiseAND(F.lit(255)).cast("int")


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, the first after the last. Neighbours are found in ranges of
    about equally many ids, however thinly these are spread; the firsts of the ranges, a row each, make the links between
    them."""
    ids = ids.where("doc_id IS NOT NULL").select("doc_id").distinct()
    n, ends = ids.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [k / 64 for k in range(1, 64)], 2000)).head()
    if n > 64 * IDS_A_RANGE:
        ranges = min(RANGES, -(-n // IDS_A_RANGE))
        ends = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).head()[0]
    place = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in sorted(set(ends or []))]).cast("array<long>"), lambda e: e <= F.col("doc_id")))
    ranged = ids.withColumn("_a", place)
    inside = ranged.withColumn("_x", F.lead("doc_id").over(Window.partitionBy("_a").orderBy("doc_id")))
    firsts = ranged.groupBy("_a").agg(F.min("doc_id").alias("_f")).agg(F.array_sort(F.collect_list(F.struct("_a", "_f"))).alias("_s"))
    # the range behind each; a row a range
    links = firsts.select(F.explode(F.transform("_s", lambda x, k: F.struct(x["_a"].alias("_b"), F.coalesce(F.get("_s", k + 1), F.get("_s", F.lit(0)))["_f"].alias("_y")))).alias("l")).select("l.*")
    return inside.join(links, F.col("_a") == F.col("_b")).select("doc_id", F.coalesce("_x", "_y").alias("next_id"))


def block_masks(bits: int = 2 * BITS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(mask of the first long, mask of the second) of each block of the bits."""
    edges = [k * bits // blocks for k in range(blocks + 1)]
    whole = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    return [(m & ((1 << BITS) - 1), m >> BITS) for m in whole]


def probes(errors: int = ERRORS) -> list[dict[str, int]]:
    """For each block every change of at most `errors` of its bits: block i, its masks ma and mb, the changes xa and xb."""
    out = []
    for i, (ma, mb) in enumerate(block_masks()):
        own = [(1 << b, 0) for b in range(BITS) if ma >> b & 1] + [(0, 1 << b) for b in range(BITS) if mb >> b & 1]
        for n in range(errors + 1):
            for some in combinations(own, n):
                out.append({"i": i, "ma": _signed(ma), "mb": _signed(mb), "xa": _signed(sum(a for a, _ in some)), "xb": _signed(sum(b for _, b in some))})
    return out


def count_near(index: DataFrame, queries: DataFrame, a: str = "fp", b: str = "fp_more") -> DataFrame:
    """index: distinct fingerprints (two longs), n; queries: distinct fingerprints. For each query n_found, the sum of n over
    all fingerprints that differ from it in at most NEAR bits."""

    def table(rows: list[dict]) -> Column:
        return F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<i:int,ma:bigint,mb:bigint,xa:bigint,xb:bigint>>"))

    key = lambda x, y: F.xxhash64("m.i", x.bitwiseAND(F.col("m.ma")), y.bitwiseAND(F.col("m.mb")))
    every = index.select(a, b, "n", table(probes(0)).alias("m")).select(F.col(a).alias("_xa"), F.col(b).alias("_xb"), "n", key(F.col(a), F.col(b)).alias("_xk"))
    asked = queries.select(a, b, table(probes()).alias("m")).select(a, b, F.col("m.i").alias("_i"), key(F.col(a).bitwiseXOR(F.col("m.xa")), F.col(b).bitwiseXOR(F.col("m.xb"))).alias("_k"))
    da, db = F.col(a).bitwiseXOR(F.col("_xa")), F.col(b).bitwiseXOR(F.col("_xb"))
    in_block = lambda ma, mb: sum([F.bit_count(d.bitwiseAND(F.lit(_signed(m)).cast("long"))) for d, m in ((da, ma), (db, mb)) if m], F.lit(0))
    first = F.coalesce(*[F.when(in_block(ma, mb) <= ERRORS, F.lit(i)) for i, (ma, mb) in enumerate(block_masks())])
    # Spark takes a table that an explode has multiplied for as small as it was
    pairs = asked.hint("merge").join(every, (F.col("_k") == F.col("_xk")) & (F.bit_count(da) + F.bit_count(db) <= NEAR) & (first == F.col("_i")))
    return pairs.groupBy(a, b).agg(F.sum("n").alias("n_found"))


def fingerprints(docs: DataFrame, query_step: int = 50) -> DataFrame:
    """docs: doc_id, text. One row per document: its fingerprint and that of its edited text (the last quarter replaced
    by the beginning of the next document), their likeness, the likeness to the next document, and for each doc_id
    divisible by `query_step` how many other documents have a 128-bit fingerprint within NEAR."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    sizes = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(quarter).alias("k"))
    after = next_ids(docs.select("doc_id"))
    wanted = sizes.join(after, "doc_id").select(F.col("doc_id").alias("_prev"), "k", F.col("next_id").alias("doc_id"))
    # both joins are on doc_id alone, so the texts are dealt out once and the exchange is used twice
    heads = base.join(wanted, "doc_id").select("_prev", F.expr("left(text, k)").alias("head"), F.col("doc_id").alias("next_id")).groupBy("_prev").agg(F.min("head").alias("head"), F.min("next_id").alias("next_id"))
    known = base.where("doc_id IS NOT NULL").join(heads, F.col("doc_id") == F.col("_prev"), "left")
    nameless = base.where("doc_id IS NULL").select("*", F.lit(None).cast("long").alias("_prev"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("long").alias("next_id"))
    joined = known.unionByName(nameless).withColumn("n_chars", F.length("text")).withColumn("_k", F.floor(F.col("n_chars") / 4).cast("int"))
    joined = joined.select("doc_id", "next_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.concat(F.expr("left(text, n_chars - _k)"), F.coalesce(F.expr("left(head, _k)"), F.lit(""))).alias("edited"))
    made = with_fingerprint(joined.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "edited_fp").drop("edited")
    made = stored(with_fingerprint(made, F.col("text"), "fp", "fp_more").drop("text"), "fingerprints")
    following = made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    index = made.groupBy("fp", "fp_more").agg(F.count(F.lit(1)).alias("n"))
    asked = made.where(F.col("doc_id") % query_step == 0).select("fp", "fp_more").distinct()
    near = count_near(index, asked).withColumn("is_query", F.lit(True))
    out = made.withColumn("is_query", F.when(F.col("doc_id") % query_step == 0, True)).join(following, "next_id", "left").join(near, ["fp", "fp_more", "is_query"], "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), (F.col("n_found") - 1).alias("n_near")
    )
