"""N-gram Jaccard join by a MinHash LSH forest.

Nodes are distinct texts (64-bit text hash; equal texts share one). Every tree of the forest is a prefix trie of labels,
`LABEL` minhashes each. The tries are cut where they may be: at the longest prefix that two texts at the threshold share
in some tree with the target recall; what stands alone below a cut has no partner in that tree and leaves. What is left
is sorted by label, and every trie is walked from the leaves up: at each depth the representatives of the branches that
meet are compared by 256-bit sketches and linked. A text whose sketch is as near as `ABSORB` to a representative goes no
further up, as the representative stands for it; the prefixes of the others are shortened on, down to the cut. Large
tries are walked in slots first, and the representatives of the slots meet afterwards. Within the components of the
links every pair is verified exactly on its shingle sets, in blocks, inside tasks. Pairs never become rows.

Similarity is the Jaccard index of the sets of five consecutive words (A-Z lower-cased, runs of letters, digits and
non-ASCII characters); a text of fewer words is one shingle.

Defined results: null counts as empty text; texts without words have no links, only copies; each input row, repeated
ones too, gives a row; class_id is the least doc_id of the class (null if it has none); copies counts the rows with
the same text, n_links the other texts linked to this one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, col, filtered, stored
from .components import connected_components
from .decontaminate import _FOLD
from .tokens import BLANKS, grams, joined, mix, words

WORDS, THRESHOLD, TREES, LABEL, RECALL = 5, 0.8, 32, 10, 0.999
#: A pair whose sketches agree less is taken to be below the threshold (four standard deviations away from 0.8).
SKETCH_LEAST = 0.64
#: What is near a text this near to a representative is, by the triangle inequality, near enough to link to that as well.
ABSORB = 0.8
#: Entries of a trie that are walked at once.
SLOT = 4096
BLOCK = 256


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the target probability."""
    depth = label
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Shingle hashes of each text, with repeats; none for a text without words."""
    raw, begin = joined([(t or "").encode("utf-8", "surrogatepass").translate(_FOLD) for t in texts])
    starts, _, hashes = words(raw, BLANKS)
    at = np.searchsorted(starts, begin)
    out = []
    for i in range(len(texts)):
        h = hashes[at[i] : at[i + 1]]
        out.append(grams(h, n) if len(h) >= n else grams(h, len(h)) if len(h) else h)
    return out


class MinHasher:
    """`size` minhashes by xor and odd multipliers of 32-bit shingle hashes."""

    def __init__(self, size: int):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64))
        self.xor = (seeds[:size] >> np.uint64(32)).astype(np.uint32)
        self.by = (seeds[size:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.xor), 0xFFFFFFFF, dtype=np.uint32)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(least, ((x[i : i + 512, None] ^ self.xor) * self.by).min(axis=0), out=least)
        return least


def signatures(docs: DataFrame, trees: int, label: int, depth: int) -> DataFrame:
    """doc_id, node, an entry per tree (key: the first `depth` minhashes and the tree; rest: 16 bits of each further one,
    the first highest) and a sketch of 256 bits in four longs; no entries without words."""
    entry = T.StructType([T.StructField("key", T.LongType()), T.StructField("rest", T.LongType())])
    fields = [T.StructField("entries", T.ArrayType(entry)), T.StructField("sketch", T.ArrayType(T.LongType()))]
    tree = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def run(texts):
        hasher, entries, sketches = MinHasher(trees * label), [], []
        for h in shingle_sets(texts):
            if not len(h):
                entries.append([])
                sketches.append([0, 0, 0, 0])
                continue
            low = hasher(h)
            labels = mix(low.reshape(trees, label).astype(np.uint64))
            key, rest = tree.copy(), np.zeros(trees, np.uint64)
            for k in range(depth):
                key = mix(key ^ labels[:, k])
            for k in range(depth, label):
                rest = rest << np.uint64(16) | labels[:, k] >> np.uint64(48)
            entries.append([{"key": a, "rest": b} for a, b in zip(key.view(np.int64).tolist(), rest.view(np.int64).tolist(), strict=True)])
            bits = np.packbits((mix(low[:256].astype(np.uint64)) & np.uint64(1)).astype(np.uint8))
            sketches.append(bits.view(np.int64).tolist())
        return [entries, sketches]

    source = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return add_columns(source.withColumn("node", F.xxhash64("text")), ["text"], fields, run).drop("text")


def walk_trie(rest: np.ndarray, sketch: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, representatives left at the cut): links between the entries of one trie, as places. Entries come sorted by
    rest; levels: minhashes in it."""
    live, left, right = np.arange(len(rest)), [], []
    for level in range(levels, -1, -1):
        branch = rest[live] >> np.int64(16 * (levels - level)) if level else np.zeros(len(live), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(branch[1:] != branch[:-1]) + 1, [len(live)]])
        gone = np.zeros(len(rest), dtype=bool)
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = live[begin:end]
            while len(some) > 1:
                hub, others = some[0], some[1:]
                near = 1 - np.bitwise_count(sketch[others] ^ sketch[hub]).sum(axis=1) / 128.0
                linked = others[near >= SKETCH_LEAST]
                left.append(linked)
                right.append(np.full(len(linked), hub))
                gone[others[near >= ABSORB]] = True
                some = others[near < ABSORB]
        live = live[~gone[live]]
        if len(live) == 1:
            break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), live


def least_linked(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each entry the least node of those that links connect it to."""
    least = node.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if np.array_equal(before, least):
            return least


def _pairs(low: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Of tries of two entries, by where each begins: whether these are linked."""
    return 1 - np.bitwise_count(sketch[low] ^ sketch[low + 1]).sum(axis=1) / 128.0 >= SKETCH_LEAST


def walk_forest(entries: DataFrame, levels: int) -> DataFrame:
    """entries: key, slot, rest, node, s0..s3. (key, node, hub) of links, and a row without hub for what is left at the
    cut of a trie that has several slots (`many`)."""
    schema = "key long, node long, hub long, s0 long, s1 long, s2 long, s3 long"
    arrow = pa.schema([(n, pa.int64()) for n in ("key", "node", "hub", "s0", "s1", "s2", "s3")])
    columns = ["key", "slot", "rest", "node", "s0", "s1", "s2", "s3", "many"]

    def walked(x: np.ndarray) -> pa.RecordBatch | None:
        """Rows of whole tries, sorted."""
        key, node, sketch = x[0], x[3], np.ascontiguousarray(x[4:8].T).view(np.uint64)
        edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (x[1][1:] != x[1][:-1])) + 1, [len(key)]])
        begin, size = edges[:-1], np.diff(edges)
        two = begin[(size == 2) & (x[8][begin] == 0)]
        two = two[_pairs(two, sketch)]
        a, b, up = [two + 1], [two], [np.zeros(0, np.int64)]
        for at, n in zip(begin.tolist(), size.tolist(), strict=True):
            if n > 2 or x[8][at]:
                i, j, live = walk_trie(x[2][at : at + n], sketch[at : at + n], levels)
                a.append(i + at)
                b.append(j + at)
                if x[8][at]:
                    up.append(live + at)
        up = np.concatenate(up)
        hub = least_linked(node, np.concatenate(a), np.concatenate(b))  # one link a node keeps what is connected together
        linked = np.flatnonzero(hub != node)
        if not len(linked) + len(up):
            return None
        at = np.concatenate([linked, up])
        hubs = pa.array(hub[at], mask=np.arange(len(at)) >= len(linked))
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), hubs, *[pa.array(np.concatenate([np.zeros(len(linked), np.int64), x[k][up]])) for k in range(4, 8)]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(columns), 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(new):  # the last trie may go on
                if (out := walked(held[:, : new[-1] + 1])) is not None:
                    yield out
                held = held[:, new[-1] + 1 :]
        if held.shape[1] and (out := walked(held)) is not None:
            yield out

    ordered = entries.select(*columns).repartition("key", "slot").sortWithinPartitions("key", "slot", "rest", F.xxhash64("node", "key"), "node")
    return ordered.mapInArrow(run, schema)


def candidate_links(signed: DataFrame, levels: int, slot: int = SLOT) -> DataFrame:
    """(a, b): links between nodes that the forest finds."""
    entries = signed.select("node", F.inline("entries")).distinct()
    cuts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n")
    sketch = signed.groupBy("node").agg(*[F.min(F.col("sketch")[k]).alias(f"s{k}") for k in range(4)])
    placed = entries.join(cuts, F.col("key") == F.col("k")).join(sketch, "node")
    slots = F.ceil(F.col("n") / slot)
    placed = placed.select("key", F.pmod(F.xxhash64("node", "key"), slots).alias("slot"), "rest", "node", "s0", "s1", "s2", "s3", (slots > 1).cast("long").alias("many"))
    first = stored(walk_forest(placed, levels), "forest")
    # the representatives of a trie's slots; their labels differ or their sketches do
    left = first.where("hub IS NULL").select("key", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("rest"), "node", "s0", "s1", "s2", "s3", F.lit(0).cast("long").alias("many"))
    return first.where("hub IS NOT NULL").select("node", "hub").union(walk_forest(left, 0).select("node", "hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()


def _count_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """left x right matrix of booleans: Jaccard of the sets at least `threshold`. Only shingles that two sets share
    take part in the product."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[where]
    row, column = owner[keep], rank[where[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((len(left), len(right))), 4096
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [c, c + width])
        r, k = row[a:b], column[a:b] - c
        m = np.zeros((len(left), width), dtype=np.float32)
        m[at_left[r[at_left[r] >= 0]], k[at_left[r] >= 0]] = 1
        if left is right:
            w = m
        else:
            w = np.zeros((len(right), width), dtype=np.float32)
            w[at_right[r[at_right[r] >= 0]], k[at_right[r] >= 0]] = 1
        common += m @ w.T
    either = sizes[left][:, None] + sizes[right][None, :] - common
    return (common >= threshold * either) & (common > 0)


def verify_block(block: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """One pair of blocks of a component: each node's links across it, and the least node it is linked to."""
    first, second = int(block["i"].iloc[0]), int(block["j"].iloc[0])
    block = block.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    sets = [np.unique(s) for s in shingle_sets(block["text"].tolist())]
    nodes, own = block["node"].to_numpy(), block["own"].to_numpy()
    left = np.flatnonzero(own == first)
    right = left if first == second else np.flatnonzero(own == second)
    if not len(left) or not len(right):
        return pd.DataFrame({"node": nodes[:0], "links": np.zeros(0, np.int64), "hub": nodes[:0]})
    linked = _count_links(sets, left, right, threshold)
    if first == second:
        np.fill_diagonal(linked, False)
    links, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    links[left] += linked.sum(axis=1)
    if first != second:
        links[right] += linked.sum(axis=0)
    grid = np.zeros((len(nodes), len(nodes)), dtype=bool)
    grid[np.ix_(left, right)] = linked
    grid |= grid.T
    for i in range(len(nodes)):  # breadth first from the least node of each group
        if parent[i] == i and links[i]:
            seen = np.zeros(len(nodes), dtype=bool)
            front = np.zeros(len(nodes), dtype=bool)
            front[i] = True
            while front.any():
                seen |= front
                front = grid[front].any(axis=0) & ~seen
            parent[seen] = i
    has = links > 0
    return pd.DataFrame({"node": nodes[has], "links": links[has], "hub": nodes[parent[has]]})


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, node, class_id, n_links, copies of every row of docs (doc_id, text)."""
    depth = prefix_length(threshold, trees, label, recall)
    signed = stored(signatures(docs, trees, label, depth), "signatures")
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    edges = candidate_links(signed, label - depth)
    members = connected_components(edges)
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")).select(F.col("component").alias("c"), "nb")
    placed = members.join(sizes, F.col("component") == F.col("c")).select("node", "component", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("own"))
    wanted = placed.join(texts.select("node", "first_id"), "node")
    rows = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text")).withColumn("n", F.xxhash64("text"))
    found = rows.join(wanted, (F.col("n") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    blocks = found.select("node", "component", "nb", "own", "text", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x")).select("node", "component", "nb", "own", "text", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    verified = stored(_in_groups(blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"), threshold), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    single = verified.where("NOT many").select("node", F.col("hub").alias("component"))
    classes = single.union(connected_components(verified.where("many").select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    named = texts.join(classes, "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = named.groupBy("class").agg(F.min("first_id").alias("class_id"))
    out = named.join(least, "class").select(F.col("node").alias("n"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies")
    return signed.select("doc_id", "node").join(out, F.col("node") == F.col("n")).select("doc_id", "node", "class_id", "n_links", "copies")


def _in_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """verify_block over rows that lie together by (component, i, j); a block has 2 * BLOCK rows or so."""
    schema = "node long, links long, hub long, many boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        out: list[pd.DataFrame] = []

        def done():
            group = pd.concat(held)
            out.append(verify_block(group, threshold).assign(many=bool(group["nb"].iloc[0] > 1)))
            held.clear()

        for batch in batches:
            for key, part in batch.groupby(["component", "i", "j"], sort=False):
                if held and key != last:
                    done()
                last = key
                held.append(part)
            if len(out) > 500:
                yield pd.concat(out)
                out.clear()
        if held:
            done()
        if out:
            yield pd.concat(out)

    return rows.select("component", "i", "j", "node", "nb", "own", "text").mapInPandas(run, schema)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of each class, with its own columns; of rows that share it and the text, one
    stays."""

    def kept(rows: DataFrame) -> DataFrame:
        classes = near_classes(rows.select("doc_id", "text"))
        first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("node").alias("_node")).select(F.col("class_id").alias("_id"), "_node")
        found = rows.withColumn("_n", F.xxhash64(F.coalesce("text", F.lit("")))).join(first, (F.col("_n") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        plain = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.AtomicType)]
        one = Window.partitionBy("_id", "_node").orderBy(*plain)
        return found.withColumn("_one", F.row_number().over(one)).where("_one = 1")

    return filtered(docs, {"doc_id": "doc_id", "text": "text"}, kept)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT t, min(doc_id) AS id, count(*) AS copies, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d GROUP BY t),
s AS (SELECT DISTINCT id, array_to_string(w[p : p + 4], ' ') AS x FROM n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(p) WHERE len(w) > 0),
z AS (SELECT id, count(*) AS k FROM s GROUP BY 1),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id <> b.id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE common.k >= 0.8 * (za.k + zb.k - common.k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT id, least(id, min(b)) AS class_id FROM n LEFT JOIN reach ON a = id GROUP BY id),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, copies
FROM d JOIN n ON d.t = n.t JOIN least ON least.id = n.id LEFT JOIN links ON links.a = n.id
"""
