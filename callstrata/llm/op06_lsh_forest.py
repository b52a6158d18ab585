"""N-gram Jaccard self-join by a MinHash LSH forest.

Every text becomes the set of its five-word shingles; equal sets are one node, so exact copies never meet as pairs. A forest of
prefix tries holds the signatures: in each tree a node's label is a sequence of min-hashes, and nodes that share a prefix of it
lie in one bucket. The join starts at the full depth and shortens the prefix until the depth itself assures the target recall
for a pair at the threshold, whatever else the table holds. A bucket with the same members as another is looked at once; a large one is cut into
blocks that are compared block by block. A pair is counted in the first tree and at the first depth where it meets, on the exact
shingle sets. Out of a block come counts and a spanning forest, never its pairs.

Shingles are 64-bit hashes; a node is the 64-bit hash of its set.

Defined results: texts without words (null, empty) have no links and are classes of their own; a text of fewer than five words
is one shingle; rows with a null id are linked but a class is named by its smallest id that is not null; repeated rows are
copies of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import batches_of_bytes, byte_words, released, sliced, staged, staged_by_few

WORDS = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 5
RECALL = 0.9999
#: Nodes of a bucket in a block.
ROWS = 512
SMALL = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHash(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def stir(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a whole text."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out += stir(h[i:len(h) - n + 1 + i] * _MIX[i] + np.uint64(i))
        return np.unique(stir(out))


def permutations(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = trees * depth
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-hashes of a shingle set."""
    low = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        best = np.minimum(best, (low[k:k + 4096, None] * a + b).min(axis=0))
    return best


def labels(sig: np.ndarray, trees: int, depth: int, short: int) -> np.ndarray:
    """Per tree the label of the prefix of ``short`` min-hashes."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(trees, depth)[:, :short].astype(np.uint64)
        out = np.arange(trees, dtype=np.uint64) + np.uint64(1)
        for k in range(short):
            out = stir(out * _MIX[1] + rows[:, k])
    return out.view(np.int64)


def found_odds(j, trees: int, depth: int):
    """Odds that a pair of similarity j shares a prefix of the depth in any tree."""
    return 1.0 - (1.0 - np.asarray(j, dtype=np.float64) ** depth) ** trees


def shallowest(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix, from ``depth`` down, at which a pair at the threshold is found with the target odds."""
    return next((k for k in range(depth, 0, -1) if found_odds(threshold, trees, k) >= recall), 1)


def signed(docs: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """doc_id, row_key, node (null without words), and per depth from ``depth`` down to ``least`` the labels of all trees."""
    a, b = permutations(trees, depth)

    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            node, told = [], {k: [] for k in range(depth, least - 1, -1)}
            for text in batches_of_bytes(batch.column("text")):
                sh = shingles(text, known)
                if not len(sh):
                    node.append(None)
                    for k in told:
                        told[k].append(None)
                    continue
                node.append(int.from_bytes(hashlib.blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True))
                sig = signature(sh, a, b)
                for k in told:
                    told[k].append(labels(sig, trees, depth, k))
            arrays = [batch.column("doc_id"), batch.column("row_key"), pa.array(node, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in told.values())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "node", *(f"p{k}" for k in told)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ", ".join(f"p{k} array<long>" for k in range(depth, least - 1, -1))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(sign, f"doc_id {kind}, row_key long, node long, {cols}")


def buckets(nodes: DataFrame, prefix: str) -> DataFrame:
    """(tree, label, n): buckets of two nodes or more, one for each set of members, the one of the smallest tree."""
    spread = nodes.select("node", F.posexplode(prefix).alias("tree", "label"))
    full = spread.groupBy("tree", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
    return full.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "label")).alias("b")).select("b.tree", "b.label", "n", "x", "y")


def members(nodes: DataFrame, prefix: str, kept: DataFrame, rows: int) -> DataFrame:
    """(node, tree, label, lo, hi, side): a node in each pair of blocks of its buckets that it has a part in."""
    spread = nodes.select("node", F.posexplode(prefix).alias("tree", "label")).join(kept.select("tree", "label", "n"), ["tree", "label"])
    n_blocks = F.ceil(F.col("n") / rows)
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    return spread.select("node", "tree", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the whole text of the row that stands for each."""
    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            sets = [shingles(x, known).tobytes() for x in batches_of_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("id2"), F.xxhash64("doc_id", "text").alias("key2"), "text")
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    rows = texts.join(few, F.col("id2").eqNullSafe(few.doc_id) & (F.col("key2") == few.row_key)).select("node", "text")
    return rows.mapInArrow(cut, "node long, shingles binary").dropDuplicates(["node"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left with right sets."""
    sizes = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(at)[at] > 1
    at, owner = at[shared], owner[shared]
    _, at = np.unique(at, return_inverse=True) if len(at) else (None, at)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    n_cols = int(at[-1]) + 1 if len(at) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, n_cols, 8192):
        a, b = np.searchsorted(at, [c, c + 8192])
        x = np.zeros((len(sets), min(8192, n_cols - c)), np.float32)
        x[owner[a:b], at[a:b] - c] = 1.0
        out += x[left] @ x[right].T
    return out


def compare(rows: list[tuple], tree: int, lo: int, hi: int, threshold: float) -> list[tuple]:
    """rows: (node, own block, copies, set, labels at the depth, labels one deeper or None).

    Per node with a link: (node, smallest node that it hangs together with here, copies of its partners).
    """
    own = np.array([r[1] for r in rows])
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    if not len(left) or not len(right):
        return []
    sets = [r[3] for r in rows]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets, left, right).astype(np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    near = both >= threshold * union - 1e-9
    if lo == hi:
        near &= left[:, None] < right[None, :]
    i, j = np.nonzero(near)
    if not len(i):
        return []
    a, b = left[i], right[j]
    labs = np.stack([r[4] for r in rows])
    new = (labs[a] == labs[b]).argmax(axis=1) == tree
    if rows[0][5] is not None:
        deep = np.stack([r[5] for r in rows])
        new &= ~(deep[a] == deep[b]).any(axis=1)
    a, b = a[new], b[new]
    if not len(a):
        return []
    copies = np.array([r[2] for r in rows], dtype=np.int64)
    links = np.zeros(len(rows), np.int64)
    for x, y in ((a, b), (b, a)):
        np.add.at(links, x, copies[y])
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    low = ids.copy()
    while True:
        new_low = low.copy()
        np.minimum.at(new_low, a, low[b])
        np.minimum.at(new_low, b, low[a])
        if (new_low == low).all():
            break
        low = new_low
    return [(int(ids[k]), int(low[k]), int(links[k])) for k in np.flatnonzero(links)]


LINKS = "node long, low long, links long"


def verified(placed: DataFrame, threshold: float) -> DataFrame:
    """Compares the blocks. The rows of a pair of blocks lie next to each other in a partition and are read as a stream."""
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def done():
            return compare(rows, key[0], key[2], key[3], threshold) if len(rows) > 1 else []

        def told(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in found], pa.int64()) for c in range(3)], ["node", "low", "links"])

        for batch in (part for whole in batches for part in sliced(whole)):
            cols = [batch.column(c).to_pylist() for c in ("tree", "label", "lo", "hi", "node", "own", "copies", "shingles", "labs", "deep")]
            for t, lab, lo, hi, node, own, copies, sh, labs, deep in zip(*cols, strict=True):
                if (t, lab, lo, hi) != key:
                    out += done()
                    key, rows = (t, lab, lo, hi), []
                rows.append((node, own, copies, np.frombuffer(sh, np.uint64), np.array(labs), np.array(deep) if deep is not None else None))
            if len(out) > 10_000:
                yield told(out)
                out = []
        out += done()
        yield told(out)

    cells = ["tree", "label", "lo", "hi"]
    return placed.repartition(*cells).sortWithinPartitions(*cells, "node").mapInArrow(run, LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every connected component, by spreading labels and jumping along them."""
    both = staged(edges.select("node", "low").union(edges.select(F.col("low"), F.col("node"))).filter("node <> low").distinct().toDF("u", "v"))
    roots = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("node"), "root"))
    while True:
        near = both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots.node == near.u).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        stepped = staged(lower.join(jump, lower.root == jump["at"]).select("node", "old", F.least("root", "beyond").alias("root")))
        roots = stepped.select("node", "root")
        if stepped.filter("old <> root").isEmpty():
            return roots


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id among all that links connect), copy_of (smallest id with the same
    shingles), n_links (other documents of a similarity at or above the threshold), n_copies (of them with the same shingles), row_key (hash of id and text), keep_key (row key of
    the row that stands for the class, the one of the smallest id; null for a text without words)."""
    least = shallowest(trees, depth, threshold, recall)
    sigs = staged_by_few(signed(docs, trees, depth, least))
    prefixes = [f"p{k}" for k in range(depth, least - 1, -1)]
    nodes = staged(sigs.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("row"), *[F.any_value(p).alias(p) for p in prefixes]))
    rounds, seen = [], None
    for k in range(depth, least - 1, -1):
        kept = staged(buckets(nodes, f"p{k}"))
        fresh = kept if seen is None else kept.join(seen, ["n", "x", "y"], "left_anti")
        seen = kept.select("n", "x", "y") if seen is None else seen.union(kept.select("n", "x", "y"))
        placed = staged(members(nodes, f"p{k}", fresh, rows))
        wanted = placed.select("node").distinct().join(nodes, "node").select("node", "row.doc_id", "row.row_key")
        sets = with_sets(docs, staged(wanted))
        deep = F.col(f"p{k + 1}") if k < depth else F.lit(None).cast("array<long>")
        content = sets.join(nodes.select("node", "copies", F.col(f"p{k}").alias("labs"), deep.alias("deep")), "node")
        rounds.append(staged_by_few(verified(placed.join(content, "node"), threshold)))
    told = rounds[0]
    for r in rounds[1:]:
        told = told.union(r)
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(told)
    named = nodes.select("node", "copies", "first_id", "row").join(links, "node", "left").join(roots, "node", "left")
    named = staged(named.select("node", "copies", "first_id", "row", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    names = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min("row")["row_key"].alias("keep_key"))
    facts = named.join(names, "root").select(F.col("node").alias("at"), "copies", "first_id", "links", "class_id", "keep_key")
    out = sigs.select("doc_id", "row_key", "node").join(facts, F.col("node") == F.col("at"), "left")
    own = F.col("node").isNull()
    return out.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("first_id")).alias("copy_of"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
        "row_key", "keep_key")


def op6_lsh_forest(spark, sf_dir: str) -> DataFrame:
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key", "keep_key")
