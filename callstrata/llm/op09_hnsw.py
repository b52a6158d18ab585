"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged over shards.

Equal vectors are one node. The nodes are dealt to shards of a bounded size by hash. In a shard nodes enter the graph one after another;
each links to a diverse choice of its nearest earlier nodes, on its level and below, and those link back. The graph is stored as flat arrays
of neighbour numbers, one row per shard. Queries stream through every shard: greedy descent through the levels, then a beam on
the ground level. The best nodes of all shards meet in one ranking, which is scored in double precision on the original vectors.

Largest inner product becomes nearest neighbour by one more component, which lifts all vectors to the same length.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null
id or of another length than most; a repeated row counts once; rows that share the id of the query are its own; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callstrata.llm.text import staged

TOP = 20
SHARD_ROWS = 8192
#: Links of a node on the upper levels and on the ground; candidates for links; beam of a search and nodes opened at a time.
LINKS, GROUND_LINKS, CANDIDATES, BEAM, WIDTH = 16, 32, 64, 128, 4
QUERY_BLOCK = 256
#: Queries that one task takes through a shard.
QUERY_GROUP = 20_000
SEED = 11


def diverse(sims: np.ndarray, between: np.ndarray, most: int) -> list[int]:
    """Places of at most ``most`` candidates (given nearest first) that are nearer to the node than to any chosen one; then the nearest of the rest."""
    chosen: list[int] = []
    closest = np.full(len(sims), -np.inf, np.float32)
    for i in range(len(sims)):
        if closest[i] < sims[i]:
            chosen.append(i)
            if len(chosen) == most:
                return chosen
            np.maximum(closest, between[i], out=closest)
    taken = set(chosen)
    return chosen + [i for i in range(len(sims)) if i not in taken][:most - len(chosen)]


def link(x: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Neighbour numbers of one level, -1 where there is none. ``members`` are the level's nodes in the order of entry.

    The candidates of an entering node are its nearest earlier nodes, found block by block; links back are thinned at the end.
    """
    n = len(members)
    own = x[members]
    links: list[list[int]] = [[] for _ in range(n)]
    for start in range(0, n, 256):
        stop = min(n, start + 256)
        sims = own[start:stop] @ own[:stop].T
        for i in range(max(start, 1), stop):
            row = sims[i - start, :i]
            k = min(CANDIDATES, i)
            best = np.argpartition(-row, k - 1)[:k]
            best = best[np.argsort(-row[best], kind="stable")]
            for j in best[diverse(row[best], own[best] @ own[best].T, most // 2)].tolist():
                links[i].append(j)
                links[j].append(i)
    out = np.full((n, most), -1, np.int32)
    for i, around in enumerate(links):
        if len(around) > most:
            near = own[around] @ own[i]
            order = np.argsort(-near, kind="stable")
            around = np.array(around)[order]
            around = around[diverse(near[order], own[around] @ own[around].T, most)]
        out[i, :len(around)] = around
    return np.where(out >= 0, members[out], -1).astype(np.int32)


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Graph of lifted vectors of equal length: per level, from the ground up, the places of the nodes on it and their neighbours.
    The first node is on every level and is the entry."""
    n = len(x)
    rng = np.random.default_rng(SEED)
    height = np.floor(-np.log(1.0 - rng.random(n)) / np.log(LINKS)).astype(np.int64)
    height[0] = height.max()
    levels = []
    for level in range(int(height.max()) + 1):
        members = np.flatnonzero(height >= level)
        near = link(x, members, GROUND_LINKS if level == 0 else LINKS)
        place = np.full(n, -1, np.int32)
        place[members] = np.arange(len(members))
        levels.append((place, near))
    return levels


def search(x: np.ndarray, levels: list, q: np.ndarray, beam: int) -> np.ndarray:
    """Numbers of the nodes found for each query, nearest first, -1 beyond; all queries step together."""
    rows = np.arange(len(q))
    at = np.zeros(len(q), np.int64)
    best = q @ x[0]
    for place, near in levels[:0:-1]:
        active = rows
        while len(active):
            around = near[place[at[active]]]
            sims = np.einsum("qd,qmd->qm", q[active], x[around])
            sims[around < 0] = -np.inf
            step = sims.argmax(axis=1)
            top = sims[np.arange(len(active)), step]
            better = top > best[active]
            moved = active[better]
            at[moved], best[moved] = around[better, step[better]], top[better]
            active = moved
    ground = levels[0][1]
    ids, scores, opened = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
    ids[:, 0], scores[:, 0], opened[:, 0] = at, best, False
    seen = np.zeros((len(q), len(x)), bool)
    seen[rows, at] = True
    active = rows
    while len(active):
        order = np.argsort(opened[active], axis=1, kind="stable")[:, :WIDTH]
        fresh = ~np.take_along_axis(opened[active], order, 1)
        chosen = np.take_along_axis(ids[active], order, 1)
        mark = opened[active]
        np.put_along_axis(mark, order, True, 1)
        around = np.where(fresh[:, :, None], ground[chosen], -1).reshape(len(active), -1)
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        new = (around >= 0) & ~seen[active[:, None], around]
        seen[np.broadcast_to(active[:, None], around.shape)[new], around[new]] = True
        sims = np.einsum("qd,qmd->qm", q[active], x[around]).astype(np.float32)
        sims[~new] = -np.inf
        all_s = np.concatenate([scores[active], sims], axis=1)
        all_i = np.concatenate([ids[active], np.where(new, around, -1)], axis=1)
        all_o = np.concatenate([mark, ~new], axis=1)
        keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[active], scores[active], opened[active] = (np.take_along_axis(v, keep, 1) for v in (all_i, all_s, all_o))
        active = active[~opened[active].all(axis=1)]
    return ids


def valid(df: DataFrame, column: str) -> DataFrame:
    """(vec_id, vec as doubles) of the rows that take part."""
    vec = F.col(column).cast("array<double>")
    rows = df.select("vec_id", vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.exists("vec", lambda v: v != 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.withColumn("node", F.xxhash64("vec"))


def lifted(raw: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings each to the length of the longest."""
    own = (raw * raw).sum(axis=1)
    return np.concatenate([raw, np.sqrt(np.maximum(longest - own, 0.0))[:, None]], axis=1).astype(np.float32)


GRAPH = "shard long, node array<long>, flat array<double>, place array<array<int>>, near array<array<int>>"


def graphs(nodes: DataFrame, n_shards: int, dim: int, longest: float) -> DataFrame:
    """One row per shard: its nodes, their vectors end to end, and per level the places and neighbour numbers as flat arrays."""
    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        flat = table.column("vec").combine_chunks().flatten()
        levels = build(lifted(flat.to_numpy(zero_copy_only=False).reshape(-1, dim), longest))
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "node": pa.array([table.column("node").to_numpy()], pa.list_(pa.int64())),
            "flat": pa.array([flat.to_numpy(zero_copy_only=False)], pa.list_(pa.float64())), "place": pa.array([[p for p, _ in levels]], pa.list_(pa.list_(pa.int32()))),
            "near": pa.array([[g.reshape(-1) for _, g in levels]], pa.list_(pa.list_(pa.int32())))})

    sharded = nodes.select(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(n_shards)).alias("shard"), "node", "vec")
    return sharded.repartition(n_shards, "shard").groupBy("shard").applyInArrow(make, GRAPH)  # a partition per shard, however few bytes it has


def searched(index: DataFrame, queries: DataFrame, n_shards: int, n_queries: int, dim: int, longest: float, k: int, beam: int) -> DataFrame:
    """(query_id, node, score): the best nodes of every shard for every query. A shard's graph comes first in its partition, then the queries."""
    groups = -(-max(n_queries, 1) // QUERY_GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, node, raw, x, levels, held = None, None, None, None, None, []

        def found():
            q = np.array([v for _, v in held], dtype=np.float64)
            got = search(x, levels, np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), beam)
            out_q, out_n, out_s = [], [], []
            for (qid, _), ids, v in zip(held, got, q, strict=True):
                ids = ids[ids >= 0]
                scores = raw[ids] @ v
                best = np.lexsort((ids, -scores))[:k]
                out_q += [qid] * len(best)
                out_n += node[ids[best]].tolist()
                out_s += scores[best].tolist()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "node", "score"])

        for batch in batches:
            cols = [batch.column(c) for c in ("shard", "query_id", "vec", "node", "flat", "place", "near")]
            for own, qid, vec, nodes, flat, place, near in zip(*cols, strict=True):
                if nodes.is_valid:
                    if held:
                        yield found()
                    shard, node = own.as_py(), nodes.values.to_numpy()
                    raw = flat.values.to_numpy().reshape(-1, dim)
                    x = lifted(raw, longest)
                    levels = [(p.values.to_numpy(), g.values.to_numpy().reshape(-1, LINKS if i else GROUND_LINKS)) for i, (p, g) in enumerate(zip(place, near, strict=True))]
                elif own.as_py() == shard:  # a shard may be without nodes
                    held.append((qid.as_py(), vec.as_py()))
                    if len(held) == QUERY_BLOCK:
                        yield found()
        if held:
            yield found()

    none = [F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("vec", "array<double>"))]
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")
    left = index.select("shard", parts, *none, "node", "flat", "place", "near")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("node", "array<long>"), ("flat", "array<double>"), ("place", "array<array<int>>"), ("near", "array<array<int>>"))]
    right = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), F.col("vec_id").alias("query_id"), "vec", *empty)
    both = left.union(right).repartition(n_shards * groups, "shard", "part").sortWithinPartitions("shard", "part", F.col("node").isNull(), "query_id")
    return both.drop("part").mapInArrow(run, "query_id long, node long, score double")


def neighbours(vectors: DataFrame, queries: DataFrame, column: str = "embedding", k: int = TOP, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every query row by inner product."""
    rows = valid(vectors, column).dropDuplicates(["vec_id", "node"])
    common = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 1
    rows = staged(rows.filter(F.size("vec") == dim))
    # of equal vectors only the k + 1 smallest ids can appear: chosen within spread parts first, then among these
    ids = rows.select("node", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part"))
    for keys in (["node", "part"], ["node"]):
        ids = ids.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("no") <= k + 1)
    members = staged(ids.select("node", "vec_id"))
    nodes = staged(members.groupBy("node").agg(F.min("vec_id").alias("vec_id")).join(rows, ["node", "vec_id"]).select("node", "vec"))
    total = nodes.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))).first()
    n_shards = max(1, -(-total[0] // shard_rows))
    longest = float(total[1] or 0.0)
    index = staged(graphs(nodes, n_shards, dim, longest))
    asked = valid(queries, column).dropDuplicates(["vec_id", "node"]).filter(F.size("vec") == dim).select("vec_id", "vec")
    got = searched(index, asked, n_shards, asked.count(), dim, longest, k + 1, beam)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    best = got.withColumn("no", F.row_number().over(by_score)).filter(F.col("no") <= k + 1).drop("no")
    pairs = best.join(members, "node").filter(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw_shards(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(vectors, vectors.filter(F.pmod("vec_id", F.lit(20)) == 0))
