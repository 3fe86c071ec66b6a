"""Approximate nearest neighbours: a robust-pruned directed graph per shard.

Vectors are dealt into shards by hash. In a shard each vector in turn (batches,
small ones first) searches the graph built so far greedily; of what it meets, an
edge is kept unless an edge kept before lies closer to the target by the factor
`alpha`, so edges point in diverse directions. Reverse edges are added and
pruned alike. A query walks every shard's graph with a beam and the best of all
shards are merged. In building, inner products become distances by one more
coordinate that gives all vectors the same length; a query orders by the inner
products themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import stored

SHARD = 4096  # vectors per shard
DEGREE = 24  # edges after pruning; twice as many may gather before
BUILD_BEAM = 48
SEARCH_BEAM = 72
ALPHA = 1.2
QUERY_BLOCK = 512


def beam(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int,
         squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, `squares` of the nodes less twice the inner product), least first; -1 where there are fewer.

    With the nodes' squared lengths that is the squared distance less the query's
    own square, with zeros the order of inner products. All queries advance
    together: each expands its nearest unexpanded node.
    """
    n, q = len(points), len(queries)
    nodes = np.full((q, width), -1, np.int32)
    away = np.full((q, width), np.inf)
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    entries = entries[:width]
    first = squares[entries] - 2 * queries @ points[entries].T
    order = np.argsort(first, 1, kind="stable")
    nodes[:, : len(entries)], away[:, : len(entries)] = entries[order], np.take_along_axis(first, order, 1)
    seen[:, entries] = True
    while True:
        waiting = ~done & (nodes >= 0)
        rows = np.flatnonzero(waiting.any(1))
        if not len(rows):
            return nodes, away
        first = waiting[rows].argmax(1)
        done[rows, first] = True
        near = graph[nodes[rows, first]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        at, slot = np.nonzero(fresh)
        seen[rows[at], near[at, slot]] = True
        d = squares[near] - 2 * np.einsum("rkd,rd->rk", points[near], queries[rows])
        d[~fresh] = np.inf
        near = np.where(fresh, near, -1)
        all_d = np.concatenate([away[rows], d], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :width]
        away[rows] = np.take_along_axis(all_d, best, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], near], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(fresh)], 1), best, 1)


def prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: `degree` candidates at most for each of the nodes `of`, -1 in free places."""
    vectors = points[candidates]
    own = points[of]
    d = ((vectors - own[:, None]) ** 2).sum(2)
    d[(candidates < 0) | (candidates == of[:, None])] = np.inf
    order = np.argsort(d, 1, kind="stable")
    d, candidates = np.take_along_axis(d, order, 1), np.take_along_axis(candidates, order, 1)
    vectors = points[candidates]
    alive = np.isfinite(d)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    chosen = np.full((len(of), degree), -1, np.int32)
    line = np.arange(len(of))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        chosen[some, k] = candidates[line, pick][some]
        between = ((vectors - vectors[line, pick][:, None]) ** 2).sum(2)
        alive &= alpha * alpha * between > d
        alive[line, pick] = False
    return chosen


def build(points: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each node, entry node). Deterministic: nodes are inserted in the given order."""
    n = len(points)
    graph = np.full((n, 2 * degree), -1, np.int32)
    squares = np.einsum("nd,nd->n", points, points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], np.delete(np.arange(n), entry)])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        at, size = at + len(batch), min(2 * size, 256)
        met, _ = beam(points, graph, np.array([entry]), points[batch], width, squares)
        out = prune(points, batch, met, degree, alpha)
        graph[batch, :degree] = out
        source = np.repeat(batch, degree)
        target = out.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        have = (graph[nodes] >= 0).sum(1)
        slot = have.repeat(count) + np.arange(len(target)) - start.repeat(count)
        fits = (have + count <= 2 * degree).repeat(count)
        graph[target[fits], slot[fits]] = source[fits]
        full = np.flatnonzero(have + count > 2 * degree)
        for some in np.array_split(full, math.ceil(len(full) / 128) or 1):
            if len(some):
                widest = int(count[some].max())
                extra = np.full((len(some), widest), -1, np.int64)
                for i, f in enumerate(some):
                    extra[i, : count[f]] = source[start[f] : start[f] + count[f]]
                kept = prune(points, nodes[some], np.concatenate([graph[nodes[some]], extra], 1), degree, alpha)
                graph[nodes[some]] = -1
                graph[nodes[some], :degree] = kept
    return graph, entry


def level(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more coordinate, at equal distances `longest` from one point.

    The coordinate counts from that length downwards, so short vectors beside a very
    long one keep their digits.
    """
    squares = (vectors * vectors).sum(1)
    rest = np.sqrt(np.maximum(0.0, longest * longest - squares))
    return np.concatenate([vectors, (squares / (longest + rest))[:, None]], 1)


def starts(vectors: np.ndarray, entry: int) -> np.ndarray:
    """Where searches start: the entry node and the longest vectors, to which few edges lead."""
    longest = np.argsort(-(vectors * vectors).sum(1), kind="stable")[:DEGREE]
    return np.concatenate([[entry], longest[longest != entry]])


def index(frame: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per shard: its distinct vectors, the smallest ids of each, and the graph.

    Every valid row is covered: equal vectors are one node, which holds its
    `k` + 1 smallest ids, all that an answer can need.
    """
    rows = _valid(frame, key, vector)
    rank = F.row_number().over(Window.partitionBy("_vector").orderBy("_id"))  # limited per task before the shuffle
    nodes = rows.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    nodes = nodes.groupBy("_vector").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    nodes = stored(nodes.withColumn("_size", F.size("_vector")), "vectors")
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sizes = {r["_size"]: (r["n"], r["longest"]) for r in
             nodes.groupBy("_size").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()}
    shards = {d: (max(1, round(n / shard)), longest) for d, (n, longest) in sizes.items()}
    count = F.create_map(*[F.lit(x) for d, (s, _) in shards.items() for x in (d, s)] or [F.lit(0), F.lit(1)])
    nodes = nodes.withColumn("_shard", F.pmod(F.xxhash64(F.get("_ids", F.lit(0))), count[F.col("_size")]))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        d = table["_size"][0].as_py()
        vectors = np.array(table["_vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
        graph, entry = build(level(vectors, shards[d][1]))
        ids = table["_ids"].combine_chunks()
        return pa.table({
            "size": pa.array([d], pa.int32()), "shard": table["_shard"].slice(0, 1).cast(pa.int64()), "entry": pa.array([entry], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "graph": pa.array([graph.tobytes()], pa.binary()),
            "counts": pa.array([np.diff(ids.offsets.to_numpy()).astype(np.int64).tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary())})

    return stored(nodes.groupBy("_size", "_shard").applyInArrow(
        run, "size int, shard bigint, entry int, vectors binary, graph binary, counts binary, ids binary"), "graphs")


def _valid(frame: DataFrame, key: str, vector: str) -> DataFrame:
    rows = frame.select(F.col(key).cast("bigint").alias("_id"), F.col(vector).alias("_vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("_id").isNotNull() & F.col("_vector").isNotNull() & (F.size("_vector") > 0)
                      & ~F.exists("_vector", bad) & F.exists("_vector", lambda x: x != 0)).distinct()


def search(queries: DataFrame, graphs: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
           width: int = SEARCH_BEAM) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` largest inner products found for each query, own id left out.

    Ties go to the smaller id; fewer rows come back where there are fewer
    candidates. Null ids, null, empty or zero vectors and such with null or
    non-finite components take no part; repeated rows count once; vectors are
    compared with those of their own dimension; an empty side gives no rows.
    Other columns are not read. Queries meet each shard in blocks: one block and
    one shard are in memory at a time.
    """
    rows = _valid(queries, key, vector).withColumn("size", F.size("_vector"))
    count = rows.groupBy("size").count().withColumn("_blocks", F.ceil(F.col("count") / QUERY_BLOCK)).select("size", "_blocks")
    rows = rows.join(F.broadcast(count), "size")  # a row per dimension
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")))
    blocks = rows.groupBy("size", "_block").agg(F.collect_list(F.struct("_id", "_vector")).alias("_queries"))
    pairs = blocks.join(graphs, "size").repartition(F.col("size"), F.col("_block"), F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row] for n in batch.schema.names}
                d = one["size"].as_py()
                raw = lambda name, kind: np.frombuffer(one[name].as_py(), kind)  # noqa: E731, B023
                vectors = raw("vectors", np.float64).reshape(-1, d)
                graph = raw("graph", np.int32).reshape(len(vectors), -1)
                counts, ids = raw("counts", np.int64), raw("ids", np.int64)
                start = np.cumsum(counts) - counts
                asked = one["_queries"].as_py()
                wanted = np.array([q["_vector"] for q in asked], np.float64).reshape(-1, d)
                entries = starts(vectors, one["entry"].as_py())
                near, _ = beam(vectors, graph, entries, wanted, max(width, k + 1), np.zeros(len(vectors)))
                out_q, out_i, out_s = [], [], []
                for q, (mine, nodes, v) in enumerate(zip(asked, near, wanted)):
                    nodes = nodes[nodes >= 0]
                    score = vectors[nodes] @ v
                    all_ids = np.concatenate([ids[start[x] : start[x] + counts[x]] for x in nodes])
                    scores = score.repeat(counts[nodes])
                    other = all_ids != mine["_id"]
                    all_ids, scores = all_ids[other], scores[other]
                    best = np.lexsort((all_ids, -scores))[:k]
                    out_q.append(mine["_id"]), out_i.append(all_ids[best]), out_s.append(scores[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_q, pa.int64()), pa.array(out_i, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64()))],
                    ["query_id", "ids", "scores"])

    found = pairs.select("size", "shard", "entry", "vectors", "graph", "counts", "ids", "_queries").mapInArrow(
        run, "query_id bigint, ids array<bigint>, scores array<double>")
    each = found.select("query_id", F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(
        (-x["scores"]).alias("away"), x["ids"].alias("id"))).alias("best"))
    best = each.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))  # k per shard
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.away")).alias("score"))
