"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Vectors are dealt into shards; each shard has a graph built by batches of insertions: a greedy search proposes
neighbours for every new vector, relaxed distance pruning keeps diverse ones, and edges back are pruned likewise. A
query goes through every shard's graph by beam search, in blocks of queries; what the shards find is merged.
Distances while building are Euclidean after one more coordinate that makes all lengths equal, so that the nearest
vector is the one of largest inner product. Scores are inner products of the original vectors in double precision.

Equal vectors are one node, which has the smallest vec_ids that come with it, as many as an answer can need; every row is so
indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null
vec_ids; a vec_id that comes with the same vector again counts once; one that comes with several vectors asks with
each of them and is found by each, once, with its best score; vectors are searched among those of their own
length; ties go to the smaller vec_id; with fewer candidates than k all are returned as far as the beams reach, and
exactly where a shard has no more rows than a beam; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.tables import settle
from segloom.shipping import ship

SHARD_ROWS, QUERY_BLOCK = 16384, 2048
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 128, 1.2
_BATCH, _AT_ONCE = 512, 4


class Graph:
    """Neighbour lists of vectors; -1 where there is none."""

    def __init__(self, vectors: np.ndarray, entry: int, edges: np.ndarray):
        self.vectors, self.entry, self.edges = vectors, entry, edges
        self.squares = (vectors * vectors).sum(axis=1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the beam's nodes (-1: none) and squared distances less the query's square, nearest first."""
        m, n = len(queries), len(self.vectors)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int32)
        far = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], seen[:, self.entry], open_[:, 0] = self.entry, True, True
        far[:, 0] = self.squares[self.entry] - 2 * (queries @ self.vectors[self.entry])
        rows = np.arange(m)
        while len(rows):
            # The nearest nodes that haven't been opened yet, a few for each query at once.
            order = np.argsort(~open_[rows], axis=1, kind="stable")[:, :_AT_ONCE]
            take = np.take_along_axis(open_[rows], order, axis=1)
            some = take[:, 0]
            rows, order, take = rows[some], order[some], take[some]
            if not len(rows):
                break
            nodes = np.where(take, np.take_along_axis(ids[rows], order, axis=1), -1)
            open_[rows[:, None], order] &= ~take
            near = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(rows), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            seen[rows[r], found] = True
            away = np.full(near.shape, np.inf, np.float32)
            away[r, c] = self.squares[found] - 2 * np.einsum("ij,ij->i", self.vectors[found], queries[rows[r]])
            all_far = np.concatenate([far[rows], away], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[rows] = np.take_along_axis(all_far, best, axis=1)
            ids[rows] = np.where(np.isfinite(far[rows]), np.take_along_axis(np.concatenate([ids[rows], near], axis=1), best, axis=1), -1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), best, axis=1) & (ids[rows] >= 0)
        return ids, far


def pruned(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """For each point, up to degree of its candidates (-1: none): nearest first, leaving out those that a kept one is nearer to."""
    m, c = candidates.shape
    own, other = vectors[points], vectors[candidates]
    away = ((other - own[:, None, :]) ** 2).sum(axis=2)
    away[(candidates < 0) | (candidates == points[:, None])] = np.inf
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(away, order, axis=1)
    other = vectors[candidates]
    squares = (other * other).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(other, other.transpose(0, 2, 1))
    alive = np.isfinite(away)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((m, degree), -1, np.int32)
    rows = np.arange(m)
    for k in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = candidates[has, pick[has]]
        alive &= ~((ALPHA * ALPHA * between[rows, pick] <= away) & has[:, None])
        alive[rows, pick] = False
    return out


def build(vectors: np.ndarray) -> Graph:
    """The graph of one shard's vectors."""
    n = len(vectors)
    edges = np.full((n, DEGREE), -1, np.int32)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = Graph(vectors, entry, edges)
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        near = np.concatenate([graph.search(vectors[new[i : i + 256]], BUILD_BEAM)[0] for i in range(0, len(new), 256)])
        edges[new] = pruned(vectors, new, near, DEGREE)
        # Edges back: to nodes with room as they are, to the others through pruning.
        source = np.repeat(new, DEGREE)
        target = edges[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        degree = (edges[nodes] >= 0).sum(axis=1)
        for lo in range(0, len(nodes), 512):
            own, f, k, d = nodes[lo : lo + 512], first[lo : lo + 512], counts[lo : lo + 512], degree[lo : lo + 512]
            room = d + k <= DEGREE
            for i in np.flatnonzero(room):
                edges[own[i], d[i] : d[i] + k[i]] = source[f[i] : f[i] + k[i]]
            full = np.flatnonzero(~room)
            if len(full):
                widest = int(k[full].max())
                more = np.full((len(full), DEGREE + widest), -1, np.int32)
                more[:, :DEGREE] = edges[own[full]]
                for j, i in enumerate(full):
                    more[j, DEGREE : DEGREE + k[i]] = source[f[i] : f[i] + k[i]]
                for j in range(0, len(full), 64):
                    edges[own[full[j : j + 64]]] = pruned(vectors, own[full[j : j + 64]], more[j : j + 64], DEGREE)
        at += len(new)
        size = min(max(size, at // 8), _BATCH)
    return graph


def _augmented(vectors: np.ndarray) -> np.ndarray:
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None].astype(np.float32)], axis=1).astype(np.float32)


def _built(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by("node")
    vectors = np.array(shard.column("vector").to_pylist(), np.float64).reshape(shard.num_rows, -1)
    graph = build(_augmented(vectors))
    return pa.table(
        {
            "shard": shard.column("shard").slice(0, 1), "rows": pa.array([shard.num_rows], pa.int32()), "entry": pa.array([graph.entry], pa.int32()),
            "nodes": pa.array([shard.column("node").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()), "edges": pa.array([graph.edges.tobytes()], pa.binary()),
        }
    )


_GRAPH = "shard string, rows int, entry int, nodes binary, vectors binary, edges binary"
_FOUND = "query_id long, node long, score double"


def _searcher(wanted: int):
    def searched(block: pa.Table) -> pa.Table:
        ids, nodes, scores = [], [], []
        for row in block.to_batches(max_chunksize=1):
            one = {c: row.column(i)[0] for i, c in enumerate(row.schema.names)}
            n = one["rows"].as_py()
            exact = np.frombuffer(one["vectors"].as_py(), np.float64).reshape(n, -1)
            names = np.frombuffer(one["nodes"].as_py(), np.int64)
            graph = Graph(_augmented(exact), one["entry"].as_py(), np.frombuffer(one["edges"].as_py(), np.int32).reshape(n, -1))
            asked = one["queries"].as_py()
            for at in range(0, len(asked), 256):
                few = asked[at : at + 256]
                vectors = np.array([q["vector"] for q in few], np.float64)
                if n <= BEAM:  # a beam would hold them all
                    near = np.broadcast_to(np.arange(n), (len(few), n))
                else:
                    near, _ = graph.search(np.concatenate([vectors, np.zeros((len(few), 1))], axis=1).astype(np.float32), BEAM)
                for q, vector, found in zip(few, vectors, near, strict=True):
                    found = found[found >= 0]
                    score = np.einsum("ij,j->i", exact[found], vector)
                    best = np.lexsort((names[found], -score))[:wanted]
                    ids += [q["id"]] * len(best)
                    nodes += names[found[best]].tolist()
                    scores += score[best].tolist()
        return pa.table({"query_id": pa.array(ids, pa.int64()), "node": pa.array(nodes, pa.int64()), "score": pa.array(scores, pa.float64())})

    return searched


def nearest(rows: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k nearest other rows found. rows: vec_id, embedding."""
    ship(rows.sparkSession)
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    good = "size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)"
    usable = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("is_query"), vector.alias("vector")).where(good)
    # Nodes are different vectors, by hash; a vec_id may come with several of them.
    usable = settle(usable.withColumn("node", F.xxhash64("vector")))
    same = Window.partitionBy("node").orderBy("vec_id")
    several = usable.groupBy("vec_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("vec_id")
    most = usable.join(several, "vec_id", "left_semi").groupBy("vec_id").agg(F.count_distinct("node").alias("n")).agg(F.max("n")).first()[0] or 1
    # Of equal vectors an answer can hold the k smallest vec_ids, one more for a query that is among them.
    members = usable.select("node", "vec_id").distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= (k + 1) * most)
    members = settle(members.select("vec_id", "node"))
    nodes = usable.select("node", "vector").dropDuplicates(["node"])
    nodes = nodes.withColumn("width", F.size("vector"))
    shards = nodes.groupBy("width").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))  # one row for each length
    dealt = nodes.join(F.broadcast(shards), "width").select(F.concat_ws("-", "width", F.pmod("node", "shards")).alias("shard"), "node", "vector")
    graphs = settle(dealt.groupBy("shard").applyInArrow(_built, _GRAPH))

    queries = usable.where("is_query").select("vec_id", "node", "vector").dropDuplicates(["vec_id", "node"])
    counted = queries.agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")).first()["blocks"] or 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(counted))
    blocks = queries.groupBy(F.size("vector").alias("width"), block.alias("block")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "vector")).alias("queries"))
    asked = graphs.withColumn("width", F.substring_index("shard", "-", 1).cast("int")).join(blocks, "width")
    wanted = min(BEAM, (k + 1) * most)
    found = asked.groupBy("shard", "block").applyInArrow(_searcher(wanted), _FOUND)
    if most > 1:
        found = found.groupBy("query_id", "node").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    # Equal vectors have equal scores: the nodes of the k + 1 best ids hold all answers.
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= wanted).drop("r")
    answers = found.join(members, "node").where("vec_id <> query_id")
    if most > 1:
        answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
