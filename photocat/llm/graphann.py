"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt by hash to shards of bounded size. A shard's graph is built
in batches: a greedy beam search from the shard's centre proposes neighbours
for each vector; pruning keeps the nearest proposal, drops those that are much
nearer to it than to the vector (by the factor ``ALPHA``), and goes on with the
next, so kept edges point in diverse directions. Edges also run back, and nodes
that get too many are pruned again. The index is a table of nodes with their
vectors and edges. A search runs the beam over every shard, in blocks of
queries, scores all that the beam holds by cosine in double precision, and
merges the shards' nearest; its work grows with queries times shards, so shards
are as large as a task can well build. The beam's own distances are single precision: where
two of the best scores or the best one left out are closer than its error, it
cannot tell near copies apart, and that query is compared with every vector of
the shard.

Equal vectors are one node with all its ids; of these only the few smallest can
be among the nearest, since ties go to the smaller id.

Edge cases. Vectors that are null, zero or hold null or non-finite components
take no part; vectors of different lengths are not compared. Null id: never a
query, shown as null in results. Repeated rows: each asks and is found by
itself, and a row never finds itself. Fewer candidates than asked for: all of
them (shards no larger than the beam are searched whole). Empty table: no rows.
Other columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_split
from .vectors import classes_of, dimensions, numbered, shown

#: Vectors of a shard, edges of a node after pruning and at most, beam of
#: building and searching, nodes that a step expands, slack of pruning, vectors
#: inserted at once.
SHARD, DEGREE, MOST, BUILD_BEAM, BEAM, EXPAND, ALPHA, BATCH = 16_384, 32, 48, 40, 128, 8, 1.2, 256
#: Queries of a block of a search.
QUERY_BLOCK = 50_000


def distinct(ids: np.ndarray) -> np.ndarray:
    """Rows sorted, with -1 for what repeats."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, distances) of the beam for each query, in no order; -1 fills.
    x and queries are unit vectors, a distance is the squared one, halved.
    edges: (nodes, MOST), -1 for none."""
    n, q = len(x), len(queries)
    width = min(beam, n)
    ids = np.full((q, width), -1, np.int32)
    dist = np.full((q, width), np.inf, np.float32)
    open_dist = np.full((q, width), np.inf, np.float32)  # inf once a node is expanded
    ids[:, 0], dist[:, 0] = start, 1 - queries @ x[start]
    open_dist[:, 0] = dist[:, 0]
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = True
    seen[:, n] = True  # the place of "none"
    live = np.arange(q)
    step = min(EXPAND, width)
    while True:
        own = open_dist[live]
        at = np.argpartition(own, step - 1, axis=1)[:, :step]
        some = np.isfinite(np.take_along_axis(own, at, 1))
        going = some.any(axis=1)
        live, at, some = live[going], at[going], some[going]
        if not len(live):
            break
        chosen = np.take_along_axis(ids[live], at, 1)
        open_dist[live[:, None], at] = np.inf
        near = distinct(np.where(some[:, :, None], edges[chosen], -1).reshape(len(live), -1))
        new = ~seen[live[:, None], near]  # -1 is the last place of seen
        places = max(1, int(new.sum(axis=1).max()))
        near = np.where(new, near, -1)
        if places < near.shape[1]:
            near = -np.partition(-near, places - 1, axis=1)[:, :places]
        seen[live[:, None], near] = True
        d = 1 - np.matmul(x[near], queries[live][:, :, None])[:, :, 0]
        d[near < 0] = np.inf
        all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1)
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width] if all_dist.shape[1] > width else np.broadcast_to(np.arange(width), (len(live), width))
        ids[live], dist[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_dist, best, 1)
        open_dist[live] = np.take_along_axis(np.concatenate([open_dist[live], d], 1), best, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposals: np.ndarray, alpha: float) -> np.ndarray:
    """The edges of each node from its proposals (-1 for none), DEGREE at most."""
    proposals = distinct(proposals)
    proposals[proposals == nodes[:, None]] = -1
    v = x[proposals]
    d = np.where(proposals >= 0, 1 - np.matmul(v, x[nodes][:, :, None])[:, :, 0], np.inf)
    between = 1 - v @ v.transpose(0, 2, 1)
    out = np.full((len(nodes), MOST), -1, np.int32)
    at = np.arange(len(nodes))
    for k in range(DEGREE):
        best = d.argmin(axis=1)
        some = np.isfinite(d[at, best])
        if not some.any():
            break
        out[some, k] = proposals[at, best][some]
        d[some[:, None] & (alpha**2 * between[at, best] <= d)] = np.inf
        d[at, best] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(edges, start) for unit vectors: nodes are inserted into a random graph,
    a batch after the other."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = int(np.argmax(x @ x.mean(axis=0)))
    edges = np.full((n, MOST), -1, np.int32)
    if n > 1:
        edges[:, : DEGREE // 4] = rng.integers(0, n, (n, DEGREE // 4))
        edges[edges == np.arange(n)[:, None]] = -1
    order = rng.permutation(n)
    for lo in range(0, n, BATCH):
        nodes = order[lo : lo + BATCH]
        found, _ = beam_search(x, edges, start, x[nodes], BUILD_BEAM)
        edges[nodes] = robust_prune(x, nodes, np.concatenate([found, edges[nodes]], 1), ALPHA)
        # the way back: each target with all new nodes that point to it
        source, target = np.repeat(nodes, MOST), edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        more = np.full((len(hit), count.max(initial=0)), -1, np.int32)
        more[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        for a in range(0, len(hit), BATCH):
            own = -np.sort(-distinct(np.concatenate([edges[hit[a : a + BATCH]], more[a : a + BATCH]], 1)), axis=1)
            full = own.shape[1] > MOST and own[:, MOST] >= 0
            kept = np.pad(own[:, :MOST], ((0, 0), (0, max(0, MOST - own.shape[1]))), constant_values=-1)
            if np.any(full):
                kept[full] = robust_prune(x, hit[a : a + BATCH][full], own[full], ALPHA)
            edges[hit[a : a + BATCH]] = kept
    return edges, start


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def build_index(classes: DataFrame, shards: int) -> DataFrame:
    """(shard, node, cls, least, v, edges, start): the graphs of all shards, written;
    nodes are in the order of their least id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["least", "cls"], ignore_index=True)
        x = _stack(rows["v"])
        edges, start = build_graph((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))
        return pd.DataFrame({"shard": rows["shard"], "node": np.arange(len(rows)), "cls": rows["cls"], "least": rows["least"], "v": rows["v"], "edges": list(edges), "start": np.arange(len(rows)) == start})

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("cls", "least", "v", F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int").alias("shard"))
    return cut(dealt.groupBy("shard").applyInPandas(run, f"shard int, node long, cls long, least long, v {kind}, edges array<int>, start boolean"))


def beam_best(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the best k for each query, of all that the beam found
    or, where its distances are too coarse or there are few nodes, of all nodes;
    -1 and -inf where there is none. Scores are cosines of the vectors as they
    are, in double precision; ties to the lower node."""
    norm, q_norm, width = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1), min(k, len(x))
    small = (x / norm[:, None]).astype(np.float32)
    slack = 4 * (x.shape[1] + 4) * 2.0**-24  # twice the error of a difference of two distances
    all_nodes, all_scores = np.full((len(q), width), -1), np.full((len(q), width), -np.inf)
    for a in range(0, len(q), BATCH):
        own, own_norm = q[a : a + BATCH], q_norm[a : a + BATCH]
        coarse = np.ones(len(own), bool)
        if len(x) > max(BEAM, k):
            nodes = beam_search(small, edges, start, (own / own_norm[:, None]).astype(np.float32), BEAM)[0]
            score = np.where(nodes >= 0, np.einsum("ijk,ik->ij", x[nodes], own) / (norm[nodes] * own_norm[:, None]), -np.inf)
            best = np.lexsort((nodes, -score), axis=1)
            nodes, score = np.take_along_axis(nodes, best, 1), np.take_along_axis(score, best, 1)
            top = np.where(np.isfinite(score), score, -3.0)[:, : k + 1]  # two that were not found tie as well
            coarse = (-np.diff(top, axis=1) <= slack).any(axis=1)
            fine = np.flatnonzero(~coarse)
            all_nodes[a + fine], all_scores[a + fine] = nodes[fine, :width], score[fine, :width]
        for i in np.flatnonzero(coarse):
            full = np.einsum("ijk,ik->ij", x[None], own[i : i + 1])[0] / (norm * own_norm[i])
            few = np.argpartition(-full, width - 1)[:width]
            few = np.flatnonzero(full >= full[few].min())  # with all that tie with the last
            at = few[np.argsort(-full[few], kind="stable")[:width]]
            all_nodes[a + i], all_scores[a + i] = at, full[at]
    return all_nodes, all_scores


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """(query, cls, least, score): the k nearest nodes in each shard for each (query, v)."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    graphs = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(ask):
            return pd.DataFrame({"query": [], "cls": [], "least": [], "score": []}).astype({"query": "int64", "cls": "int64", "least": "int64", "score": "float64"})
        graph = graph.sort_values("node", ignore_index=True)
        nodes, score = beam_best(_stack(graph["v"]), np.stack(graph["edges"].to_numpy()), int(np.argmax(graph["start"])), _stack(ask["v"]), k)
        row, node = np.repeat(np.arange(len(ask)), nodes.shape[1]), nodes.ravel()
        out = pd.DataFrame({"query": ask["query"].to_numpy()[row], "cls": graph["cls"].to_numpy()[node], "least": graph["least"].to_numpy()[node], "score": score.ravel()})
        return out[np.isfinite(out["score"])]

    return graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query long, cls long, least long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where
    ``is_query``, an expression over ``id``; ties to the smaller id."""
    rows = numbered(df, key, vector)
    classes = classes_of(rows)
    owner = cut(join_split(rows.where("dim is not null").select("row", "id", "h1", "h2"), classes.select("h1", "h2", "cls", "n"), ["h1", "h2"], ["row"]).select("row", "id", "cls"))
    few = Window.partitionBy("cls").orderBy("id", "row")
    members = owner.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).select("cls", F.col("id").alias("found"), F.col("row").alias("found_row"))
    asking = cut(owner.where(is_query & (F.col("id") != -(2**63))))
    out = None
    for dim in dimensions(classes):
        own = classes.where(F.col("dim") == dim).join(rows.select("row", "v"), F.col("cls") == F.col("row")).select("cls", F.col("least_id").alias("least"), "v")
        shards = max(1, -(-own.count() // SHARD))
        queries = own.join(asking.select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("query"), "v")
        found = search_index(build_index(own, shards), queries, k + 1, shards)
        out = found if out is None else out.union(found)
    if out is None:
        out = df.sparkSession.createDataFrame([], "query long, cls long, least long, score double")
    # of each class k + 1 rows at most can be among the nearest, so k + 1 classes hold all
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "cls")
    top = cut(out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    pairs = asking.select(F.col("cls").alias("query"), F.col("id").alias("asked"), F.col("row").alias("asked_row")).join(top, "query").join(members, "cls").where("asked_row <> found_row")
    rank = F.row_number().over(Window.partitionBy("asked_row").orderBy(F.desc("score"), "found", "found_row"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("asked").alias("query_id"), "rank", shown(F.col("found")).alias(key), "score")
