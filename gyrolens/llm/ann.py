"""Approximate nearest neighbours by robust-pruned directed graphs (operator 7).

Vectors are dealt to shards by their id, so neither the table nor a group of equal vectors lands in one task. The number of
shards grows as the square root of the number of rows, one up to ``shard_rows`` of them, or faster where vectors of a shard would exceed
``shard_bytes``; every shard has a task of its own. A shard collapses equal vectors to one node with all their ids and builds a graph: in random
order, in batches that grow with the graph and then once more over all, a greedy search for each node proposes what it visits as neighbours; robust
pruning with a relaxed distance keeps the nearest and drops what a kept neighbour is closer to by the factor ``alpha``;
kept edges are also added backwards, and lists that grow too long are pruned in the same way. Every query is searched in every
shard by beam search; distances of what the beams hold are then taken exactly on the original vectors, in double
precision, and the best of all shards are merged.

Within a shard vectors are doubles about their componentwise median, so neither a common offset nor a few huge values cost
precision. Queries stream through a shard's task in blocks, so memory is bounded by one shard and one block.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds null or non-finite components,
take no part. Only vectors of the query's dimension are its candidates. Rows with the query's id are its own and
never found. Of rows that repeat an id with different vectors, the smallest vector (in array order) counts. Ties in distance go to the
smaller id. Fewer candidates than k give fewer rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.llm.common import materialise

SHARD_ROWS = 8192
#: Bytes of a shard's vectors at most.
SHARD_BYTES = 256 << 20
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 192
ALPHA = 1.2
#: Nodes expanded at once in a search.
WIDTH = 4
BLOCK = 256
SEED = 7

INDEX_SCHEMA = "shard long, kind int, node int, vec_ids array<long>, vector array<double>, neighbours array<int>"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


class Graph:
    """Nodes with vectors (about a centre), out-neighbours (-1: none) and a start node."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None, degree: int = DEGREE):
        self.centre = np.median(vectors, axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        self.x = vectors - self.centre
        self.norms = np.einsum("nd,nd->n", self.x, self.x)
        self.start = int(np.argmin(self.norms)) if len(vectors) else 0
        self.neighbours = np.full((len(vectors), degree), -1, np.int32) if neighbours is None else neighbours

    def about(self, q: np.ndarray) -> np.ndarray:
        return q - self.centre

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for a block of queries: ids and squared distances (-1 and inf: none), nearest first."""
        b, n = len(q), len(self.x)
        rows = np.arange(b)
        qn = np.einsum("bd,bd->b", q, q)
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)  # the last column stands for "none"
        seen[:, n] = True
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        dist[:, 0] = qn + self.norms[self.start] - 2 * (q @ self.x[self.start])
        while len(rows):
            open_at = np.argsort(done[rows], axis=1, kind="stable")[:, :WIDTH]
            chosen = np.take_along_axis(ids[rows], open_at, 1)
            chosen[np.take_along_axis(done[rows], open_at, 1)] = -1
            done[rows[:, None], open_at] = True
            near = np.where(chosen[:, :, None] >= 0, self.neighbours[chosen], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(near < 0, n, near)
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            most = int(fresh.sum(axis=1).max())
            if most:
                at = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
                new, ok = np.take_along_axis(near, at, 1), np.take_along_axis(fresh, at, 1)
                safe = np.where(ok, new, 0)
                d = qn[rows, None] + self.norms[safe] - 2 * np.matmul(self.x[safe], q[rows][:, :, None])[:, :, 0]
                d[~ok | np.isnan(d)] = np.inf  # squares of huge values overflow
                all_d = np.concatenate([dist[rows], d], axis=1)
                order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
                dist[rows] = np.take_along_axis(all_d, order, 1)
                ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(ok, new, -1)], axis=1), order, 1)
                done[rows] = np.take_along_axis(np.concatenate([done[rows], ~ok], axis=1), order, 1)
            rows = rows[~done[rows].all(axis=1)]
        return ids, dist

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning for a block of nodes: up to ``degree`` of each row's candidates (-1: none, no repeats)."""
        degree = self.neighbours.shape[1]
        bad = (candidates < 0) | (candidates == nodes[:, None])
        safe = np.where(bad, 0, candidates)
        v = self.x[safe]
        own = self.norms[nodes][:, None] + self.norms[safe] - 2 * np.matmul(v, self.x[nodes][:, :, None])[:, :, 0]
        own[bad | np.isnan(own)] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        own, safe = np.take_along_axis(own, order, 1), np.take_along_axis(safe, order, 1)
        v = self.x[safe]
        norm = self.norms[safe]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(own)
        kept = np.full((len(nodes), degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for i in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            kept[some, i] = safe[rows, first][some]
            alive &= ~((alpha * alpha * between[rows, first] <= own) & some[:, None])
            alive[rows, first] = False
        return kept

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, block: int = BLOCK, seed: int = SEED) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32)
        at = 1
        while at < n:
            nodes = order[at : at + min(block, at)]
            at += len(nodes)
            self._link(nodes, beam, alpha, block)
        for at in range(0, n, block):  # once more, now that the graph holds all nodes
            self._link(order[at : at + block], beam, alpha, block)
        return self

    def _link(self, nodes: np.ndarray, beam: int, alpha: float, block: int) -> None:
        ids, _ = self.search(self.x[nodes], beam)
        held = self.neighbours[nodes]
        again = (held[:, :, None] == ids[:, None, :]).any(axis=2)
        kept = self.prune(nodes, np.concatenate([ids, np.where(again, -1, held)], axis=1), alpha)
        self.neighbours[nodes] = kept
        self._add_backwards(np.repeat(nodes, kept.shape[1]), kept.ravel(), alpha, block)

    def _add_backwards(self, sources: np.ndarray, targets: np.ndarray, alpha: float, block: int) -> None:
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        nodes, starts, counts = np.unique(targets, return_index=True, return_counts=True)
        degree = self.neighbours.shape[1]
        held = (self.neighbours[nodes] >= 0).sum(axis=1)
        by = np.argsort(held + counts, kind="stable")
        for first in range(0, len(by), block):
            part = by[first : first + block]
            wide = int((held[part] + counts[part]).max())
            lists = np.full((len(part), max(wide, degree)), -1, np.int32)
            lists[:, :degree] = self.neighbours[nodes[part]]
            for row, i in enumerate(part):
                new = sources[starts[i] : starts[i] + counts[i]]
                new = new[~np.isin(new, lists[row, : held[i]])]
                lists[row, held[i] : held[i] + len(new)] = new
            self.neighbours[nodes[part]] = lists if wide <= degree else self.prune(nodes[part], lists, alpha)


def _arrays(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows) for each stretch of rows; the first two columns are shard and kind."""
    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(keys[a, 0]), int(keys[a, 1]), batch.slice(a, b - a)


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of each distinct vector, ascending, and the distinct vectors. One vector, the smallest, for each id."""
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    if not first.all():
        by = np.lexsort([*vectors.T[::-1], ids])
        ids, vectors = ids[first], vectors[by][first]
    unique, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")
    return np.split(ids[by], np.flatnonzero(np.diff(inverse[by])) + 1), unique


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = _distinct(np.concatenate([p.column(2).to_numpy() for p in parts]), np.concatenate([_arrays(p.column(3)) for p in parts]))
        graph = Graph(vectors).build()
        n = len(ids)
        for a in range(0, n, 2048):
            b = min(n, a + 2048)
            yield pa.record_batch({
                "shard": pa.array(np.full(b - a, shard)), "kind": pa.array(np.zeros(b - a, np.int32)), "node": pa.array(np.arange(a, b, dtype=np.int32)), "vec_ids": pa.array([x.tolist() for x in ids[a:b]], pa.list_(pa.int64())),
                "vector": pa.array(list(vectors[a:b]), pa.list_(pa.float64())), "neighbours": pa.array(list(graph.neighbours[a:b]), pa.list_(pa.int32())),
            })

    now, parts = None, []
    for shard, _, rows in _by_shard(batches):
        if shard != now and parts:
            yield from finish(now, parts)
            parts = []
        now = shard
        parts.append(rows)
    if parts:
        yield from finish(now, parts)


class _Shard:
    """A shard read back from the index."""

    def __init__(self, parts: list[pa.RecordBatch]):
        nodes = np.concatenate([p.column(2).to_numpy() for p in parts])
        by = np.argsort(nodes)
        lists = [x for p in parts for x in p.column(3).to_pylist()]
        self.ids = [lists[i] for i in by]
        self.vectors = np.concatenate([_arrays(p.column(4)) for p in parts])[by]
        self.graph = Graph(self.vectors, np.concatenate([_arrays(p.column(5)) for p in parts])[by].astype(np.int32))

    def nearest(self, own: int, q: np.ndarray, nodes: np.ndarray, k: int) -> list[tuple[int, float]]:
        score = np.sqrt(((self.vectors[nodes] - q) ** 2).sum(axis=1))
        found: list[tuple[float, int]] = []
        for s, node in sorted(zip(score.tolist(), nodes.tolist())):
            if len(found) >= k and s > found[k - 1][0]:
                break
            found += [(s, i) for i in [i for i in self.ids[node][: k + 1] if i != own][:k]]
            found.sort()
        return [(i, s) for s, i in found[:k]]


def _search(batches: Iterator[pa.RecordBatch], k: int, beam: int) -> Iterator[pa.RecordBatch]:
    now, parts, shard = None, [], None
    for key, kind, rows in _by_shard(batches):
        if key != now:
            now, parts, shard = key, [], None
        if kind == 0:
            parts.append(rows)
            continue
        if shard is None:
            if not parts:
                continue
            shard, parts = _Shard(parts), []
        ids, vectors = [x[0] for x in rows.column(3).to_pylist()], _arrays(rows.column(4))
        for a in range(0, len(ids), BLOCK):
            q = vectors[a : a + BLOCK]
            found, _ = shard.graph.search(shard.graph.about(q), max(beam, k + 1))
            out = [(own, *x) for own, v, nodes in zip(ids[a : a + BLOCK], q, found) for x in shard.nearest(own, v, nodes[nodes >= 0], k)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    ok: Column = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))


def _key(n_shards: int, shard: Column) -> Column:
    """Shards of one dimension: dimension * n_shards + shard."""
    return F.size("vector").cast("long") * n_shards + shard


def _a_task_each(rows: DataFrame, n_shards: int) -> DataFrame:
    """Rows by shard, each shard in a partition of its own."""
    return rows.repartitionById(n_shards, F.pmod("shard", F.lit(n_shards)).cast("int"))


def shards_for(n: int, components: int, shard_rows: int, shard_bytes: int) -> int:
    """Shards for n vectors with so many components in all. Each query goes to each shard, so they grow more slowly than n."""
    return max(1, math.ceil(math.sqrt(n / shard_rows)), math.ceil(8 * components / shard_bytes))


def build_index(vectors: DataFrame, n_shards: int) -> DataFrame:
    """A row for each distinct vector of a shard (see INDEX_SCHEMA), written to the shared folder."""
    dealt = vectors.select(_key(n_shards, F.pmod(F.xxhash64("vec_id"), F.lit(n_shards))).alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector")
    return materialise(_a_task_each(dealt, n_shards).sortWithinPartitions("shard").mapInArrow(_build, INDEX_SCHEMA), "graph")


def search(index: DataFrame, queries: DataFrame, n_shards: int, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query (vec_id, vector)."""
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    dealt = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select(
        _key(n_shards, F.col("s")).alias("shard"), F.lit(1).alias("kind"), F.lit(0).alias("node"), F.array("vec_id").alias("vec_ids"), "vector", F.array().cast("array<int>").alias("neighbours")
    )
    both = _a_task_each(index.unionByName(dealt), n_shards).sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(lambda batches: _search(batches, k, beam), FOUND_SCHEMA)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, k: int = 10, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Indexes every valid row of df and searches those for which is_query holds."""
    vectors = valid_vectors(df, id_col, vector_col)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("components")).first()
    n_shards = shards_for(size["n"], size["components"], shard_rows, shard_bytes)
    return search(build_index(vectors, n_shards), valid_vectors(df.where(is_query), id_col, vector_col), n_shards, k)
