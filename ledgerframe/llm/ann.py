"""Operator 6: approximate nearest neighbours on robust-pruned graphs, one per shard.

Vectors are dealt at random into shards of bounded size.  In each shard a directed
graph is built: greedy searches from the medoid propose neighbours, and pruning
with a relaxed distance keeps those that no kept neighbour already covers.  A query is
searched with a beam in every shard, and the shards' best are merged.  A task opens some
shards and lets all queries pass by them.  Vectors of one
direction are one node, so that copies cannot fill a neighbourhood; all vectors of the
nodes in the beam are ranked.  Scores are cosines of the original vectors in double
precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, cut, sliced

DEGREE, BEAM, ALPHA, SHARD_ROWS, BLOCK = 28, 160, 1.2, 16384, 1024
#: Unit vectors nearer than this are one node: scaled copies differ by their rounding only.
SAME = 1e-5
#: Tasks that search, once there are as many shards; each gets all queries.  Bytes of shards that one holds open.
TASKS, HELD = 64, 192 << 20


def beam_search(unit: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, seen_too: bool = False):
    """Beams of all queries at once: ids and squared distances, nearest first, (queries, beam).

    ``graph`` holds -1 where a node has fewer neighbours.  With ``seen_too`` the ids
    that were expanded come as well, in order, -1 where there are none.
    """
    m, n = len(queries), len(unit)
    ids, dist = np.full((m, beam), -1), np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = 2 - 2 * queries @ unit[start]
    met = np.zeros((m, n + 1), bool)
    met[:, start] = met[:, n] = True
    rows, expanded = np.arange(m), []
    while len(rows):
        at = done[rows].argmin(1)  # beams are sorted: the first not yet expanded is the nearest
        node = ids[rows, at]
        done[rows, at] = True
        if seen_too:
            step = np.full(m, -1)
            step[rows] = node
            expanded.append(step)
        near = graph[node]
        near = np.where(near < 0, n, near)
        old = met[rows[:, None], near]
        met[rows[:, None], near] = True
        d = 2 - 2 * np.einsum("mrd,md->mr", unit[np.minimum(near, n - 1)], queries[rows])
        d[old] = np.inf
        all_ids = np.concatenate([ids[rows], near], 1)
        all_d = np.concatenate([dist[rows], d.astype(np.float32)], 1)
        all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        ids[rows], dist[rows] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
        done[rows] = np.take_along_axis(all_done, order, 1) | np.isinf(dist[rows])
        rows = rows[~done[rows].all(1)]
    return (ids, dist, np.stack(expanded, 1)) if seen_too else (ids, dist)


def robust_prune(unit: np.ndarray, nodes: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to ``degree`` of each node's candidates ``near`` (-1: none): the nearest is kept and
    removes what lies ``alpha`` times nearer to it than to the node, again and again."""
    gone = (near < 0) | (near == nodes[:, None])
    vectors = unit[np.maximum(near, 0)]
    d = 2 - 2 * np.einsum("mcd,md->mc", vectors, unit[nodes])
    d[gone] = np.inf
    out = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        at = d.argmin(1)
        alive = np.isfinite(d[rows, at])
        if not alive.any():
            break
        best = np.where(alive, near[rows, at], -1)
        out[:, k] = best
        between = 2 - 2 * np.einsum("mcd,md->mc", vectors, unit[np.maximum(best, 0)])
        drop = (alpha * alpha * between <= d) | (near == best[:, None])  # squared distances
        d[drop & alive[:, None]] = np.inf
    return out


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = 48, batch: int = 512, seed: int = 3) -> tuple[np.ndarray, int]:
    """(neighbours, start node) of unit vectors, all different."""
    n = len(unit)
    rng = np.random.default_rng(seed)
    degree = min(degree, max(1, n - 1))
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, 1), -1)
    start = int((unit @ unit.mean(0)).argmax())
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            nodes = order[i : i + batch]
            ids, _, seen = beam_search(unit, graph, start, unit[nodes], beam, seen_too=True)
            graph[nodes] = robust_prune(unit, nodes, _distinct(np.concatenate([ids, seen, graph[nodes]], 1)), alpha, degree)
            # back edges: those they point to get them as candidates
            to, of = graph[nodes].ravel(), np.repeat(nodes, degree)
            to, of = to[to >= 0], of[graph[nodes].ravel() >= 0]
            by = np.argsort(to, kind="stable")
            to, of = to[by], of[by]
            who, first, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(who), int(count.max()) if len(who) else 0), -1)
            more[np.repeat(np.arange(len(who)), count), np.arange(len(to)) - np.repeat(first, count)] = of
            for j in range(0, len(who), batch):
                part = who[j : j + batch]
                both = np.concatenate([graph[part], more[j : j + batch]], 1)
                graph[part] = robust_prune(unit, part, _distinct(both), alpha, degree)
    return graph, start


def _distinct(ids: np.ndarray) -> np.ndarray:
    """Each row sorted, repeats set to -1."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def one_direction(x: np.ndarray) -> np.ndarray:
    """The number of each vector's node: vectors of one direction share it.

    Vectors are sorted by one projection, along which those of one direction lie
    together, and each is held against the nodes within reach.
    """
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = unit @ (lambda w: w / np.linalg.norm(w))(np.random.default_rng(11).normal(size=x.shape[1]))
    order, node = np.argsort(at, kind="stable"), np.full(len(x), -1)
    places, made = at[order], 0
    until = np.searchsorted(places, places + SAME, "right")
    for k, i in enumerate(order.tolist()):
        if node[i] < 0:
            near = order[k : until[k]]
            near = near[node[near] < 0]
            node[near[((unit[near] - unit[i]) ** 2).sum(1) <= SAME * SAME]] = made
            made += 1
    return node


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: no null, non-finite or all-zero ones."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))


def local_nodes(vectors: DataFrame, per_node: int) -> DataFrame:
    """Different vectors of each task with their smallest ``per_node`` ids: copies leave a task as one row."""

    def run(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = found.setdefault(np.array(v, np.float64).tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > 4 * per_node:
                        ids[:] = sorted(ids)[:per_node]
        rows = [(v, sorted(ids)[:per_node], len(v) // 8) for v, ids in found.items()]
        for at in range(0, len(rows), 4000):
            part = rows[at : at + 4000]
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], k) for c, k in enumerate(kinds)], ["v", "ids", "dim"])

    return usable(vectors).mapInArrow(run, "v binary, ids array<long>, dim int")


INDEX = "dim int, shard int, nodes int, rows int, degree int, start int, vectors binary, ids binary, owner binary, graph binary"


def build_index(nodes: DataFrame, shards: int, per_node: int) -> DataFrame:
    """One row of bounded size per (dimension, shard): vectors sorted by node, their ids, and the nodes' graph.

    Equal vectors meet in one shard, which is chosen by the vector.
    """

    def run(t: pa.Table) -> pa.Table:
        found: dict[bytes, set[int]] = {}
        for v, ids in zip(t.column("v").to_pylist(), t.column("ids").to_pylist()):
            found.setdefault(v, set()).update(ids)
        keys = sorted(found)
        x = np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1)
        node = one_direction(x)
        order = np.argsort(node, kind="stable")
        ids = [(i, row) for row, k in enumerate(order.tolist()) for i in sorted(found[keys[k]])[:per_node]]
        x, node = x[order], node[order]
        first = np.searchsorted(node, np.arange(node[-1] + 1))
        graph, start = build_graph(_unit(x[first]))
        row = [t.column("dim")[0].as_py(), t.column("shard")[0].as_py(), len(first), len(x), graph.shape[1], start, x.tobytes(), np.array(ids, np.int64).tobytes(), node.astype(np.int64).tobytes(), graph.astype(np.int32).tobytes()]
        kinds = [pa.int32()] * 6 + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], [f.split(" ")[0] for f in INDEX.split(", ")])

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, "shard").groupBy("dim", "shard").applyInArrow(run, INDEX)


def _blocks(queries: DataFrame, size: int) -> DataFrame:
    """Queries in blocks of at most ``size`` of one dimension."""
    rows = usable(queries)
    parts = max(1, -(-rows.count() // size))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = held.setdefault(len(v), [])
                block.append((i, v))
                if len(block) == size:
                    yield sent(held.pop(len(v)))
        for block in held.values():
            yield sent(block)

    def sent(block):
        ids, x = np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64)
        return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["dim", "query_ids", "queries"])

    return rows.repartition(parts, "vec_id").mapInArrow(run, "dim int, query_ids binary, queries binary")


def _together(index: DataFrame, shards: int) -> int:
    """How many shards a task holds: TASKS tasks in all if the largest of its shards would fit HELD bytes."""
    size = F.col("rows") * F.col("dim").cast("long") * 8 + F.col("nodes") * (F.col("dim").cast("long") * 4 + F.col("degree") * 4)
    most = index.agg(F.max(size)).first()[0] or 1
    return max(1, min(-(-shards // TASKS), HELD // most))


def knn(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found by cosine, ties to the smaller vec_id.

    Null, zero and non-finite vectors and null ids take no part; vectors of another
    length than a query's are no candidates for it; a row with the query's own id is
    none either.  A repeated vec_id counts once, with its best score.  Fewer than
    ``k`` candidates give fewer rows, empty tables none; other columns are ignored.
    """
    per_node = k + 1  # the query's own id may be among them
    with Scratch(vectors.sparkSession) as scratch:
        nodes = scratch.cut(local_nodes(vectors, per_node), "ann-nodes")
        shards = max(1, -(-nodes.count() // shard_rows))
        index = scratch.cut(build_index(nodes, shards, per_node), "ann-index")
        together = _together(index, shards)
        parts = -(-shards // together)
        blocks = _blocks(queries, BLOCK).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        # A part's shards come first, then every query block, once.  No join: its sides are far larger than
        # Spark takes them for (the copies for the parts are made after the last exchange), so it may broadcast one.
        met = index.withColumn("part", F.floor(F.col("shard") / together).cast("int")).unionByName(blocks, allowMissingColumns=True)
        met = met.repartitionById(parts, "part").sortWithinPartitions("part", "dim", F.col("shard").asc_nulls_last())

        def run(batches):
            of, held = None, []
            for batch in sliced(batches):
                for row in batch.to_pylist():
                    if of != (row["part"], row["dim"]):
                        of, held = (row["part"], row["dim"]), []
                    if row["shard"] is not None:
                        held.append(_Shard(row))
                    elif held:
                        q = np.frombuffer(row["queries"], np.float64).reshape(-1, row["dim"])
                        out = nearest(held, np.frombuffer(row["query_ids"], np.int64), q, k, beam)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

        found = met.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return cut(found.withColumn("rank", number).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-nearest")


class _Shard:
    """A shard's row, opened for searches."""

    def __init__(self, row: dict) -> None:
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(row["rows"], -1)
        self.norms = np.linalg.norm(self.x, axis=1)
        node = np.frombuffer(row["owner"], np.int64)
        self.first = np.searchsorted(node, np.arange(row["nodes"] + 1))  # the vectors of a node lie together
        ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 2)
        self.ids, self.ids_at = ids[:, 0], np.searchsorted(ids[:, 1], np.arange(row["rows"] + 1))
        self.unit, self.start = _unit(self.x[self.first[:-1]]), row["start"]
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(row["nodes"], -1)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[list, list, list]:
        """(numbers of the queries, ids, scores) of the ``k`` best of each query."""
        out: tuple[list, list, list] = [], [], []
        for at in range(0, len(own), 256):
            part = queries[at : at + 256]
            found, _ = beam_search(self.unit, self.graph, self.start, _unit(part), beam)
            for n, (i, v, near) in enumerate(zip(own[at : at + 256].tolist(), part, found), at):
                near = near[near >= 0]
                rows = _ranges(self.first[near], self.first[near + 1])
                score = (self.x[rows] * v).sum(1) / (self.norms[rows] * np.linalg.norm(v))
                some = np.repeat(score, self.ids_at[rows + 1] - self.ids_at[rows])
                ids = self.ids[_ranges(self.ids_at[rows], self.ids_at[rows + 1])]
                some, ids = some[ids != i], ids[ids != i]
                best = np.lexsort((ids, -some))
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])[:k]]  # an id counts once, with its best score
                out[0].extend([n] * len(best))
                out[1].extend(ids[best].tolist())
                out[2].extend(some[best].tolist())
        return out


def nearest(shards: list[_Shard], own: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of the ``k`` best that the shards have for each query, ``own`` its id."""
    found = [s.search(own, queries, k, beam) for s in shards]
    at, ids, score = (np.array([x for f in found for x in f[c]], kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))
    by = np.lexsort((-score, ids, at))
    by = by[np.r_[True, (at[by][1:] != at[by][:-1]) | (ids[by][1:] != ids[by][:-1])][: len(by)]]  # an id counts once, with its best score
    by = by[np.lexsort((ids[by], -score[by], at[by]))]
    by = by[np.arange(len(by)) - np.searchsorted(at[by], at[by]) < k]
    return own[at[by]], ids[by], score[by]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
