"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Equal vectors are one node that carries its smallest ids. A shard's graph is built in batches: greedy beam searches on the
graph so far propose neighbours, relaxed pruning keeps those that no kept one makes redundant, and reverse edges are pruned
likewise. A question is put to every shard by beam search; what the beams hold is measured again on the original vectors
in double precision, and the best of all shards are the answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.staging import stage

SHARD_ROWS = 6000
DEGREE = 32
BUILD_WIDTH = 48
SEARCH_WIDTH = 100
RELAX = 1.2
BATCH = 1000
EXPANDED = 4  # beam entries that are opened at once
BLOCK = 1000  # questions that are put to a shard at once
TOP = 10


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(beam, opened): for each asked vector the ids of the nearest nodes met, nearest first, and of those opened; -1 pads."""
    n, rows = len(asked), np.arange(len(asked))[:, None]
    beam = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    beam[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = ((asked - x[entry]) ** 2).sum(axis=1)
    opened = []
    while True:
        order = np.argsort(np.where(done, np.inf, dist), axis=1, kind="stable")[:, :EXPANDED]
        fresh = ~done[rows, order]
        if not fresh.any():
            break
        nodes = np.where(fresh, beam[rows, order], -1)
        done[rows, order] = True
        opened.append(nodes)
        near = np.where(nodes[:, :, None] >= 0, graph[nodes], -1).reshape(n, -1)
        near = np.where((near >= 0) & ~seen[rows, near], near, -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        hit = near >= 0
        at, which = np.nonzero(hit)
        seen[at, near[at, which]] = True
        gap = np.full(near.shape, np.inf, np.float32)
        diff = x[near[at, which]] - asked[at]
        gap[at, which] = np.einsum("ij,ij->i", diff, diff)
        all_ids, all_dist = np.concatenate([beam, near], axis=1), np.concatenate([dist, gap], axis=1)
        all_done = np.concatenate([done, ~hit], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
        beam, dist, done = all_ids[rows, best], all_dist[rows, best], all_done[rows, best]
    return beam, np.concatenate(opened, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """[len(points), degree] neighbours out of candidate ids (-1 pads): nearest first, each dropping those it makes redundant."""
    n, rows = len(points), np.arange(len(points))
    c = np.sort(candidates, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == points[:, None]] = -1
    gap = ((x[c] - x[points][:, None, :]) ** 2).sum(axis=2)
    gap[c < 0] = np.inf
    out = np.full((n, degree), -1, np.int64)
    for k in range(degree):
        pick = gap.argmin(axis=1)
        alive = np.isfinite(gap[rows, pick])
        if not alive.any():
            break
        out[alive, k] = c[rows, pick][alive]
        between = ((x[c] - x[c[rows, pick]][:, None, :]) ** 2).sum(axis=2)
        gap[relax * relax * between <= gap] = np.inf
        gap[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """(graph [n, degree] of node numbers or -1, entry): the entry is the node nearest to the mean."""
    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        points = order[at : at + size]
        beam, opened = beam_search(x, graph, entry, x[points], width)
        graph[points] = robust_prune(x, points, np.concatenate([beam, opened], axis=1), degree, relax)
        source, place = np.nonzero(graph[points] >= 0)
        target, back = graph[points][source, place], points[source]
        by = np.argsort(target, kind="stable")
        target, back = target[by], back[by]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), BATCH):  # all reverse edges of a node at once
            some, begin, many = (a[lo : lo + BATCH] for a in (nodes, first, counts))
            new = np.full((len(some), int(many.max())), -1, np.int64)
            row = np.repeat(np.arange(len(some)), many)
            col = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            new[row, col] = back[np.repeat(begin, many) + col]
            both = np.concatenate([graph[some], new], axis=1)
            full = (both >= 0).sum(axis=1) > degree
            if full.any():
                graph[some[full]] = robust_prune(x, some[full], both[full], degree, relax)
            packed = -np.sort(-both[~full], axis=1)[:, :degree]
            graph[some[~full]] = packed
        at += len(points)
        size = min(2 * size, BATCH)
    return graph, entry


def vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows that take part: named, and a vector with a length, all of it finite numbers."""
    inf = float("inf")
    clean = rows.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)) & F.exists("v", lambda c: c != 0)
    return clean.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def build_index(rows: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, dim, entry, nodes, vectors, graph, id_ends, ids): one row for each shard, its arrays packed.

    All vectors are indexed. Of equal vectors, the ``top`` + 1 smallest ids are kept, more than any answer can name."""
    first = Window.partitionBy("v").orderBy("vec_id")
    named = rows.distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top + 1)
    nodes = stage(named.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("ids").to_pylist()
        x = np.array(group.column("v").to_pylist(), np.float64)
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        x, ids = x[order], [ids[i] for i in order]
        graph, entry = build_graph(x.astype(np.float32))
        ends = np.cumsum([len(i) for i in ids]).astype(np.int64)
        return pa.table(
            {
                "shard": group.column("shard")[:1],
                "dim": group.column("dim")[:1],
                "entry": pa.array([entry], pa.int64()),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                "id_ends": pa.array([ends.tobytes()], pa.binary()),
                "ids": pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()),
            }
        )

    dealt = nodes.select(
        F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "v", "ids"
    )
    return stage(
        dealt.groupBy("shard", "dim").applyInArrow(
            build, "shard int, dim int, entry bigint, vectors binary, graph binary, id_ends binary, ids binary"
        ),
        "index",
    )


class _Shard:
    """One shard as a task holds it."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.x, self.ids = get("vectors", np.float64).reshape(-1, row["dim"]), get("ids", np.int64)
        self.ends, self.entry = get("id_ends", np.int64), row["entry"]
        self.graph = get("graph", np.int32).reshape(len(self.x), -1).astype(np.int64)
        self.small = self.x.astype(np.float32)

    def answer(self, own: list[int], q: np.ndarray, top: int, width: int) -> list[tuple[int, int, float]]:
        """(question, id, distance): what the beams hold, measured again in double precision, ``top`` for each question."""
        beam, _ = beam_search(self.small, self.graph, self.entry, q.astype(np.float32), width)
        out = []
        for name, v, nodes in zip(own, q, beam, strict=True):
            nodes = nodes[nodes >= 0]
            exact = np.sqrt(((self.x[nodes] - v) ** 2).sum(axis=1))
            found = [
                (float(d), int(i))
                for n, d in zip(nodes, exact, strict=True)
                for i in self.ids[(self.ends[n - 1] if n else 0) : self.ends[n]]
                if i != name
            ]
            out += [(name, i, d) for d, i in sorted(found)[:top]]
        return out


def search(index: DataFrame, asked: DataFrame, top: int = TOP, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``asked`` (vec_id, v): every question goes to every shard.

    The index is shuffled once: a task gets whole shards, each followed by the questions, and holds one shard and ``BLOCK``
    questions at a time, however many there are."""
    n = max(1, index.count())
    shards = index.select("shard", "dim")
    sent = asked.join(shards, F.size("v") == F.col("dim")).select("shard", "dim", F.lit(True).alias("asks"), "vec_id", "v")
    held = index.withColumn("asks", F.lit(False))
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(asks[1:] != asks[:-1]) + 1), len(asks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and not asks[lo]:
                    shard = _Shard(batch.slice(hi - 1, 1).to_pylist()[0])  # of shards that nobody asks only the last counts
                    continue
                for at in range(lo, hi, BLOCK):
                    some = batch.slice(at, min(BLOCK, hi - at))
                    q = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    out = shard.answer(some.column("vec_id").to_pylist(), q, top, width)
                    yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    together = held.unionByName(sent, allowMissingColumns=True).repartition(n, "shard", "dim")
    met = together.sortWithinPartitions("shard", "dim", "asks").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= top)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def nearest(rows: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """The ``top`` nearest other rows of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without vec_id. Rows that
    repeat id and vector count once; a question never finds its own id. Only vectors of one length are compared. Ties go
    to the smaller vec_id. With fewer candidates than ``top`` all are returned; an empty table gives an empty table."""
    known = stage(vectors(rows), "vectors")
    return search(build_index(known, top), known.filter(F.col("vec_id") % every == 0).distinct(), top)
