"""Hard negatives by anchor-clustered shared lists.

Candidates lie in shards that fit a task. Anchors are grouped into clusters by direction. For each cluster a shard sorts its
candidates once, by an upper bound on the inner product with any member: the candidate's length times the cosine of its
angle to the cluster's centre less the widest angle of a member. Every member walks that list in blocks, and stops as
soon as the bound of what is left, times its own length, lies under what it has found: nothing further on can enter.

A task holds one shard and streams the anchors past it, cluster by cluster. Two passes are made, for the positives and then,
with their scores known, for the negatives between the two shares of each; the shards' bests meet in a ranking. Scores
are inner products of integers, computed exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.staging import stage
from .integer_vectors import integer_vectors, matrix

EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # percent of the positive's score between which a negative counts as hard
SHARD_ROWS = 1 << 16
MEMBERS = 256  # anchors that share a list
DIRECTIONS = 256  # directions that anchors are grouped by; only the order of the walk depends on them
FIRST_BLOCK, LAST_BLOCK = 256, 8192

_NONE = -(1 << 62)  # below every score


class Shard:
    """Candidates of one shard and length: ids, labels, integer vectors. Rows that repeat in full count once."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        rows = np.unique(np.column_stack([ids, labels, x]), axis=0)
        self.ids, self.labels, x = rows[:, 0], rows[:, 1], rows[:, 2:]
        self.largest = int(np.abs(x).max(initial=0))
        self.x = x
        self.as_float = x.astype(np.float64)
        self.norm = np.sqrt((self.as_float**2).sum(axis=1))
        self.unit = self.as_float / np.maximum(self.norm, 1e-300)[:, None]

    def scores(self, members: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products [members, rows]: in floating point where all sums are whole numbers that it can hold."""
        if self.largest * int(np.abs(members).max(initial=0)) * members.shape[1] < 1 << 53:
            return (members.astype(np.float64) @ self.as_float[rows].T).astype(np.int64)
        return members @ self.x[rows].T

    def walk(self, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, scores, bounds): the cluster's list, block by block, with all members' scores, and for each member a number
        that no score of a later block exceeds. ``send`` takes the members that go on."""
        m = members.astype(np.float64)
        norm = np.sqrt((m**2).sum(axis=1))
        unit = m / np.maximum(norm, 1e-300)[:, None]
        centre = unit.sum(axis=0)
        centre /= max(np.sqrt((centre**2).sum()), 1e-300)
        angle = lambda cosine: np.arccos(np.clip(cosine, -1, 1))
        widest = angle((unit[norm > 0] @ centre).min(initial=1))
        bound = self.norm * np.cos(np.maximum(angle(self.unit @ centre) - widest - 1e-6, 0))
        order = np.argsort(-bound, kind="stable")
        at, size, on = 0, FIRST_BLOCK, np.arange(len(members))
        while at < len(order) and len(on):
            rows = order[at : at + size]
            at, size = at + size, min(2 * size, LAST_BLOCK)
            left = bound[order[at]] if at < len(order) else 0.0
            ceiling = norm[on] * left if at < len(order) else np.full(len(on), -np.inf)
            on = yield rows, self.scores(members[on], rows), ceiling + np.abs(ceiling) * 1e-9 + 1e-3


class Best:
    """For each of n units the ``k`` best (score, id), higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.unit, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, _NONE, np.int64)  # score that a newcomer has to reach

    def add(self, unit: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(unit):
            return
        unit, score, ids = (np.concatenate(p) for p in ((self.unit, unit), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, unit))
        unit, score, ids = unit[order], score[order], ids[order]
        place = np.arange(len(unit)) - np.searchsorted(unit, unit)
        keep = place < self.k
        self.unit, self.score, self.id = unit[keep], score[keep], ids[keep]
        full = place[keep] == self.k - 1
        self.least[self.unit[full]] = self.score[full]


def walk_positives(shard: Shard, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> Best:
    """The ``k`` best other rows of the same label for each member."""
    best, on = Best(len(ids), k), np.arange(len(ids))
    steps = shard.walk(x)
    step = next(steps, None)
    while step is not None:
        rows, scores, ceiling = step
        fit = (labels[on, None] == shard.labels[rows]) & (ids[on, None] != shard.ids[rows]) & (scores >= best.least[on, None])
        m, c = np.nonzero(fit)
        best.add(on[m], scores[m, c], shard.ids[rows[c]])
        on = on[ceiling >= best.least[on]]
        try:
            step = steps.send(on)
        except StopIteration:
            step = None
    return best


def walk_negatives(shard: Shard, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The ``k`` best rows of another label with low <= score <= high, for each member and window [members, windows]."""
    windows = low.shape[1]
    best, on = Best(low.size, k), np.arange(len(labels))
    steps = shard.walk(x)
    step = next(steps, None)
    while step is not None:
        rows, scores, ceiling = step
        other = labels[on, None] != shard.labels[rows]
        least = np.maximum(best.least.reshape(-1, windows), low)
        for w in range(windows):
            m, c = np.nonzero(other & (scores <= high[on, None, w]) & (scores >= least[on, None, w]))
            best.add(on[m] * windows + w, scores[m, c], shard.ids[rows[c]])
        least = np.maximum(best.least.reshape(-1, windows), low)[on]
        on = on[((ceiling[:, None] >= least) & (low[on] <= high[on])).any(axis=1)]
        try:
            step = steps.send(on)
        except StopIteration:
            step = None
    return best


def clusters(anchors: DataFrame, directions: int = DIRECTIONS) -> DataFrame:
    """``anchors`` with the number of the nearest of some directions, taken from a bounded number of the anchors themselves."""
    picked = anchors.orderBy(F.xxhash64("vec_id", "v")).limit(directions).select("v").collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {len(r.v) for r in picked}:
        x = np.array([r.v for r in picked if len(r.v) == dim], np.float64)
        by_dim[dim] = x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found = np.zeros(len(dims), np.int64)
            for dim in set(dims.tolist()) & set(by_dim):
                own = np.flatnonzero(dims == dim)
                x = matrix(batch.column("v").take(pa.array(own)), dim)
                found[own] = (x.astype(np.float64) @ by_dim[dim].T).argmax(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "cluster"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"{kinds}, cluster int")


def _met(candidates: DataFrame, asked: DataFrame, shards: int, answer: Callable, schema: str) -> DataFrame:
    """Rows of ``answer(shard, batch of anchors of one cluster)``: every anchor meets every shard of its length.

    A task gets whole shards, each followed by the anchors in order of their clusters; it holds one shard and at most
    ``MEMBERS`` anchors."""
    windows = F.lit(None).cast(asked.schema["windows"].dataType).alias("windows")
    held = candidates.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.size("v").alias("dim"), F.lit(0).alias("cluster"), F.lit(False).alias("asks"), "vec_id", "label", F.lit(0).cast("bigint").alias("twin"), "v", windows,
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sent = asked.select(every, "dim", "cluster", F.lit(True).alias("asks"), "vec_id", "label", "twin", "v", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts, shard, waiting = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield from answer(shard, pa.Table.from_batches(waiting).combine_chunks())
                waiting.clear()

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "dim", "asks", "cluster")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                number, dim, asks, cluster = (int(k[lo]) for k in keys)
                rows = batch.slice(lo, hi - lo)
                if (number, dim) != name:
                    yield from flush()
                    name, parts, shard = (number, dim), [], None
                if not asks:
                    parts.append(
                        (rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v"), dim))
                    )
                    continue
                if not parts and shard is None:
                    continue  # a shard without a candidate of this length
                if shard is None:
                    shard, parts = Shard(*(np.concatenate(p) for p in zip(*parts, strict=True))), []
                for at in range(0, rows.num_rows, MEMBERS):
                    some = rows.slice(at, MEMBERS)
                    if waiting and (waiting[0].column("cluster")[0].as_py() != cluster or sum(w.num_rows for w in waiting) + some.num_rows > MEMBERS):
                        yield from flush()
                    waiting.append(some)
        yield from flush()

    met = held.unionByName(sent).repartitionById(shards, "shard")
    return met.sortWithinPartitions("shard", "dim", "asks", "cluster", "vec_id", "twin").mapInArrow(run, schema)


def _rows(best: Best, of: np.ndarray, twins: np.ndarray, windows: int) -> pa.RecordBatch:
    member = best.unit // windows
    arrays = (of[member], twins[member], best.unit % windows, best.id, best.score)
    return pa.record_batch([pa.array(a, pa.int64()) for a in arrays], names=["anchor_id", "twin", "w", "vec_id", "score"])


_FOUND = "anchor_id bigint, twin bigint, w bigint, vec_id bigint, score bigint"


def hard_negatives(
    rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` (vec_id, label, v of integers).

    Anchors are rows whose vec_id is divisible by ``every``; positives are the best other rows of their label, negatives the
    best rows of another label whose score lies between ``low`` and ``high`` percent of the positive's. Higher scores
    come first, ties go to the smaller vec_id. Rows without vec_id or label take no part; rows that repeat in full count
    once; rows that share an id but differ are rows of their own, and none of them is another row to the other. Only
    vectors of one length are compared. With fewer rows than asked for all are returned; an empty table gives an
    empty table."""
    known = stage(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL"), "known")
    cores = known.sparkSession.sparkContext.defaultParallelism
    n = known.count()
    shards = max(1, -(-n // shard_rows), min(cores, n // 4096))
    anchors = known.filter(F.col("vec_id") % every == 0).distinct()
    anchors = anchors.select("vec_id", "label", "v", F.size("v").alias("dim"), F.xxhash64("label", "v").alias("twin"))
    asked = stage(clusters(stage(anchors, "anchors")), "asked")

    def first(shard: Shard, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, labels, twins = (batch.column(c).to_numpy() for c in ("vec_id", "label", "twin"))
        x = matrix(batch.column("v").combine_chunks(), batch.column("dim")[0].as_py())
        yield _rows(walk_positives(shard, ids, labels, x, positives), ids, twins, 1)

    order = Window.partitionBy("anchor_id", "twin").orderBy(F.desc("score"), "vec_id")
    found = _met(known, asked.withColumn("windows", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>")), shards, first, _FOUND)
    best = found.withColumn("w", F.row_number().over(order) - 1).filter(F.col("w") < positives)
    # low * score <= 100 * negative <= high * score, in whole numbers
    s = F.col("score")
    down = lambda p: (s * p - F.pmod(s * p, F.lit(100))) / 100
    up = lambda p: (s * p + F.pmod(-s * p, F.lit(100))) / 100
    chosen = stage(
        best.select("anchor_id", "twin", "w", F.col("vec_id").alias("positive_id"), s.alias("positive_score"), up(low).cast("bigint").alias("lo"), down(high).cast("bigint").alias("hi")),
        "positives",
    )

    def second(shard: Shard, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, labels, twins = (batch.column(c).to_numpy() for c in ("vec_id", "label", "twin"))
        x = matrix(batch.column("v").combine_chunks(), batch.column("dim")[0].as_py())
        lo, hi = np.zeros((len(ids), positives), np.int64), np.full((len(ids), positives), -1, np.int64)
        for row, windows in enumerate(batch.column("windows").to_pylist()):
            for w, window in enumerate(windows):
                lo[row, w], hi[row, w] = window["lo"], window["hi"]
        yield _rows(walk_negatives(shard, labels, x, lo, hi, negatives), ids, twins, positives)

    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id"), "twin").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("ws"))
    windows = windows.select("vec_id", "twin", F.transform("ws", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"))).alias("windows"))
    hard = _met(known, asked.join(windows, ["vec_id", "twin"]), shards, second, _FOUND)
    place = Window.partitionBy("anchor_id", "twin", "w").orderBy(F.desc("score"), "vec_id")
    ranked = hard.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "twin", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mined(vectors: DataFrame) -> DataFrame:
    """Hard negatives of a table (vec_id, label, embedding), after the label of every id divisible by 7 has moved on by one.

    Rows whose vector is null, empty or holds null or non-finite components take no part; for the rest see
    ``hard_negatives``. Other columns are ignored."""
    label, vec_id = F.col("`label`").cast("bigint"), F.col("`vec_id`").cast("bigint")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(integer_vectors(vectors, label=moved))


# The same rows for DuckDB, by scoring every anchor with every row.
NEGATIVES_SQL = f"""
WITH k AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, a.v AS av, c.vec_id, c.label, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM k a JOIN k c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, al, av ORDER BY score DESC, vec_id) AS i
  FROM s WHERE al = label) WHERE i <= {POSITIVES}),
h AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.al, p.av, p.i ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id, al, av) WHERE s.label <> s.al
  AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= {NEGATIVES}
"""
