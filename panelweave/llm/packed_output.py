"""Token-id output: documents packed into fixed rows by best fit decreasing, with the matrices a trainer reads.

The sequence with the least room that still holds a piece is found in a segment tree over room sizes. All pieces of a length are
placed at once, sequences with equal room side by side, which gives exactly what placing them one by one would give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .pieces import CAPACITY, Plan, packed, pieces

VOCABULARY = "byte_bpe_50k.json"
END_ID = 50256
PAD_ID = END_ID


class Rooms:
    """How many sequences have each room, in a segment tree that finds the least room of at least a size."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at //= 2

    def least(self, size: int) -> int | None:
        at = size + self.leaves
        if size >= self.leaves:
            return None
        while not self.tree[at]:
            while at % 2:  # a right child: go on above it
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Longest pieces first, each into the fullest sequence that holds it."""
    rooms, groups, rows, sequences = Rooms(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            groups.setdefault(room, []).append((first, n))
            rooms.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.least(length)
            if room is None:
                room, first, n = capacity, sequences, left  # as many new ones as could be needed
                fresh = True
            else:
                (first, n), fresh = groups[room].pop(), False
                rooms.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, rank + full * each, each, first, capacity - room))
                put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            used = full
            if full < n and 0 < left < each:
                rows.append((length, rank, rank + left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            if fresh:
                sequences += used
            else:
                put(room, first + used, n - used)
    return Plan(rows, sequences)


def packed_matrices(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID
) -> DataFrame:
    """One row for each sequence: sequence_id, n_tokens, doc_ids and pieces (of its segments), cu_seqlens (0 and the end of
    each segment), ids (``capacity`` little-endian signed 32-bit ids, padded) and positions (likewise, from 0 in every
    segment, 0 in the padding). Write it with ``DataFrame.write``; ``numpy.frombuffer(ids, "<i4")`` gives a row of the matrix.

    Documents longer than a row are cut without loss. Null text counts as empty: the end id alone. Null ids are kept;
    repeated rows are packed once each; an empty table gives an empty table."""
    cut = stage(pieces(docs, path or public_tokenizers.path(VOCABULARY), True, end_id, capacity, True, "<u2"), "pieces")
    placed = packed(cut, best_fit_decreasing, capacity).select("sequence_id", "offset", "length", "doc_id", "piece", "ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = [], None
        for batch in batches:
            made = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own and row[0] != now:
                    made.append(_sequence(own, capacity, pad_id))
                    own = []
                now = row[0]
                own.append(row)
            yield _batch(made)
        yield _batch([_sequence(own, capacity, pad_id)] if own else [])

    return (
        placed.repartition("sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
        .mapInArrow(
            rows,
            "sequence_id bigint, n_tokens bigint, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, "
            "ids binary, positions binary",
        )
    )


def _sequence(segments: list[tuple], capacity: int, pad_id: int) -> tuple:
    lengths = [s[2] for s in segments]
    ids = np.full(capacity, pad_id, "<i4")
    raw = np.frombuffer(b"".join(s[5] for s in segments), "<u2")
    ids[: len(raw)] = raw
    positions = np.zeros(capacity, "<i4")
    positions[: len(raw)] = np.concatenate([np.arange(n) for n in lengths])
    ends = np.cumsum([0, *lengths]).tolist()
    return segments[0][0], len(raw), [s[3] for s in segments], [s[4] for s in segments], ends, ids.tobytes(), positions.tobytes()


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = {
        "sequence_id": pa.int64(),
        "n_tokens": pa.int64(),
        "doc_ids": pa.list_(pa.int64()),
        "pieces": pa.list_(pa.int32()),
        "cu_seqlens": pa.list_(pa.int32()),
        "ids": pa.binary(),
        "positions": pa.binary(),
    }
    return pa.record_batch([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def digests(matrices: DataFrame) -> DataFrame:
    """The matrices' shape and checksums in place of their bytes."""
    return matrices.select(
        "sequence_id",
        "n_tokens",
        "doc_ids",
        "pieces",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("positions").alias("positions_crc32"),
    )
