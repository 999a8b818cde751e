"""Minimum bin slack: for every sequence the fullest combination of the lengths that are left is found by a subset-sum
over bits, and removed. A combination is used as often as the counts allow before the next is sought, so the work
depends on the number of different lengths and not on the number of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame

from ..plans.staging import stage
from .pieces import CAPACITY, Plan, packed, pieces

VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) with the largest sum of at most ``room``, each length used no more often than it is there."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        times = 1
        while left:
            times = min(times, left)
            left -= times
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            times *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return sorted(used.items(), reverse=True)


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The longest length left opens a sequence; the fullest combination that fits beside it completes it."""
    left, taken = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left:
        first = max(left)
        left[first] -= 1
        content = dict(fullest(left, capacity - first)) if first < capacity else {}
        left[first] += 1
        content[first] = content.get(first, 0) + 1
        repeats, offset = min(left[k] // n for k, n in content.items()), 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, taken[length], taken[length] + repeats * each, each, sequence, offset))
            offset += length * each
            taken[length] += repeats * each
            left[length] -= repeats * each
            if not left[length]:
                del left[length]
        sequence += repeats
    return Plan(rows, sequence)


def packed_documents(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit, or null without
    ``with_ids``), sequence_id, offset.

    Null text counts as empty: its document is the end id alone. A null doc_id is kept. Repeated rows are packed once
    each. Which of two equally long pieces comes first is open. An empty table gives an empty table."""
    cut = stage(pieces(docs, path or public_tokenizers.path(VOCABULARY), False, end_id, capacity, with_ids), "pieces")
    return packed(cut, minimum_slack, capacity)
