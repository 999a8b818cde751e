"""Near-duplicates by SimHash fingerprints, found with BK-trees.

Distinct fingerprints are dealt to shards; each shard's fingerprints form a BK-tree, whose children are keyed by their
integer Hamming distance to the parent, and a search follows only the edges within the radius of its own distance.

Shards come from the fingerprints' bits: cut into ``radius`` + 1 bands, two fingerprints within the radius agree in one band at
least, so a fingerprint has to meet the trees of its own band values only. A shard above ``HOT`` is cut again, by bands
of the bits that its members do not share yet. Each cut leaves about two thirds of the free bits, and k free bits allow no
more than 2**k different fingerprints, so every shard ends up bounded, with nothing left out. Trees are built where
their shard lies; none is sent to all tasks, as their number grows with the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .components import components
from .text import _pieces, columns

WIDTH = 3
SEED = 42
RADIUS = 2
HOT = 1024  # fingerprints of a shard beyond which it is cut again
SMALL_BITS = 10  # with so few free bits a shard is not cut any further: it holds at most 2**10 fingerprints

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SHINGLES = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str | bytes | None, width: int = WIDTH) -> tuple[int, int]:
    """(fingerprint, shingles) of a whole text; memory for one block of it only."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    ones, n, words = np.zeros(64, np.int64), 0, []

    def count(shingles: Iterator[bytes], rows: int) -> None:
        nonlocal ones
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, rows)
        for lo in range(0, rows, _SHINGLES):
            bits = np.unpackbits(h[lo : lo + _SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)

    for block in _pieces(raw):
        words += block.tobytes().translate(_LOW).split()  # bytes.split() cuts at exactly the gaps of a word
        rows = len(words) - width + 1
        if rows > 0:
            count(map(b" ".join, zip(*[words[k : k + rows] for k in range(width)], strict=True)), rows)
            n += rows
            words = words[rows:]
    if not n and words:
        count(iter([b" ".join(words)]), 1)
        n = 1
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]), n


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, code bigint, n_shingles): every row's fingerprint as a signed number; zero without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, width) for t in batch.column("text")]
            codes = np.array([c for c, _ in found], np.uint64).view(np.int64)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(codes), pa.array([n for _, n in found], pa.int64())],
                names=["doc_id", "code", "n_shingles"],
            )

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, code bigint, n_shingles bigint")


class Tree:
    """A BK-tree of 64-bit codes."""

    def __init__(self):
        self.codes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, code: int, radius: int) -> list[int]:
        """Numbers of the nodes within the radius."""
        found, open_nodes = [], [0] if self.codes else []
        codes, edges = self.codes, self.edges
        while open_nodes:
            at = open_nodes.pop()
            d = (codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            least, most = d - radius, d + radius
            open_nodes += [child for key, child in edges[at].items() if least <= key <= most]
        return found

    def add(self, code: int) -> None:
        """A new node; a code that the tree holds already gets one of its own, at distance 0 of the other."""
        new = len(self.codes)
        if new:
            at = 0
            while True:
                step = self.edges[at].setdefault((self.codes[at] ^ code).bit_count(), new)
                if step == new:
                    break
                at = step
        self.codes.append(code)
        self.edges.append({})


def shard_links(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a shard: it connects what all links connect, with less than one edge a code."""
    tree, root, links = Tree(), list(range(len(codes))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, code in enumerate(codes):
        for j in tree.near(code, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((codes[j], code))
        tree.add(code)
    return links


def bands(mask: int, radius: int) -> list[int]:
    """The bits outside ``mask``, cut into radius + 1 bands, each together with the mask."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _searched(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): links of the shards (mask, key, code), each read in order by one task, a shard in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def linked(codes: list[int]) -> pa.RecordBatch:
            ends = np.array(shard_links(codes, radius), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        for batch in batches:
            mask, key = (batch.column(c).to_numpy() for c in ("mask", "key"))
            codes = batch.column("code").to_numpy().view(np.uint64)
            starts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            for lo, hi in zip([0, *starts], [*starts, len(mask)], strict=True):
                if lo == hi:
                    continue
                if (mask[lo], key[lo]) != name:
                    if len(held) > 1:
                        yield linked(held)
                    name, held = (mask[lo], key[lo]), []
                held += codes[lo:hi].tolist()
        if len(held) > 1:
            yield linked(held)

    return shards.repartition("mask", "key").sortWithinPartitions("mask", "key", "code").mapInArrow(run, "a bigint, b bigint")


def links(codes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints (code) that connect all pairs at ``radius`` or fewer differing bits."""
    left, masks, found = codes.select("code", F.lit(0).cast("bigint").alias("mask")), [0], []
    while True:
        cut = F.create_map(*[c for m in masks for c in (F.lit(_signed(m)), F.array(*[F.lit(_signed(b)) for b in bands(m, radius)]))])
        masks = sorted({b for m in masks for b in bands(m, radius)})
        last = min(m.bit_count() for m in masks) >= 64 - SMALL_BITS  # no shard can be large any more
        rows = left.select("code", F.explode(cut[F.col("mask")]).alias("mask"))
        rows = rows.distinct() if found else rows  # two ways of cutting can lead to the same bits
        rows = stage(rows.withColumn("key", F.col("code").bitwiseAND(F.col("mask"))), "bands")
        sizes = stage(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
        large = F.lit(False) if last else F.col("n") > hot
        found.append(stage(_searched(rows.join(sizes.filter(~large).select("mask", "key"), ["mask", "key"]), radius), "links"))
        if last or not sizes.filter(large).head(1):
            break
        left = rows.join(sizes.filter(large).select("mask", "key"), ["mask", "key"]).select("code", "mask")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Classes of documents whose fingerprints differ in ``radius`` or fewer bits, over whole texts.

    Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself
    included), n_shingles (repeats included). A-Z are lower-cased; a text with fewer words than ``width`` is one shingle;
    without words (null, empty, blank) the fingerprint is zero and linked like any other. A tie, a bit set in exactly half
    of the shingles, gives 0. Rows that repeat an id or a text are rows of their own, with the same class where the texts
    agree. A row without doc_id links like any other, but names no class: a class of such rows only has a null
    component_id. Very long texts are read in blocks. Other columns are ignored; an empty table gives an empty table."""
    named = stage(fingerprints(docs, width), "fingerprints")
    codes = stage(named.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    reached = components(links(codes, radius, hot))
    grouped = stage(
        codes.join(reached.withColumnRenamed("node", "code"), "code", "left").select(
            "code", "least", F.coalesce("component", "code").alias("component")
        ),
        "grouped",
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("code", "component_id")
    return named.join(classes, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id", "n_shingles"
    )
