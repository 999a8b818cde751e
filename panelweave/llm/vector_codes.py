"""Vector code compression: integer codebooks by part position, learned and applied over Hilbert-sorted flat blocks.

Vectors of a task are taken in chunks. For each part position the chunk's parts are sorted along a Hilbert curve and cut
into flat blocks, each stored with its minimum and maximum box and its componentwise sums. In every round the distances from
a box to the codebook's entries, least and most, leave a shortlist: entries whose least distance is not above the smallest
most distance. A block with one entry left goes to it whole, by its stored sums; the others are evaluated by a small
exact integer kernel over the shortlist. Blocks are rows of a table, so rounds are scans with partial sums; only the
codebooks (64 entries a part position) reach the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .integer_vectors import integer_vectors, matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
CHUNK = 1 << 15  # vectors sorted together
BLOCK = 64  # parts of a block
_KEY_BITS = 60

_BLOCKS = "chunk bigint, part int, ids array<bigint>, labels array<bigint>, place binary, points binary, low binary, high binary, sums binary"


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of every point [n, dim] on a Hilbert curve over the points' box. At most 60 dimensions count, with equal bits."""
    x = points[:, :_KEY_BITS]
    n, dim = x.shape
    bits = min(16, _KEY_BITS // dim)
    low, span = x.min(axis=0), np.maximum(x.max(axis=0) - x.min(axis=0), 1)
    a = [((x[:, d] - low[d]) * ((1 << bits) - 1) // span[d]).astype(np.uint64) for d in range(dim)]
    one, zero = np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):  # undo the turns of the curve from the coarsest cell to the finest
        bit, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(dim):
            high = (a[d] & bit) != zero
            swap = np.where(high, zero, (a[0] ^ a[d]) & below)
            a[0] = np.where(high, a[0] ^ below, a[0] ^ swap)
            if d:
                a[d] = a[d] ^ swap
    for d in range(1, dim):
        a[d] = a[d] ^ a[d - 1]
    turn = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        turn = np.where((a[dim - 1] & np.uint64(1 << b)) != zero, turn ^ np.uint64((1 << b) - 1), turn)
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for d in range(dim):
            key = key << one | ((a[d] ^ turn) >> np.uint64(b) & one)
    return key


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """[blocks, entries]: whether an entry of ``book`` can be the nearest of some point in the box [low, high] of a block."""
    c = book[None]
    under, over = low[:, None] - c, c - high[:, None]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, book: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point among the entries ``short`` (ascending); ties go to the lower entry."""
    gap = ((points[:, None] - book[short][None]) ** 2).sum(axis=2)
    at = gap.argmin(axis=1)
    return short[at], gap[np.arange(len(points)), at]


def block_table(rows: DataFrame, dim: int, parts: int = PARTS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The blocks of all vectors (vec_id, label, v), and for each chunk one row (part -1) with its ids and labels."""
    width = dim // parts

    def cut(name: int, ids: list, labels: list, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = {c: [] for c in ("part", "ids", "labels", "place", "points", "low", "high", "sums")}

        def add(part, ids, labels, *arrays):
            for c, value in zip(made, (part, ids, labels, *(a if a is None else a.tobytes() for a in arrays)), strict=True):
                made[c].append(value)

        add(-1, ids, labels, None, None, None, None, None)
        for part in range(parts):
            own = x[:, part * width : (part + 1) * width]
            order = np.argsort(hilbert_keys(own), kind="stable")
            for lo in range(0, len(order), block):
                place = order[lo : lo + block]
                p = own[place]
                add(part, None, None, place.astype(np.int32), p.astype(np.int32), p.min(axis=0), p.max(axis=0), p.sum(axis=0))
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
        arrays = [pa.array(v, k) for v, k in zip(made.values(), kinds, strict=True)]
        yield pa.record_batch([pa.array([name] * len(made["part"]), pa.int64()), *arrays], names=["chunk", *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, ids, labels = TaskContext.get().partitionId() << 32, [], [], []
        for batch in batches:
            held.append(matrix(batch.column("v"), dim))
            ids += batch.column("vec_id").to_pylist()
            labels += batch.column("label").to_pylist()
            while len(ids) >= chunk:
                x = np.concatenate(held)
                yield from cut(name, ids[:chunk], labels[:chunk], x[:chunk])
                name, held, ids, labels = name + 1, [x[chunk:]], ids[chunk:], labels[chunk:]
        if ids:
            yield from cut(name, ids, labels, np.concatenate(held))

    return rows.mapInArrow(run, _BLOCKS)


def _numbers(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    return np.array([np.frombuffer(column[int(r)].as_buffer(), np.int64) for r in rows], np.int64).reshape(-1, width)


def _points(batch: pa.RecordBatch, row: int, width: int) -> np.ndarray:
    return np.frombuffer(batch.column("points")[row].as_buffer(), np.int32).reshape(-1, width).astype(np.int64)


def improved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks [parts, entries, width] after one round over all blocks."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            part_of = batch.column("part").to_numpy()
            for part in range(parts):
                own = np.flatnonzero(part_of == part)
                if not len(own):
                    continue
                low, high, total = (_numbers(batch.column(c), own, width) for c in ("low", "high", "sums"))
                fit = shortlists(low, high, books[part])
                single = fit.sum(axis=1) == 1
                sole = fit.argmax(axis=1)
                np.add.at(sums[part], sole[single], total[single])
                sizes = np.array([len(batch.column("place")[int(r)].as_buffer()) // 4 for r in own[single]], np.int64)
                np.add.at(counts[part], sole[single], sizes)
                for b in np.flatnonzero(~single):
                    points = _points(batch, int(own[b]), width)
                    entry, _ = nearest(points, books[part], np.flatnonzero(fit[b]))
                    np.add.at(sums[part], entry, points)
                    counts[part] += np.bincount(entry, minlength=entries)
        part, entry, place = (a.ravel() for a in np.indices(books.shape, np.int32))
        used = np.repeat(counts.ravel(), width)
        yield pa.record_batch([pa.array(a[used > 0]) for a in (part, entry, place, sums.ravel(), used)], names=["part", "entry", "place", "total", "n"])

    found = (
        blocks.filter("part >= 0")
        .select("part", "place", "points", "low", "high", "sums")
        .mapInArrow(run, "part int, entry int, place int, total bigint, n bigint")
        .groupBy("part", "entry", "place")
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    )
    new = books.copy()
    for r in found.collect():  # at most one row for every number of the codebooks
        new[r.part, r.entry, r.place] = r.total // r.n
    return new


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector: chunks are put together again from their blocks, one chunk a group."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = labels = None
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            part_of = batch.column("part").to_numpy()
            for row in np.flatnonzero(part_of < 0):
                ids, labels = batch.column("ids")[int(row)].values, batch.column("labels")[int(row)].values
            for part in range(parts):
                own = np.flatnonzero(part_of == part)
                if not len(own):
                    continue
                fit = shortlists(*(_numbers(batch.column(c), own, width) for c in ("low", "high")), books[part])
                for row, short in zip(own, fit, strict=True):
                    place = np.frombuffer(batch.column("place")[int(row)].as_buffer(), np.int32)
                    found.append((part, place, *nearest(_points(batch, int(row), width), books[part], np.flatnonzero(short))))
        codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
        for part, place, entry, gap in found:
            codes[place, part] = entry
            error[place] += gap
        text = codes.tobytes().hex()
        code = [text[lo : lo + 2 * parts] for lo in range(0, len(text), 2 * parts)]
        yield pa.record_batch([ids, labels, pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.groupBy("chunk").applyInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def first_books(rows: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the ``entries`` smallest ids' vectors, ascending; ties of an id go by the vector."""
    first = rows.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").limit(entries).collect()
    x = np.array([r.v for r in first], np.int64).reshape(-1, parts, dim // parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks [parts, entries, width]) of ``rows`` (vec_id, label, v of integers).

    The codebook of a part position starts as that part of the ``entries`` (at most 256) smallest ids; every round assigns all
    parts to their nearest entry (ties to the lower index) and replaces used entries by floor(sum / count). The length
    that counts is that of the smallest id's vector; it has to be a multiple of ``parts``, and rows of another length
    take no part. Rows without vec_id are encoded but start no entry; if no row has an id, or the length is no such
    multiple, the result is empty. Repeated rows count as often as they occur."""
    known = stage(rows, "vectors")
    head = known.filter("vec_id IS NOT NULL").orderBy("vec_id", "v").select(F.size("v").alias("dim")).first()
    dim = head.dim if head and head.dim % parts == 0 else parts
    own = known.filter(F.size("v") == (dim if head and head.dim % parts == 0 else -1))
    books = first_books(own, dim, parts, entries)
    blocks = stage(block_table(own, dim, parts, chunk, block), "blocks")
    for _ in range(rounds):
        books = improved(blocks, books)
    return encoded(blocks, books), books


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``vectors`` (vec_id, label, embedding) that takes part.

    Rows whose vector is null, empty or holds null or non-finite components take no part; for lengths, missing ids and
    repeated rows see ``compressed``. Errors are summed over equal labels, nulls together. Other columns are ignored; an
    empty table gives an empty table."""
    found, books = compressed(integer_vectors(vectors))
    codes = stage(found, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


_ROUND_SQL = """
g{n} AS (SELECT r, part, entry, min(d) OVER (PARTITION BY r, part) AS least, d FROM (
  SELECT r, p.part, c.entry, list_sum([(p.s[i] - c.s[i]) * (p.s[i] - c.s[i]) FOR i IN range(1, len(p.s) + 1)])::BIGINT * 64 + c.entry AS d
  FROM p JOIN c{n} c USING (part))),
a{n} AS (SELECT r, part, entry, d // 64 AS d FROM g{n} WHERE d = least)"""

_UPDATE_SQL = """,
u{n} AS (SELECT part, entry, i, sum(s[i])::BIGINT AS t, count(*) AS k
  FROM a{n} JOIN p USING (r, part), unnest(range(1, len(s) + 1)) AS x(i) GROUP BY part, entry, i),
c{m} AS (SELECT part, entry, coalesce(any_value(u.s), any_value(c.s)) AS s FROM c{n} c LEFT JOIN (
  SELECT part, entry, list((t - ((t % k) + k) % k) // k ORDER BY i) AS s FROM u{n} GROUP BY part, entry) u USING (part, entry) GROUP BY part, entry),"""

# The same codes for DuckDB, by comparing every part with every entry.
CODES_SQL = f"""
WITH f AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
k AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM f
  WHERE len(v) = (SELECT len(v) FROM f WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT 1) AND len(v) % {PARTS} = 0),
p AS (SELECT r, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS s FROM k, unnest(range({PARTS})) AS x(part)),
c0 AS (SELECT part, r - 1 AS entry, s FROM p WHERE r <= {ENTRIES}),{_ROUND_SQL.format(n=0)}{_UPDATE_SQL.format(n=0, m=1)}{_ROUND_SQL.format(n=1)}{_UPDATE_SQL.format(n=1, m=2)}{_ROUND_SQL.format(n=2)},
v AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN v USING (r), b
"""
