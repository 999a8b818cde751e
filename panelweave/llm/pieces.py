"""Documents as token pieces, and the steps that two packers share: exact ranks within a length, and places by rank.

A packer only sees how many pieces each length has, a table of at most ``capacity`` rows however many documents there are. Its
plan says which ranks of a length go where; every piece then finds its own place from its rank."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.staging import stage
from .text import Remembered, columns

CAPACITY = 4096
KNOWN_WORDS = 500_000  # words whose ids a worker remembers, in each of two generations
MARKS = ".,;:!?|$&%*#"
TOGETHER = 256
GROUP = 1 << 16  # characters of short texts that are encoded together
SPACED_GROUP = 1 << 21  # the same where Arrow finds the different words of a group
SLICE = 1 << 20  # characters that are split into words at a time

_GAPS = re.compile(r"[ \t\n\r\x0b\x0c]+")
_SPACED = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_ODD_GAPS = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
# bytes by kind: letters (all of U+00C0 to U+027F but two signs), digits, others, gaps; ``_ALIEN`` starts any other character
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 0
_KIND[48:58] = 1
_KIND[[32, *range(9, 14)]] = 3
_ALIEN = np.zeros(256, bool)
_ALIEN[[0xC2, *range(0xCA, 256)]] = True
_encoders: dict[tuple, "WordIds"] = {}


def _odd(text: str) -> bool:
    """Whether the text has gaps that only some readers take for one."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and _ODD_GAPS.search(text) is not None


def unit_starts(b: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the parts begin that the rules of a vocabulary with white space cut UTF-8 texts into, one text after the other: runs of
    letters, of digits or of others with the space before them, endings like 's, and gaps. What stands between two gaps stays
    whole if it holds a character that not all readers may class alike."""
    first = np.zeros(len(b) + 1, bool)
    first[begins] = True
    first, kind = first[:-1], _KIND[b]
    gap = kind == 3
    after_gap, leads = np.zeros(len(b), bool), np.zeros(len(b), bool)
    after_gap[1:] = gap[:-1]
    leads[:-1] = ~gap[1:] & ~first[1:]  # the last of a run of gaps is apart; a space goes with what follows
    changed, spaced = first.copy(), np.zeros(len(b), bool)
    changed[1:] |= kind[1:] != kind[:-1]
    spaced[1:] = b[:-1] == 32
    start = np.where(gap, first | ~after_gap | leads, first | changed & ~spaced)
    at = np.flatnonzero((b == 39) & start)
    padded = np.append(np.where(first, 0, b), [0, 0]).astype(np.int64)  # an ending does not reach into the next text
    one, two = padded[at + 1], padded[at + 1] << 8 | padded[at + 2]
    for size, found in ((1, np.isin(one, [*b"sdmt"])), (2, np.isin(two, [int.from_bytes(e) for e in (b"ll", b"ve", b"re")]))):
        ends = at[found] + size + 1
        start[at[found] + 1] = False
        start[ends[ends < len(b)]] = True
    alien = _ALIEN[b]
    alien[:-1] |= (b[:-1] == 0xC3) & ((b[1:] == 0x97) | (b[1:] == 0xB7))
    if alien.any():
        edge = start & (gap | after_gap | first)
        between = np.cumsum(edge)
        whole = np.zeros(between[-1] + 1, bool)
        whole[between[alien]] = True
        start &= edge | ~whole[between]
    return np.flatnonzero(start)


class WordIds:
    """Token ids of whole texts, by way of the ids of their words.

    ``spaced``: the vocabulary keeps white space, so texts are cut as its own rules cut them, or, with gaps that only some
    readers know or with added tokens, before every gap; else gaps and case are dropped. Both are exact for vocabularies whose rules never join
    characters across a gap."""

    def __init__(self, path: str, spaced: bool, kind: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.kind = Tokenizer.from_file(path), spaced, np.dtype(kind)
        self.known = Remembered(self._solve_units if spaced else self._solve, KNOWN_WORDS)
        self.added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cores: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        tokens = (self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size()))
        self.edge = np.array([t.startswith("Ġ") if spaced else t.endswith("</w>") for t in tokens])

    @classmethod
    def of(cls, path: str, spaced: bool, kind: str) -> "WordIds":
        key = (path, spaced, kind)
        if key not in _encoders:
            _encoders[key] = cls(*key)
        return _encoders[key]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in batch]

    def _letters(self, cores: list[str]) -> Iterator[bytes]:
        """Ids of words of letters only, encoded many at a time: each has exactly one token that begins (or ends) a word."""
        texts = [("" if self.spaced else " ").join(cores[i : i + TOGETHER]) for i in range(0, len(cores), TOGETHER)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            own = cores[i * TOGETHER : (i + 1) * TOGETHER]
            ids = np.array(e.ids, self.kind)
            cuts = np.flatnonzero(self.edge[ids]) + (0 if self.spaced else 1)
            if len(cuts) != len(own):  # a letter that the vocabulary's own rules take apart
                yield from self._encoded(own)
                continue
            ends = [*cuts[1:].tolist(), len(ids)] if self.spaced else cuts.tolist()
            raw, at, step = ids.tobytes(), 0, self.kind.itemsize
            for end in ends:
                yield raw[at * step : end * step]
                at = end

    def _parts(self, word: str) -> list[tuple[bool, str]]:
        """(letters only, text) parts of a word that the vocabulary's own rules take apart: letters and the marks behind."""
        core = word.rstrip(MARKS)
        if core.isalpha() and (core.isascii() or core.lower().isalpha()):
            out = [(True, core.lower() if core.isascii() else core)]
            if len(core) < len(word):
                out.append((False, word[len(core) :]))
            return out
        return [(False, word)]

    def _kept(self, cache: dict[str, bytes], wanted: set[str], encode) -> dict[str, bytes]:
        new = list(wanted.difference(cache))
        if len(cache) + len(new) > KNOWN_WORDS:
            cache = {k: cache[k] for k in wanted if k in cache}
        cache.update(zip(new, encode(new), strict=True))
        return cache

    def _solve(self, words: list[str]) -> list[bytes]:
        # most words are plain letters; only the others are taken apart
        plain = [w.lower() if w.isascii() and w.isalpha() else None for w in words]
        parts = [None if p else self._parts(w) for p, w in zip(plain, words, strict=True)]
        rest = [part for found in parts if found for part in found]
        self.cores = self._kept(self.cores, {*filter(None, plain), *(t for letters, t in rest if letters)}, self._letters)
        self.rests = self._kept(self.rests, {t for letters, t in rest if not letters}, self._encoded)
        cores, rests = self.cores, self.rests
        return [
            cores[p] if p else b"".join([(cores if letters else rests)[t] for letters, t in found])
            for p, found in zip(plain, parts, strict=True)
        ]

    def _solve_units(self, units: list[str]) -> list[bytes]:
        cores = [u for u in units if u[0] == " " and u[1:].isalpha()]
        found = dict(zip(cores, self._letters(cores), strict=True))
        others = [u for u in units if u not in found]
        found.update(zip(others, self._encoded(others), strict=True))
        return [found[u] for u in units]

    def _words(self, text: str) -> list[str]:
        if _odd(text):
            return _GAPS.split(text)
        return text.lower().split() if text.isascii() else text.split()

    def _all(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            return self.known.all_joined([self._words(t) for t in texts])
        odd = [_odd(t) or any(a in t for a in self.added) for t in texts]
        units = self._by_units([t for t, o in zip(texts, odd, strict=True) if not o])
        return [b"".join(self._encoded(_SPACED.findall(t))) if o else next(units) for t, o in zip(texts, odd, strict=True)]

    def _by_units(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow finds the different parts of all texts; each is asked once."""
        raw = [t.encode() for t in texts]
        whole, begins = b"".join(raw), np.cumsum([0, *map(len, raw)])
        starts = unit_starts(np.frombuffer(whole, np.uint8), begins[:-1])
        offsets = np.append(starts, len(whole)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(whole)).dictionary_encode()
        solved = pa.array(self.known.each(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        _, ends, data = solved.take(units.indices).buffers()
        cuts = np.frombuffer(ends, np.int64)[np.searchsorted(starts, begins)].tolist()
        data = memoryview(data or b"")
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield bytes(data[at:end])

    def ids(self, text: str) -> bytes:
        """Little-endian ids, one after the other; a long text is taken in slices that end before a gap."""
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                gap = _GAPS.search(text, end)
                end = gap.start() if gap else len(text)
            out += self._all([text[at:end]])
            at = end
        return b"".join(out)

    def many(self, texts: Iterator[str]) -> Iterator[bytes]:
        """The ids of every text, short ones together."""
        some, size, group = [], 0, SPACED_GROUP if self.spaced else GROUP
        for text in texts:
            if size + len(text) > group:
                yield from self._all(some)
                some, size = [], 0
            if len(text) > SLICE:
                yield self.ids(text)
            else:
                some.append(text)
                size += len(text)
        yield from self._all(some)


def pieces(
    docs: DataFrame, path: str, spaced: bool, end_id: int, capacity: int = CAPACITY, with_ids: bool = True, kind: str = "<u4"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, part, place): each document's ids and ``end_id``, cut only where they
    exceed ``capacity``. ``part`` and ``place`` number the pieces of a length within the task that made them."""
    wide = np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordIds.of(path, spaced, kind), TaskContext.get().partitionId()
        last, seen, step = np.array([end_id], kind).tobytes(), {}, np.dtype(kind).itemsize
        for batch in batches:
            rows = []
            texts = (t.as_py() or "" for t in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.many(texts), strict=True):
                ids += last
                for number, at in enumerate(range(0, len(ids), capacity * step)):
                    own = ids[at : at + capacity * step]
                    n = len(own) // step
                    place = seen.get(n, 0)
                    seen[n] = place + 1
                    crc = zlib.crc32(own if step == 4 else np.frombuffer(own, kind).astype(wide).tobytes())
                    rows.append((doc_id, number, at // step, n, crc, own if with_ids else None, part, place))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _TYPES.values(), strict=True)],
                names=list(_TYPES),
            )

    return columns(docs, doc_id="bigint", text="string").mapInArrow(
        run,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, place bigint",
    )


_TYPES = {
    "doc_id": pa.int64(),
    "piece": pa.int32(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "ids": pa.binary(),
    "part": pa.int32(),
    "place": pa.int64(),
}


@dataclass
class Plan:
    """Rows (length, first rank, end rank, pieces in a sequence, first sequence, first offset): the ranks of a length from
    first to end fill one sequence after the other, so many in each, side by side from the offset."""

    rows: list[tuple[int, int, int, int, int, int]]
    sequences: int


def packed(cut: DataFrame, planner, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (staged pieces) plus sequence_id and offset. ``planner(counts, capacity)`` makes a Plan of {length: pieces}."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = stage(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = planner(by_length, capacity)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, first, _, each, sequence, offset = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1].T
            columns = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            columns["sequence_id"] = pa.array(sequence + (rank - first) // each)
            columns["offset"] = pa.array(offset + (rank - first) % each * length)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    ranked = cut.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("place")
    )
    kept = ranked.select(*[c for c in cut.columns if c not in ("part", "place")], "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes if c != "rank")
    return kept.mapInArrow(run, schema + ", sequence_id bigint, offset bigint")
