"""SentencePiece encoding and decoding as a max-plus scan over chunks.

A BPE encoding is the one path through the lattice of pieces on which every two neighbours are what the merge rules make
of their joined text. So an edge from one piece to the next weighs 0 if the pair is stable and minus infinity if not, and the
path of weight 0 is the encoding. Long documents are cut into chunks anywhere. The state at a cut is the piece that
reaches it; a chunk is the matrix of path weights between the states at its two cuts. Matrices are multiplied (max, plus) in
blocks, blocks are chained, the states at all cuts follow backwards, and every chunk then finds its own pieces alone.
With weights of 0 and minus infinity a row of a matrix is a set, and is held as the bits of an integer.

No piece joins characters across the start of a word, or a letter and another character, so words inside a chunk are cut there,
solved once and remembered."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .text import Remembered, columns

VOCABULARY = "piece_bpe_32k.model"
CHUNK = 1 << 16  # characters
BLOCK = 256  # chunks whose matrices are multiplied together
KNOWN_WORDS = 150_000  # in each of two generations
KNOWN_PAIRS = 200_000
SPACE = "▁"

# no piece joins letters and others, or goes on into the next word; `Codec` looks whether that holds for its model
_LETTER = r"[^\W\d_²]"
_WORDS = re.compile(f"{SPACE}*(?:{_LETTER}+|(?:(?!{_LETTER})[^{SPACE}])+)|{SPACE}+")
_codecs: dict[str, "Codec"] = {}


class Codec:
    """Pieces, merge ranks and pair stability of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.raw = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.beginnings = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        if any(not _WORDS.fullmatch(p) for p in self.ids):
            raise ValueError("pieces that run into the next word, or join letters and others, are not supported")
        self.bytes = [b""] * n
        for p, i in self.ids.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.known = Remembered(lambda words: list(map(self.word, words)), KNOWN_WORDS)
        self.stable: dict[str, dict[str, bool]] = {}
        self.pairs = 0  # in ``stable``

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def merged(self, text: str) -> list[str]:
        """What the merge rules make of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def joins(self, a: str, b: str) -> bool:
        """Whether the edge a -> b weighs 0; a is empty at the start of a text or word."""
        found = self.stable.get(a, {}).get(b)
        if found is None:
            if self.pairs >= KNOWN_PAIRS:
                self.stable, self.pairs = {}, 0
            self.pairs += 1
            found = self.stable.setdefault(a, {})[b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def paths(self, text: str, begin: dict[int, dict[str, int]], stop: int) -> list[dict[str, list]]:
        """states[i][piece] = [rows, start, piece before]: pieces that end at i on paths from ``begin`` (position -> piece ->
        rows as bits) whose pieces all start before ``stop``."""
        states: list[dict[str, list]] = [{} for _ in range(len(text) + 1)]
        for i, pieces in begin.items():
            for piece, rows in pieces.items():
                states[i][piece] = [rows, -1, ""]
        for i in range(min(begin, default=stop), stop):
            if not states[i]:
                continue
            for j in range(i + 1, min(i + self.longest, len(text)) + 1):
                piece = text[i:j]
                if j > i + 1 and piece not in self.ids:
                    continue
                for before, (rows, _, _) in states[i].items():
                    if self.joins(before, piece):
                        old = states[j].get(piece)
                        if old is None:
                            states[j][piece] = [rows, i, before]
                        else:
                            old[0] |= rows
        return states

    def back(self, states: list[dict[str, list]], end: int, piece: str) -> list[str]:
        """The pieces on the path to ``piece`` at ``end``, without the one it begins with."""
        out = []
        while states[end][piece][1] >= 0:
            _, start, before = states[end][piece]
            out.append(piece)
            end, piece = start, before
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> bytes:
        return b"".join([self.raw.get(p) or self.spelled(p) for p in pieces])

    def spelled(self, piece: str) -> bytes:
        """Ids of a character that is no piece: of its bytes, where the model has such."""
        own = [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]
        return b"".join(i.to_bytes(4, "little") for i in own)

    def starts(self, word: str, at: int) -> list[str]:
        """The pieces that the word can go on with, short ones first; a single character always can."""
        ids, beginnings, out = self.ids, self.beginnings, [word[at]]
        for j in range(at + 2, min(at + self.longest, len(word)) + 1):
            piece = word[at:j]
            if piece not in beginnings:
                break
            if piece in ids:
                out.append(piece)
        return out

    def word(self, word: str) -> bytes:
        """The same for one word from its start. Every prefix has exactly one path, so whatever order edges are tried in, no
        place is met twice: long pieces first, and back where none leads on."""
        n, at, before, path, left = len(word), 0, "", [], []
        while at < n:
            options = self.starts(word, at)
            after = self.stable.get(before) or {}
            while True:
                if not options:  # no piece leads on from here: back to where this one began
                    at -= len(path.pop())
                    before, options = path[-1] if path else "", left.pop()
                    after = self.stable.get(before) or {}
                    continue
                piece = options.pop()
                ok = after.get(piece)
                if ok or ok is None and self.joins(before, piece):
                    break
            path.append(piece)
            left.append(options)
            before, at = piece, at + len(piece)
        return self.to_ids(path)

    def words(self, text: str) -> bytes:
        """Ids of a text that starts and ends between words."""
        return self.known.joined(_WORDS.findall(text))

    def text_of(self, ids: bytes) -> str:
        table, view = self.bytes, memoryview(ids).cast("I")
        raw = b"".join(map(table.__getitem__, view.tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw

    # Chunks: ``window`` is the text from ``left`` characters before the chunk to some after; size is the chunk's own length.

    def cut_states(self, window: str, at: int) -> list[tuple[int, str]]:
        """(end - cut, piece) for all pieces of the text that start before the cut and reach it."""
        if at == 0:
            return [(0, "")]
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(start + self.longest, len(window)) + 1):
                if end == start + 1 or window[start:end] in self.ids:
                    out.append((end - at, window[start:end]))
        return out

    def _bounds(self, window: str, left: int, size: int) -> tuple[int, int] | None:
        """First and last start of a word that no piece at either cut can touch."""
        lo, hi = left + self.longest, left + size - self.longest
        first = next((m.start() + 1 for m in re.finditer(f"[^{SPACE}]{SPACE}", window[lo:hi])), None)
        if first is None:
            return None
        last = max(window.rfind(SPACE, lo, hi), lo + first)
        while last > lo + first and (window[last - 1] == SPACE or window[last] != SPACE):
            last = window.rfind(SPACE, lo, last)
        return lo + first, max(last, lo + first)

    def matrix(self, window: str, left: int, size: int) -> list[int]:
        """A row of bits (states at the right cut) for every state at the left cut."""
        ins, outs = self.cut_states(window, left), self.cut_states(window, left + size)
        begin: dict[int, dict[str, int]] = {}
        for k, (past, piece) in enumerate(ins):
            begin.setdefault(left + past, {})[piece] = 1 << k
        bounds = self._bounds(window, left, size)
        end, rows = left + size, [0] * len(ins)
        if bounds is None:
            states = self.paths(window, begin, end)
            for o, (past, piece) in enumerate(outs):
                bits = states[end + past].get(piece, [0])[0]
                for k in range(len(ins)):
                    rows[k] |= (bits >> k & 1) << o
            return rows
        head = self.paths(window[: bounds[0]], begin, bounds[0])
        alive = 0
        for bits, _, _ in head[-1].values():
            alive |= bits
        tail = self.paths(window[bounds[1] :], {0: {"": 1}}, end - bounds[1])
        reach = sum(1 << o for o, (past, piece) in enumerate(outs) if piece in tail[end - bounds[1] + past])
        return [reach if alive >> k & 1 else 0 for k in range(len(ins))]

    def chunk_ids(self, window: str, left: int, size: int, state_in: int, state_out: int) -> bytes:
        """Ids of the pieces after the one that reaches the left cut, to the one that reaches the right cut."""
        past, piece = self.cut_states(window, left)[state_in]
        past_out, piece_out = self.cut_states(window, left + size)[state_out]
        begin, end, bounds = {left + past: {piece: 1}}, left + size, self._bounds(window, left, size)
        if bounds is None:
            return self.to_ids(self.back(self.paths(window, begin, end), end + past_out, piece_out))
        first, last = bounds
        head = self.paths(window[:first], begin, first)
        tail = self.paths(window[last:], {0: {"": 1}}, end - last)
        return (
            self.to_ids(self.back(head, first, next(iter(head[-1]))))
            + self.words(window[first:last])
            + self.to_ids(self.back(tail, end - last + past_out, piece_out))
        )


def marked(text: str | None) -> str:
    """The text as the model reads it: a space in front, spaces as marks; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def times(a: list[int], b: list[int]) -> list[int]:
    """Max-plus product of two matrices of 0 and minus infinity, rows as bits."""
    out = []
    for row in a:
        bits, k = 0, 0
        while row:
            if row & 1:
                bits |= b[k]
            row >>= 1
            k += 1
        out.append(bits)
    return out


def trace(matrices: list[list[int]], first: int, last: int) -> list[int]:
    """The states at all cuts, from ``first`` before the first matrix to ``last`` behind the last one."""
    reach = [1 << first]
    for m in matrices:
        reach.append(times([reach[-1]], m)[0])
    states = [last]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(next(i for i, row in enumerate(matrices[k]) if reach[k] >> i & 1 and row >> states[-1] & 1))
    return states[::-1]


def _pack(rows: list[int]) -> list[str]:
    return [format(r, "x") for r in rows]


def _unpack(rows: list[str]) -> list[int]:
    return [int(r, 16) for r in rows]


def _short(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [codec.words(marked(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids binary")


def _long(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    reach = Codec(path).longest  # characters of context on either side of a chunk

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "chunk", "window", "left", "size", "rows"]
        codec = Codec.of(path)
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(c) for c in ("key", "doc_id", "text")), strict=True):
                whole = marked(text.as_py())
                for number, at in enumerate(range(0, len(whole), chunk)):
                    size, left = min(chunk, len(whole) - at), min(at, reach)
                    if len(whole) - at - size <= reach and at + size < len(whole):
                        pass  # a short last chunk still has the context it needs
                    window = whole[at - left : at + size + reach]
                    yield pa.record_batch(
                        [
                            pa.array([key.as_py()], pa.int64()),
                            pa.array([doc_id.as_py()], pa.int64()),
                            pa.array([number], pa.int64()),
                            pa.array([window], pa.string()),
                            pa.array([left], pa.int32()),
                            pa.array([size], pa.int32()),
                            pa.array([_pack(codec.matrix(window, left, size))], pa.list_(pa.string())),
                        ],
                        names=names,
                    )

    chunks = stage(
        docs.withColumn("key", F.monotonically_increasing_id())
        .mapInArrow(cut, "key bigint, doc_id bigint, chunk bigint, window string, left int, size int, rows array<string>")
        .withColumn("block", F.floor(F.col("chunk") / BLOCK)),
        "chunks",
    )

    def in_order(group: pa.Table, by: str) -> list[dict]:
        return sorted(group.to_pylist(), key=lambda r: r[by])

    def product(group: pa.Table) -> pa.Table:
        rows = in_order(group, "chunk")
        whole = _unpack(rows[0]["rows"])
        for r in rows[1:]:
            whole = times(whole, _unpack(r["rows"]))
        out = {"key": rows[0]["key"], "block": rows[0]["block"], "rows": _pack(whole)}
        return pa.Table.from_pylist([out], pa.schema([("key", pa.int64()), ("block", pa.int64()), ("rows", pa.list_(pa.string()))]))

    def chained(group: pa.Table) -> pa.Table:
        rows = in_order(group, "block")
        matrices = [_unpack(r["rows"]) for r in rows]
        reach = 1
        for m in matrices:
            reach = times([reach], m)[0]
        states = trace(matrices, 0, (reach & -reach).bit_length() - 1)
        kinds = {"key": pa.int64(), "block": pa.int64(), "first": pa.int32(), "last": pa.int32()}
        out = [(r["key"], r["block"], a, b) for r, a, b in zip(rows, states, states[1:], strict=False)]
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(kinds.items())})

    def within(key, ends: pa.Table, group: pa.Table) -> pa.Table:
        rows, end = in_order(group, "chunk"), ends.to_pylist()[0]
        states = trace([_unpack(r["rows"]) for r in rows], end["first"], end["last"])
        kinds = {"key": pa.int64(), "chunk": pa.int64(), "first": pa.int32(), "last": pa.int32()}
        out = [(r["key"], r["chunk"], a, b) for r, a, b in zip(rows, states, states[1:], strict=False)]
        return pa.table({n: pa.array([o[k] for o in out], t) for k, (n, t) in enumerate(kinds.items())})

    small = chunks.select("key", "block", "chunk", "rows")
    blocks = small.groupBy("key", "block").applyInArrow(product, "key bigint, block bigint, rows array<string>")
    ends = blocks.groupBy("key").applyInArrow(chained, "key bigint, block bigint, first int, last int")
    states = (
        ends.groupBy("key", "block")
        .cogroup(small.groupBy("key", "block"))
        .applyInArrow(within, "key bigint, chunk bigint, first int, last int")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = [
                codec.chunk_ids(r["window"], r["left"], r["size"], r["first"], r["last"]) for r in batch.to_pylist()
            ]
            yield pa.record_batch(
                [batch.column("key"), batch.column("doc_id"), batch.column("chunk"), pa.array(ids, pa.binary())],
                names=["key", "doc_id", "chunk", "ids"],
            )

    def joined(group: pa.Table) -> pa.Table:
        rows = in_order(group, "chunk")
        return pa.table(
            {"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": pa.array([b"".join(r["ids"] for r in rows)], pa.binary())}
        )

    solved = (
        chunks.select("key", "doc_id", "chunk", "window", "left", "size")
        .join(states, ["key", "chunk"])
        .mapInArrow(finish, "key bigint, doc_id bigint, chunk bigint, ids binary")
    )
    return solved.groupBy("key").applyInArrow(joined, "doc_id bigint, ids binary")  # a group is one document


def encoded(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): little-endian unsigned 32-bit ids, as the model's own library
    gives them for the whole text.

    Null text counts as empty and has no ids. Null ids are kept, repeated rows are encoded once each; other columns are
    ignored; an empty table gives an empty table. Documents longer than ``chunk`` characters go through the scan."""
    path = path or public_tokenizers.path(VOCABULARY)
    clean = columns(docs, doc_id="bigint", text="string")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    return _short(clean.filter(size < chunk), path).unionAll(_long(clean.filter(size >= chunk), path, chunk))


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): null ids give null, bytes that are not UTF-8 give the replacement character."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            texts = [None if v is None else codec.text_of(v) for v in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return columns(ids, doc_id="bigint", ids="binary").mapInArrow(run, "doc_id bigint, text string")


def encoding_report(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text_crc32 (of the text decoded again) of every row."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(codec.text_of(i).encode("utf-8", "surrogatepass")) for i in ids], pa.int64()),
                ],
                names=["doc_id", "n_tokens", "ids_crc32", "text_crc32"],
            )

    return encoded(docs, path, chunk).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint")
