"""Masked pseudo-likelihood: a small network predicts every word from the words on both sides of it, and a document's score
is the sum of the log-probabilities it gives to the document's own words.

Words are counted over all documents; the most frequent ones are tokens of their own, the others share tokens by hash and
are told apart within theirs: the probability of such a word is that of its token, given by the network, times the word's
share of all words of the token, taken from the counts. So every counted word has a probability of its own, they sum to
one, and what is known of words grows with the corpus. The counts stay a table: the shares of the most frequent words are
sent to the tasks, those of the others are joined to the words that ask for them.

The network (embeddings of the window, one hidden layer, a softmax in two steps: group, then token within the group) is
trained in numpy by tasks that each run through their part of the documents; after every round their weights are averaged
by the number of tokens seen. Every document takes part in exactly one round."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage
from .text import columns

GROUPS = 24
TOKENS = GROUPS * GROUPS
HASHED = 192  # tokens that the less frequent words share
SIDE = 2  # words of context on either side
EMBEDDED = 8
HIDDEN = 16
ROUNDS = 2
STEP_TOKENS = 8192
RATE = 0.1
PAD = TOKENS
CHUNK_WORDS = 500_000  # words of consecutive texts that are looked up at once, about
COUNTED_WORDS = 500_000  # different words that a task counts before it sends them on, about
SENT_WORDS = 60_000  # words whose shares are sent to the tasks, at most; the result does not depend on it
SENT_CHARS = 64  # longer words are not sent

SHAPES = {
    "e": (TOKENS + 1, EMBEDDED),
    "w": (2 * SIDE * EMBEDDED, HIDDEN),
    "b": (HIDDEN,),
    "gw": (HIDDEN, GROUPS),
    "gb": (GROUPS,),
    "tw": (GROUPS, HIDDEN, GROUPS),
    "tb": (GROUPS, GROUPS),
}
Weights = dict[str, np.ndarray]


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES]).astype(np.float32)


def unpack(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = np.array(flat[at : at + n], np.float32).reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray) -> Weights:
    """Small random weights, and biases that give every token its share of the corpus."""
    rng = np.random.default_rng(5)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = (counts + 1.0).reshape(GROUPS, GROUPS)
    w["gb"] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
    w["tb"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    return w


class Vocabulary:
    """Word -> token and, for a word that shares its token, the log of its share of it: not a number where ``shares`` does
    not hold the word, 0 for a word that has a token of its own."""

    def __init__(self, words: list[str], shares: dict[str, float] | None = None):
        shares = shares or {}
        self.own, self.sent = pa.array(words, pa.string()), pa.array(list(shares), pa.string())
        self.shares = np.array([*shares.values(), np.nan])

    def leaves(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(token, share) of different words."""
        own = _places(words, self.own)
        shares = np.where(own >= 0, 0.0, self.shares[_places(words, self.sent)])  # the last one for words not held
        rest = np.flatnonzero(own < 0)
        own[rest] = TOKENS - HASHED + _hashes(words.take(pa.array(rest))) % HASHED
        return own, shares

    def tokens(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Of every text, in turn."""
        for ends, words in chunks(texts):
            own, _ = self.leaves(words.dictionary)
            yield from np.split(own[words.indices], ends[:-1])


def _places(words: pa.StringArray, held: pa.StringArray) -> np.ndarray:
    """Where ``held`` has the words; -1 for those it has not."""
    return pc.fill_null(pc.index_in(words, value_set=held), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def _hashes(words: pa.StringArray) -> np.ndarray:
    """CRC-32 of the words' UTF-8."""
    raw = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """The words of consecutive texts, about CHUNK_WORDS at once, and where every text ends in them. Different words are
    found by Arrow, so that Python handles each of them once a chunk and keeps none."""
    words, ends = [], []
    for text in texts:
        words += split(text)
        ends.append(len(words))
        if len(words) >= CHUNK_WORDS or len(ends) >= CHUNK_WORDS:
            yield np.array(ends), pa.array(words, pa.string()).dictionary_encode()
            words, ends = [], []
    if ends:
        yield np.array(ends), pa.array(words, pa.string()).dictionary_encode()


_SHIFTS = np.array([k for k in range(-SIDE, SIDE + 1) if k], np.int32)


def contexts(stream: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions to score, their windows without the token itself)."""
    at = np.flatnonzero(scored)
    return at, stream[at[:, None] + _SHIFTS]


ROWS = 1024  # rows of scores that are handled at once, so that they stay in a core's cache


def _log_sums(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logs of the summed exponentials of ``z``, which is bounded in place, so that nothing overflows before 80. Hidden
    values lie within 1: mostly the weights ``w`` and ``b`` that made ``z`` keep it in bounds."""
    bounded = (np.abs(w).sum(axis=-2) + np.abs(b)).max() < 79
    out = np.empty((len(z), 1), z.dtype)
    for at in range(0, len(z), ROWS):
        part = z[at : at + ROWS]
        if not bounded:
            np.clip(part, -80, 80, out=part)
        np.log(np.exp(part).sum(axis=1, keepdims=True), out=out[at : at + ROWS])
    return out


def forward(w: Weights, windows: np.ndarray, target: np.ndarray):
    """Log-probability of each target, and what the backward pass needs. Rows are handled in the order of their group."""
    n = len(target)
    order = np.argsort((target // GROUPS).astype(np.uint8), kind="stable")
    windows, target = windows.take(order, axis=0), target.take(order)
    group, inner = np.divmod(target, GROUPS)
    x = w["e"].take(windows, axis=0).reshape(n, -1)
    h = x @ w["w"]
    h += w["b"]
    np.tanh(h, out=h)
    zg = h @ w["gw"]
    zg += w["gb"]
    zt = np.empty((n, GROUPS), np.float32)
    ends = np.searchsorted(group, np.arange(GROUPS + 1, dtype=group.dtype))
    for g in range(GROUPS):
        part = slice(ends[g], ends[g + 1])
        if part.stop > part.start:
            zt[part] = h[part] @ w["tw"][g]
            zt[part] += w["tb"][g]
    sg, st = _log_sums(zg, w["gw"], w["gb"]), _log_sums(zt, w["tw"], w["tb"])
    at = np.arange(n) * GROUPS
    of_group, of_inner = at + group, at + inner  # the targets' places in the scores
    value = np.empty(n, np.float32)
    value[order] = (zg.ravel().take(of_group) - sg[:, 0]) + (zt.ravel().take(of_inner) - st[:, 0])
    return value, (windows, of_group, of_inner, x, h, (zg, sg), (zt, st), ends)


def _errors(z: np.ndarray, sums: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """In place: the probabilities, less 1 at the targets, over the number of rows."""
    for at in range(0, len(z), ROWS):
        part = z[at : at + ROWS]
        part -= sums[at : at + ROWS]
        np.exp(part, out=part)
    z.ravel()[targets] -= 1
    z /= len(z)
    return z


def gradients(w: Weights, kept) -> Weights:
    """Of the mean negative log-probability. Uses up the scores in ``kept``."""
    windows, of_group, of_inner, x, h, group_scores, inner_scores, ends = kept
    dg, dt = _errors(*group_scores, of_group), _errors(*inner_scores, of_inner)
    dh = dg @ w["gw"].T
    out = {"gw": h.T @ dg, "gb": dg.sum(axis=0), "tw": np.zeros_like(w["tw"]), "tb": np.zeros_like(w["tb"])}
    for g in range(GROUPS):
        part = slice(ends[g], ends[g + 1])
        if part.stop > part.start:
            out["tw"][g] = h[part].T @ dt[part]
            out["tb"][g] = dt[part].sum(axis=0)
            dh[part] += dt[part] @ w["tw"][g].T
    dz = dh * (1 - h * h)
    out["w"], out["b"] = x.T @ dz, dz.sum(axis=0)
    dx = np.ascontiguousarray((dz @ w["w"].T).reshape(-1, EMBEDDED).T)
    flat = windows.ravel().astype(np.intp)
    out["e"] = np.stack([np.bincount(flat, d, TOKENS + 1) for d in dx], axis=1).astype(np.float32)
    return out


class Trainer:
    """Steps with a rate that shrinks per weight as its gradients add up."""

    def __init__(self, weights: Weights):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full_like(v, 1e-6) for k, v in weights.items()}

    def step(self, stream: np.ndarray, scored: np.ndarray) -> int:
        at, windows = contexts(stream, scored)
        if len(at):
            _, kept = forward(self.w, windows, stream[at])
            for k, g in gradients(self.w, kept).items():
                self.seen[k] += g * g
                self.w[k] -= RATE * g / np.sqrt(self.seen[k])
        return len(at)


def streams(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stream, text number of each of its tokens, whether it is scored here): texts one after the other with padding, in
    lengths of about STEP_TOKENS; a longer text goes on in the next stream with the context it needs."""
    pad, parts, owner, size = np.full(SIDE, PAD, np.int32), [], [], 0
    for number, tokens in enumerate(texts):
        whole = np.concatenate([pad, tokens, pad])
        for at in range(0, max(len(tokens), 1), STEP_TOKENS):
            own = whole[at : at + STEP_TOKENS + 2 * SIDE]
            n = len(own) - 2 * SIDE
            parts.append(own)
            owner.append((number, n))
            size += n
            if size >= STEP_TOKENS:
                yield _stream(parts, owner)
                parts, owner, size = [], [], 0
    if parts:
        yield _stream(parts, owner)


def _stream(parts, owner):
    stream = np.concatenate(parts)
    numbers = np.concatenate([np.full(n + 2 * SIDE, k) for k, n in owner])
    scored = np.concatenate([np.r_[np.zeros(SIDE, bool), np.ones(n, bool), np.zeros(SIDE, bool)] for _, n in owner])
    return stream, numbers, scored


def score_texts(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Summed log-probability of each text."""
    out = np.zeros(len(texts))
    for stream, numbers, scored in streams(iter(texts)):
        at, windows = contexts(stream, scored)
        if len(at):
            value, _ = forward(w, windows, stream[at])
            out += np.bincount(numbers[at], value, len(texts))
    return out


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    return (text.as_py() for batch in batches for text in batch.column("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        for _, words in chunks(texts(batches)):
            n = np.bincount(words.indices, minlength=len(words.dictionary))
            parts.append(pa.table({"word": words.dictionary, "n": n}))
            if sum(map(len, parts)) >= 2 * COUNTED_WORDS:
                parts = [merged(parts)]
            if len(parts[0]) >= COUNTED_WORDS:
                yield from merged(parts).to_batches()
                parts = []
        if parts:
            yield from merged(parts).to_batches()

    def merged(parts: list[pa.Table]) -> pa.Table:
        counted = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": counted["word"], "n": counted["n_sum"]})

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """The network, and the shares of the words that share tokens: of the frequent ones here, of all in a table (word, share)."""

    words: list[str]
    weights: Weights
    sent: dict[str, float]
    shares: DataFrame


def _frequent(rest: DataFrame) -> list:
    """The rows of all words from some frequency on, at most SENT_WORDS; no sort of the words."""
    short = rest.filter(F.char_length("word") <= SENT_CHARS)
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = short.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()  # eight rows for each doubling
    total, least = 0, None
    for s, c in sorted(((r.s, r.c) for r in sizes), reverse=True):
        total += c
        if total > SENT_WORDS:
            break
        least = s
    return [] if least is None else short.filter(step >= least).collect()


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """From all of ``docs`` (text). Ties in frequency go by the word."""
    counts = stage(word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(TOKENS - HASHED).collect()  # the tokens: a fixed number of rows
    words = [r.word for r in top]
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(HASHED)).cast("int")
    own = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    rest = counts.join(own, "word", "left_anti").withColumn("t", bucket)
    shared = {r.t: r.n for r in rest.groupBy("t").agg(F.sum("n").alias("n")).collect()}  # HASHED rows
    totals = [shared.get(t, 0) for t in range(HASHED)]
    start = np.array([r.n for r in top] + [0] * (TOKENS - HASHED - len(top)) + totals)
    weights = initial(start.astype(float))
    for k in range(rounds):
        weights = _round(docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), words, weights)
    sent = {r.word: math.log(r.n / totals[r.t]) for r in _frequent(rest)}
    total = F.get(F.array(*[F.lit(float(n)) for n in totals]), F.col("t"))
    return Model(words, weights, sent, rest.select("word", F.log(F.col("n") / total).alias("share")))


def _round(docs: DataFrame, words: list[str], weights: Weights) -> Weights:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, vocabulary, n = Trainer(weights), Vocabulary(words), 0
        for stream, _, scored in streams(vocabulary.tokens(texts(batches))):
            n += trainer.step(stream, scored)
        if n:
            flat = pack(trainer.w).astype(np.float64)
            yield pa.record_batch(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n), pa.array(np.full(len(flat), n, np.int64))],
                names=["at", "value", "n"],
            )

    rows = docs.select("text").mapInArrow(run, "at int, value double, n bigint")
    mean = rows.groupBy("at").agg((F.sum("value") / F.sum("n")).alias("v")).collect()  # one row for each weight
    if not mean:
        return weights
    flat = pack(weights)
    flat[[r.at for r in mean]] = [r.v for r in mean]
    return unpack(flat)


def _asked(number: np.ndarray, words: pa.DictionaryArray, n: int) -> pa.ListArray:
    """For each of ``n`` texts its different words, from the words and the number of the text that each lies in."""
    size = max(len(words.dictionary), 1)
    pairs, counts = np.unique(number * size + words.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32)
    found = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pairs % size)), pa.array(counts)], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood (null without tokens) of every row.

    Null and blank texts have no token and a sum of 0. Null ids are kept; repeated rows train and score once each; other
    columns are ignored; an empty table gives an empty table."""
    clean = columns(docs, doc_id="bigint", text="string")
    model = train(clean, rounds)
    words, weights, sent = model.words, model.weights, model.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row = Vocabulary(words, sent), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for ends, chunk in chunks(texts([batch])):
                n, sizes = len(ends), np.diff(ends, prepend=0)
                leaf, share = (of[chunk.indices] for of in vocabulary.leaves(chunk.dictionary))
                number = np.repeat(np.arange(n), sizes)
                unsent = np.isnan(share)
                share[unsent] = 0.0
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + n)),
                        ids.slice(at, n),
                        pa.array(sizes, pa.int64()),
                        pa.array(score_texts(weights, np.split(leaf, ends[:-1])) + np.bincount(number, share, n)),
                        _asked(number[unsent], chunk.take(pa.array(np.flatnonzero(unsent))), n),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "asked"],
                )
                row, at = row + n, at + n

    made = clean.mapInArrow(
        run, "row bigint, doc_id bigint, n_tokens bigint, known double, asked array<struct<word: string, n: bigint>>"
    )
    made = stage(made, "scored")
    asked = made.select("row", F.explode("asked").alias("q")).select("row", "q.word", "q.n")
    rest = asked.join(model.shares, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    return (
        made.drop("asked")
        .join(rest, "row", "left")
        .select(
            "doc_id",
            "n_tokens",
            total.alias("log_likelihood"),
            F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"),
        )
    )
