"""Compression classifier: two zstandard dictionaries, one of good and one of bad labelled text. A text is compressed with
both; the difference of the two sizes per input byte, calibrated by a logistic curve that also knows how far the text
compresses at all, is its score.

Whole texts are compressed, in pieces of ``PIECE`` bytes that each start from the dictionary alone, so that a long text is
judged by the dictionaries to its end and not by what it has said before."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .text import columns

FIT_ROWS = 1500  # labelled texts of each class, at most: the bound of the sample that is fitted
FIT_CHARS = 16_384  # longer texts are not taken for the fit (they are scored whole)
DICT_BYTES = 112 * 1024
PIECE = 1024
LEVEL = 6
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionary contents for label 1 and label 0, and the logistic curve over their sizes."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -35, 35)))


def _compressor(content: bytes):
    import zstandard

    if not content:
        return zstandard.ZstdCompressor(level=LEVEL)
    kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False)


def measures(text: str, good, bad) -> tuple[float, float]:
    """(size with the bad dictionary - size with the good one) / bytes, and the log of the smaller size / bytes, by
    which the curve knows a text that compresses anyway, as repetitions do; (0, 0) for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return 0.0, 0.0
    with_good = with_bad = 0
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        with_good += len(good.compress(piece))
        with_bad += len(bad.compress(piece))
    return (with_bad - with_good) / len(raw), float(np.log(min(with_good, with_bad) / len(raw)))


def _content(texts: list[str]) -> bytes:
    """Slices spread over all texts until the dictionary is full; zstandard searches it from its end."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    share = max(256, DICT_BYTES // max(1, len(raws)))
    return b"\n".join(r[(len(r) - min(share, len(r))) // 2 :][:share] for r in raws)[:DICT_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes by Newton steps, weakly penalised on scaled inputs; one class gives a flat curve."""
    mean = (y.sum() + 1) / (len(y) + 2)
    flat = np.array([np.log(mean / (1 - mean))] + [0.0] * x.shape[1])
    if not len(x) or y.min() == y.max():
        return flat
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    design = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    weight = np.array([1e-9] + [0.1] * x.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        step = np.linalg.solve(
            (design * (p * (1 - p))[:, None]).T @ design + np.diag(weight), design.T @ (y - p) - weight * beta
        )
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return np.array([beta[0] - slopes @ centre, *slopes])


def fit(texts: list[str], labels: list[int]) -> Model:
    """Half of each class makes the dictionaries, the other half the curve, so that the curve sees unknown text."""
    made = {c: [t for t, y in zip(texts, labels, strict=True) if y == c] for c in (0, 1)}
    dictionary = {c: _content(made[c][::2]) for c in (0, 1)}
    good, bad = _compressor(dictionary[1]), _compressor(dictionary[0])
    rest = [(t, c) for c in (0, 1) for t in made[c][1::2]]
    x = np.array([measures(t or "", good, bad) for t, _ in rest]).reshape(-1, 2)
    return Model(dictionary[1], dictionary[0], tuple(map(float, _logistic(x, np.array([c for _, c in rest], float)))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` texts of each class, in the order of a hash of doc_id, none of them held out.

    Labels other than 0 and 1 and null ids are ignored; an id labelled twice takes its larger label."""
    marked = (
        columns(labels, doc_id="bigint", quality="int")
        .filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    short = columns(docs, doc_id="bigint", text="string").filter(F.char_length("text").between(1, FIT_CHARS)).select("doc_id")
    known = marked.join(short.distinct(), "doc_id")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r.doc_id for c in (0, 1) for r in known.filter(F.col("quality") == c).orderBy(*order).limit(rows).collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    found = (
        columns(docs, doc_id="bigint", text="string")
        .filter(F.char_length("text").between(1, FIT_CHARS))
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * rows ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .join(marked, "doc_id")
        .select("text", "quality", "doc_id")
        .orderBy(*order)
        .collect()
    )
    return fit([r.text for r in found], [r.quality for r in found])


def scorer(model: Model):
    """A vectorised function text -> score."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for texts in parts:
            yield pd.Series(model.score(np.array([measures(t or "", good, bad) for t in texts], float).reshape(-1, 2)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.3) of every row.

    Null text counts as empty and gets the score of an empty text, the curve at (0, 0). A null doc_id is not
    held out. Without any usable label the score is 0.5 everywhere. Equal texts get equal scores; an empty table gives
    an empty table."""
    score = scorer(train(docs, labels))
    return (
        columns(docs, doc_id="bigint", text="string")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be good, with their columns untouched."""
    score = scorer(train(docs, labels))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.withColumn("s", score(F.col("row.text").cast("string"))).filter(F.col("s") >= THRESHOLD).select("row.*")
