"""Compression classifier, masked language model and graph search."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import graph_search, masked_lm, quality_classifier


def good(rng):
    return " ".join(rng.choice(["river", "stone", "under", "clear", "water", "runs", "slowly", "home."]) for _ in range(rng.randrange(40, 200)))


def bad(rng):
    return " | ".join(rng.choice(["BUY", "NOW", "$$$", "WIN", "CASH", "!!!"]) for _ in range(rng.randrange(40, 200)))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    return [(i, good(rng) if i % 4 else bad(rng), int(i % 4 > 0)) for i in range(300)]


def test_classifier_on_held_out_rows(rows, labelled):
    docs = rows("doc_id long, text string, score int", [(i, t, 1) for i, t, _ in labelled] + [(901, None, 1), (902, "", 1), (None, "river", 1)])
    labels = rows("doc_id long, quality int, toxic int", [(i, y, 0) for i, _, y in labelled] + [(None, 1, 0), (5, None, 0), (7, 9, 0)])
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == 303
    for i, _, _ in labelled:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(got[i].score >= 0.3) and 0 <= got[i].score <= 1
    right = [got[i].predicted == y for i, _, y in labelled if got[i].held_out]
    assert len(right) > 30 and sum(right) >= 0.95 * len(right)
    assert got[901].score == got[902].score and 0 <= got[901].score <= 1
    assert not got[None].held_out


def test_labels_of_held_out_rows_are_not_learned(rows, labelled):
    docs = rows("doc_id long, text string", [(i, t) for i, t, _ in labelled])
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in labelled]
    a = quality_classifier.train(docs, rows("doc_id long, quality int", [(i, y) for i, _, y in labelled]))
    assert a == quality_classifier.train(docs, rows("doc_id long, quality int", flipped))


def test_classifier_without_labels_or_rows(rows):
    docs = rows("doc_id long, text string", [(1, "x"), (2, "")])
    labels = rows("doc_id long, quality int", [])
    assert {r.score for r in quality_classifier.quality_scores(docs, labels).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_long_texts_count_to_their_end():
    rng = random.Random(1)
    model = quality_classifier.fit([good(rng) for _ in range(40)] + [bad(rng) for _ in range(40)], [1] * 40 + [0] * 40)
    g, b = (quality_classifier._compressor(c) for c in (model.good, model.bad))
    score = lambda t: model.score(np.array([quality_classifier.measures(t, g, b)]))[0]
    head = " ".join(good(rng) for _ in range(10))
    assert score(head) > 0.9 > 0.3 > score(head[:2000] + " ".join(bad(rng) for _ in range(60)))


def test_gradients():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, masked_lm.TOKENS, 60).astype(np.int32)
    weights = {k: v.astype(float) for k, v in masked_lm.initial(np.ones(masked_lm.TOKENS)).items()}
    (stream, _, scored), = masked_lm.streams(iter([tokens]))
    at, windows = masked_lm.contexts(stream, scored)

    def loss(w):
        return -masked_lm.forward(w, windows, stream[at])[0].astype(float).mean()

    grads = masked_lm.gradients(weights, masked_lm.forward(weights, windows, stream[at])[1])
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        up, down = ({n: v.copy() for n, v in weights.items()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[i]) < 1e-3 * max(1, abs(g[i]))


def test_probabilities_sum_to_one_and_long_texts_split_exactly(monkeypatch):
    weights = masked_lm.initial(np.arange(masked_lm.TOKENS) + 1.0)
    window = np.array([[3, 7, 9, 11]])
    value, _ = masked_lm.forward(weights, np.repeat(window, masked_lm.TOKENS, 0), np.arange(masked_lm.TOKENS))
    assert abs(np.exp(value.astype(float)).sum() - 1) < 1e-4
    texts = [np.arange(n, dtype=np.int32) % masked_lm.TOKENS for n in (0, 1, 700, 40)]
    whole = masked_lm.score_texts(weights, texts)
    monkeypatch.setattr(masked_lm, "STEP_TOKENS", 64)
    assert np.allclose(masked_lm.score_texts(weights, texts), whole, rtol=1e-4) and whole[0] == 0


def test_order_is_learned(rows):
    rng = random.Random(5)
    follow = {w: [rng.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}

    def text(n):
        out = [rng.choice("abcdefghijklmnop")]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    data = [(i, " ".join(text(400))) for i in range(300)]
    kept = text(400)
    mixed = rng.sample(kept, len(kept))
    extra = [(900, " ".join(kept)), (901, " ".join(mixed)), (902, None), (903, " \n"), (None, "a b")]
    docs = rows("doc_id long, text string, n_tokens int", [(i, t, 0) for i, t in data + extra]).repartition(2)
    got = {r.doc_id: r for r in masked_lm.scores(docs).collect()}
    assert len(got) == 305 and got[900].n_tokens == 400
    assert got[900].mean_log_likelihood > got[901].mean_log_likelihood + 0.5
    assert (got[902].n_tokens, got[902].log_likelihood, got[902].mean_log_likelihood) == (0, 0.0, None) == tuple(got[903])[1:]
    assert masked_lm.scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, masked_lm.SENT_WORDS])
def test_words_that_share_a_token_are_told_apart(rows, monkeypatch, sent):
    monkeypatch.setattr(masked_lm, "SENT_WORDS", sent)
    own = [f"w{i}" for i in range(masked_lm.TOKENS - masked_lm.HASHED)]
    token = lambda w: zlib.crc32(w.encode()) % masked_lm.HASHED
    often, seldom = next((f"x{i}", f"x{j}") for j in range(2000) for i in range(j) if token(f"x{i}") == token(f"x{j}"))
    line = " ".join(own)
    data = [(i, line) for i in range(20)] + [(50 + i, often) for i in range(6)]
    data += [(90, f"{line} {often} {line}"), (91, f"{line} {seldom} {line}")]
    docs = rows("doc_id long, text string", data)
    got = {r.doc_id: r for r in masked_lm.scores(docs).collect()}
    assert len(got) == len(data) and got[90].n_tokens == got[91].n_tokens == 2 * len(own) + 1
    assert got[90].log_likelihood - got[91].log_likelihood == pytest.approx(np.log(7 / 1), abs=1e-2)
    shares = [r.share for r in masked_lm.train(docs).shares.collect()]
    assert len(shares) == 2 and np.exp(shares).sum() == pytest.approx(1)


def test_looking_up_words_keeps_none_of_them(monkeypatch):
    monkeypatch.setattr(masked_lm, "CHUNK_WORDS", 1000)
    own, texts = ["w0", "w7"], [" ".join(f"W{i}" for i in range(k, k + 500)) for k in range(0, 100_000, 500)] + [None, "w7 w0 x x"]
    vocabulary = masked_lm.Vocabulary(own, {"x": -1.0})
    tracemalloc.start()
    seen = 0
    for text, tokens in zip(texts, vocabulary.tokens(texts), strict=True):
        words = (text or "").lower().split()
        shared = [masked_lm.TOKENS - masked_lm.HASHED + zlib.crc32(w.encode()) % masked_lm.HASHED for w in words]
        assert tokens.tolist() == [own.index(w) if w in own else t for w, t in zip(words, shared, strict=True)]
        seen += len(tokens)
    assert seen == 100_004 and tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


def test_asked_words_of_every_text():
    texts = ["b a b", "", "c", None, "a b"]
    (ends, words), = masked_lm.chunks(texts)
    number = np.repeat(np.arange(5), np.diff(ends, prepend=0))
    got = masked_lm._asked(number, words, 5).to_pylist()
    assert [{d["word"]: d["n"] for d in g} for g in got] == [dict(Counter((t or "").split())) for t in texts]
    none = masked_lm._asked(number[:0], words.slice(0, 0), 2)
    assert none.to_pylist() == [[], []] and none.type == pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))


def test_long_texts_in_several_chunks(rows):
    """More words in a task than are looked up at once: every row keeps its id and its own words."""
    texts = {5: "a b " * 150_000, 6: None, 7: "c D e " * 100_000, 8: "a c", None: "d", 9: "b " * 10}
    docs = rows("doc_id long, text string", list(texts.items())).coalesce(1)
    got = {r.doc_id: r for r in masked_lm.scores(docs).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len((t or "").split()) for i, t in texts.items()}
    assert all((r.log_likelihood < 0) == (r.n_tokens > 0) for r in got.values())
    counted = {r.word: r.n for r in masked_lm.word_counts(docs).collect()}
    assert counted == {"a": 150_001, "b": 150_010, "c": 100_001, "d": 100_001, "e": 100_000}


def brute_nearest(data, every, top):
    clean = {}
    for i, v in data:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            clean.setdefault(i, set()).add(tuple(v))
    out = {}
    for q, own in clean.items():
        if q % every == 0:
            found = set()
            for v in own:
                for i, others in clean.items():
                    found |= {(float(np.sqrt(((np.array(v) - np.array(o)) ** 2).sum())), i) for o in others if i != q and len(o) == len(v)}
            out[q] = sorted(found)[:top]
    return out


def test_search_finds_the_nearest(rows, monkeypatch):
    monkeypatch.setattr(graph_search, "SHARD_ROWS", 300)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    data = [(i, [float(c) for c in centres[i % 12] + 0.4 * rng.standard_normal(16)]) for i in range(900)]
    known = rows("vec_id long, embedding array<double>, label int, v int", [(i, v, 0, 0) for i, v in data])
    index = graph_search.build_index(graph_search.vectors(known), shard_rows=300)
    assert index.count() > 1
    asked = graph_search.vectors(known).filter("vec_id % 20 = 0")
    got = {}
    for r in sorted(graph_search.search(index, asked).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_nearest(data, 20, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
    for q, w in got.items():
        assert w == sorted(w) and all(abs(s - np.linalg.norm(np.array(data[q][1]) - np.array(data[i][1]))) < 1e-9 for s, i in w)


def test_search_edge_cases(rows):
    same = [1.0, 2.0]
    data = [(i, same) for i in range(0, 40)] + [(100, None), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [float("nan"), 1.0])]
    data += [(500, [float("inf"), 1.0]), (None, [1.0, 2.1]), (600, [1.0, 2.0, 3.0]), (700, [1.0, 2.5]), (700, [1.0, 2.5]), (800, [])]
    docs = rows("vec_id long, embedding array<double>", data)
    got = {}
    for r in graph_search.nearest(docs).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [(i, s) for _, i, s in sorted(got[0])] == [(i, 0.0) for i in range(1, 11)]
    assert [(i, s) for _, i, s in sorted(got[700])] == [(i, 0.5) for i in range(10)]
    assert set(got) == {0, 700}
    few = rows("vec_id long, embedding array<double>", [(0, same), (1, [1.0, 3.0])])
    assert [tuple(r) for r in graph_search.nearest(few).collect()] == [(0, 1, 1, 1.0)]
    assert graph_search.nearest(docs.limit(0)).count() == 0


def test_recall_of_a_full_shard(rows):
    """The production constants on a shard as full as it gets, of vectors that lie as far apart as they can."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(graph_search.SHARD_ROWS, 64)).astype(np.float32).astype(float)
    graph, entry = graph_search.build_graph(x.astype(np.float32))
    asked = x[::100]
    beam, _ = graph_search.beam_search(x.astype(np.float32), graph, entry, asked.astype(np.float32), graph_search.SEARCH_WIDTH)
    hit = 0
    for own, q, found in zip(range(0, len(x), 100), asked, beam, strict=True):
        gap = ((x - q) ** 2).sum(axis=1)
        gap[own] = np.inf
        hit += len(set(np.argsort(gap)[:10].tolist()) & set(found.tolist()))
    assert hit >= 0.9 * 10 * len(asked)
