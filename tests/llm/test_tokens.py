"""SentencePiece scan, packing and packed output."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from panelweave.llm import best_fit_packing, packed_output, pieces, sentencepiece_scan  # noqa: E402

ALPHABET = list("aabcdeehinorst  ▁\n\t.,-é€😀İ0123456789")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_scan.VOCABULARY))


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_scan.Codec(public_tokenizers.path(sentencepiece_scan.VOCABULARY))


def scan(codec, text, chunk):
    whole, parts = sentencepiece_scan.marked(text), []
    for at in range(0, len(whole), chunk):
        left = min(at, codec.longest)
        parts.append((whole[at - left : at + chunk + codec.longest], left, min(chunk, len(whole) - at)))
    matrices = [codec.matrix(*p) for p in parts]
    reach = 1
    for m in matrices:
        reach = sentencepiece_scan.times([reach], m)[0]
    states = sentencepiece_scan.trace(matrices, 0, (reach & -reach).bit_length() - 1)
    return b"".join(codec.chunk_ids(*p, i, o) for p, i, o in zip(parts, states, states[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(ALPHABET), max_size=120), chunk=st.integers(17, 80))
def test_ids_are_those_of_the_library(library, codec, text, chunk):
    want = np.array(library.encode(text), "<u4").tobytes()
    assert codec.words(sentencepiece_scan.marked(text)) == want
    assert codec.text_of(want) == library.decode(library.encode(text))
    if text:
        assert scan(codec, text, chunk) == want


def test_letters_and_marks_are_solved_apart_and_pairs_are_bounded(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "KNOWN_PAIRS", 40)
    codec, asked = sentencepiece_scan.Codec(public_tokenizers.path(sentencepiece_scan.VOCABULARY)), []
    solve, codec.known.solve = codec.known.solve, lambda words: [asked.extend(words), solve(words)][1]
    for text in ("alpha, alpha. alpha", "alpha!  (alpha)", "reation\nthndble 12² m²x_1 été, 数据 ÅÉ\u0301x"):
        assert codec.words(sentencepiece_scan.marked(text)) == np.array(library.encode(text), "<u4").tobytes()
        assert sum(map(len, codec.stable.values())) <= 40
    assert asked.count("▁alpha") == 1 and asked.count(",") == 1 and not {"▁alpha,", "▁alpha."} & {*asked}


def test_products_of_matrices_do_not_depend_on_grouping(codec):
    rng = random.Random(3)
    a, b, c = ([rng.randrange(1 << 6) for _ in range(6)] for _ in range(3))
    t = sentencepiece_scan.times
    assert t(t(a, b), c) == t(a, t(b, c))


def test_long_documents_go_through_the_scan(rows, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "BLOCK", 4)
    rng = random.Random(1)
    texts = [None, "", " ", "x" * 3000, "".join(rng.choice(ALPHABET) for _ in range(2500)), "short one", "▁▁a" * 500]
    docs = rows("doc_id long, text string, ids int", [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[4], 1), (5, texts[5], 1)])
    ids = sentencepiece_scan.encoded(docs, chunk=100)
    got = ids.collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[4] if r.doc_id is None else texts[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(text or "")
    for r in sentencepiece_scan.decoded(ids).collect():
        text = texts[4] if r.doc_id is None else texts[r.doc_id]
        assert r.text == (text or "").replace("▁", " ")
    assert sentencepiece_scan.encoded(docs.limit(0)).count() == 0


def sequences(plan, counts, capacity):
    """Contents by sequence; checks that ranks are whole and offsets gapless."""
    seen, out = dict.fromkeys(counts, 0), {}
    for length, first, end, each, sequence, offset in sorted(plan.rows):
        assert first == seen[length]
        seen[length] = end
        for rank in range(first, end):
            out.setdefault(sequence + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
    assert seen == {k: n for k, n in counts.items()}
    for content in out.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(out) == list(range(plan.sequences))
    return out


def one_by_one(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=rooms.__getitem__)] -= length
            else:
                rooms.append(capacity - length)
    return sorted(rooms)


LENGTHS = st.lists(st.integers(1, 40), max_size=60)


@settings(max_examples=200, deadline=None)
@given(LENGTHS)
def test_best_fit_decreasing_is_that_of_single_pieces(lengths):
    counts = {k: lengths.count(k) for k in set(lengths)}
    got = sequences(packed_output.best_fit_decreasing(counts, 40), counts, 40)
    assert sorted(40 - sum(n for _, n in c) for c in got.values()) == one_by_one(counts, 40)


@settings(max_examples=200, deadline=None)
@given(LENGTHS)
def test_minimum_slack_fills(lengths):
    counts = {k: lengths.count(k) for k in set(lengths)}
    got = sequences(best_fit_packing.minimum_slack(counts, 40), counts, 40)
    assert len(got) <= len(one_by_one(counts, 40)) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fullest_is_the_best_sum(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums |= {s + k * i for s in sums for i in range(n + 1)}
    used = best_fit_packing.fullest(counts, room)
    assert sum(k * n for k, n in used) == max(s for s in sums if s <= room)
    assert all(n <= counts[k] for k, n in used)


TEXTS = [None, "", "One two three.", "x" * 500, "wörter und mehr  " * 700, "a\x1cb\u2003c!\x1c!d", "İstanbul ΑΣ it's 12", "tab\tand\nline "]


def test_packed_documents(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    data = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (2, TEXTS[2], 0)]
    docs = rows("doc_id long, text string, length int", data).repartition(3)
    got = best_fit_packing.packed_documents(docs, capacity=512).collect()
    by_sequence = {}
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = np.array(ids[r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and r.start == 512 * r.piece
        assert r.ids == own.tobytes() and r.ids_crc32 == zlib.crc32(own.tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in by_sequence.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.doc_id == 2 for r in got) == 2
    assert best_fit_packing.packed_documents(docs.limit(0)).count() == 0


def test_matrices_hold_the_texts(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = rows("doc_id long, text string", [(i, t) for i, t in enumerate(TEXTS)])
    got = packed_output.packed_matrices(docs, capacity=256).collect()
    parts = {}
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[-1] == r.n_tokens
        assert (ids[r.n_tokens :] == packed_output.PAD_ID).all()
        for doc_id, piece, at, end in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[at:end].tolist() == list(range(end - at))
            parts.setdefault(doc_id, {})[piece] = ids[at:end].tolist()
    for i, text in enumerate(TEXTS):
        ids = sum((parts[i][p] for p in sorted(parts[i])), [])
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, packed_output.END_ID]
        assert tokenizer.decode(ids[:-1]) == (text or "")
    assert packed_output.packed_matrices(docs.limit(0)).count() == 0


def test_words_forgotten_and_solved_again():
    from panelweave.llm.text import Remembered

    asked = []
    kept = Remembered(lambda new: [asked.append(w) or w.encode() for w in new], 3)
    assert kept.joined(["a", "b", "a"]) == b"aba"
    assert kept.joined(["c", "d"]) == b"cd" and kept.joined(["a", "d"]) == b"ad"
    assert sorted(asked) == ["a", "b", "c", "d"]
    assert pieces.WordIds.of(public_tokenizers.path("byte_bpe_50k.json"), True, "<u2").ids("") == b""


UNITS = [*"aabsdmtlvreLS''  \n\n\t.,!\"12é×÷²½ªßſɏʼ…“数İ̈😀\x0b\x1c\xa0_-\r", "'s", "'ll", "'ve", " '", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(UNITS), max_size=30).map("".join), max_size=8))
def test_ids_of_texts_together_are_those_of_each(texts):
    encoder = pieces.WordIds.of(public_tokenizers.path("byte_bpe_50k.json"), True, "<u2")
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert list(encoder.many(iter(texts))) == want


def test_parts_of_words_are_solved_once():
    encoder, asked = pieces.WordIds(public_tokenizers.path("byte_bpe_50k.json"), True, "<u2"), []
    solve, encoder.known.solve = encoder.known.solve, lambda new: [asked.extend(new), solve(new)][1]
    list(encoder.many(iter(["so alpha, alpha. alpha!", "an alpha\nalpha's, 12", "", "alpha"])))
    assert sorted(asked) == sorted(["so", " alpha", ",", ".", "!", "an", "\n", "alpha", "'s", " 12"])
