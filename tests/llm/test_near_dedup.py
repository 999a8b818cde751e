import random
import re

import pytest

from panelweave.llm import near_dedup
from panelweave.llm.components import components
from panelweave.llm.text import shingle_set, word_hashes


def brute_sets(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_classes(docs, percent=85):
    sets = [brute_sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: (len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(docs)}


def words(rng, n, kinds=5000):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def fixture(seed):
    """Copies, variants on both sides of the threshold, chains, shared passages, short and empty texts."""
    rng = random.Random(seed)
    texts = []
    base = words(rng, 300)
    for _ in range(120):  # a group around one source: some linked with it, some with each other, some alone
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            del t[: rng.randrange(0, 40)]
        texts.append(" ".join(t))
    chain = words(rng, 200)
    for step in range(25):  # neighbours are linked, ends are not
        chain = [*chain[4:], *words(rng, 4)]
        texts.append(" ".join(chain))
    passage = words(rng, 60)
    for _ in range(90):  # much in common, and yet not similar
        texts.append(" ".join(words(rng, rng.randrange(5, 60)) + passage + words(rng, rng.randrange(5, 60))))
    for _ in range(40):
        texts.append(" ".join(words(rng, rng.randrange(1, 12), 4)))
    texts += [texts[3]] * 30 + [texts[3].upper().replace("W", "w")] * 3 + ["", " \n\t", "a", "A", "a b", "ä b c d e"]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(rows, seed):
    docs = fixture(seed)
    got = near_dedup.near_duplicates(rows("doc_id long, text string", docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_classes(docs)


def test_edge_cases(rows):
    long = " ".join(f"v{i}" for i in range(40))
    data = [(5, None, 1), (None, long, 2), (7, long, 3), (7, long, 4), (9, long, 5), (3, "", 6), (9, "other words here", 7)]
    got = near_dedup.near_duplicates(rows("doc_id long, text string, component_id int", data)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(5, 0, 5, True), (None, 36, None, True), (7, 36, 7, True), (7, 36, 7, True), (9, 36, 7, False), (3, 0, 3, True), (9, 1, 7, False)],
        key=repr,
    )
    assert near_dedup.near_duplicates(rows("doc_id long, text string", [])).count() == 0


def test_ids_with_several_texts_tie_classes(rows):
    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    got = near_dedup.near_duplicates(rows("doc_id long, text string", [(1, a), (2, a), (2, b), (4, b), (5, c)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (4, 1), (5, 5)}


def test_components_of_chains_and_stars(rows):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    links = chain + star + chain[:5] + [(1, 1), (None, 3), (500, 499)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(rows("a long, b long", links)).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(200, 260)} | {7: 7, 500: 499, 499: 499}
    assert got == want
    assert components(rows("a long, b long", [])).count() == 0


def test_word_hashes_across_blocks(monkeypatch):
    from panelweave.llm import text

    value = "Ab cd " * 50 + "x" * 300 + "\téè end"
    whole = word_hashes(value).tolist()
    monkeypatch.setattr(text, "BLOCK", 64)
    assert word_hashes(value).tolist() == whole and len(whole) == 103
    assert word_hashes("AB cd")[0] == word_hashes("ab x")[0] != word_hashes("ba")[0]
    assert len(shingle_set("a b c", 5)) == 1 and len(shingle_set(None, 5)) == 0
