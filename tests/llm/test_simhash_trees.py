import random
import re

import pytest
import xxhash

from panelweave.llm import queries, simhash_trees as st

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    width = min(3, len(words))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, codes, radius=2):
    """Component of every place, by comparing all pairs."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b c", "a b c a b c a b c", "Ä É\x0bz\x1cq  B c d", "ß x y z " * 50])
def test_fingerprint(text):
    assert st.fingerprint(text)[0] == plain_fingerprint(text)


def test_fingerprint_of_long_texts_in_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(4000)) + " " + "y" * 9000 + "\n\n tail Z"
    want = plain_fingerprint(text)
    monkeypatch.setattr("panelweave.llm.text.BLOCK", 1000)
    monkeypatch.setattr(st, "_SHINGLES", 64)
    assert st.fingerprint(text) == (want, 4001)


def clustered(seed, n=700):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(n // 7)]
    while len(codes) < n:  # near ones, chains of them, and others just out of reach
        code = rng.choice(codes)
        for bit in rng.sample(range(64), rng.randrange(5)):
            code ^= 1 << bit
        codes.append(code)
    return codes


def test_tree_finds_what_a_scan_finds():
    codes = clustered(1)
    codes += codes[:20]
    tree = st.Tree()
    for code in codes:
        tree.add(code)
    for asked in codes[::9] + clustered(2, 30):
        for radius in (0, 2, 5):
            assert sorted(tree.near(asked, radius)) == [i for i, c in enumerate(codes) if (c ^ asked).bit_count() <= radius]
    assert st.Tree().near(5, 2) == []


def test_bands_share_no_bit_and_cover_all():
    for mask in (0, 0xFF, (1 << 64) - 1 - 0b1011):
        cut = [b & ~mask for b in st.bands(mask, 2)]
        assert sum(cut) == (1 << 64) - 1 - mask and all(b & mask == mask for b in st.bands(mask, 2))


@pytest.mark.parametrize("hot", [2, 12, 1024])
def test_links_connect_all_near_pairs(spark, rows, hot):
    from panelweave.llm.components import components

    rng = random.Random(4)
    dense = rng.getrandbits(64)
    codes = sorted({*clustered(5, 400), *(dense ^ rng.getrandbits(7) ^ (rng.getrandbits(5) << 40) for _ in range(300)), 0, (1 << 64) - 1})
    frame = rows("code long", [(st._signed(c),) for c in codes])
    got = dict(components(st.links(frame, hot=hot)).collect())
    want = plain_classes([st._signed(c) for c in codes], codes)
    assert [got.get(st._signed(c), st._signed(c)) for c in codes] == want


def test_documents_in_all_conditions(rows):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    data = [(40, " ".join(base)), (3, " ".join([*base[:399], "other"])), (50, " ".join(base).upper()), (8, None), (9, ""), (None, " \n"), (11, "lone")]
    data += [(60 + i, " ".join(rng.sample(base, 50))) for i in range(40)] + [(40, "another text of the same id"), (None, "unnamed"), (11, "lone")]
    docs = rows("doc_id long, text string, code string, mask int, component int", [(*r, "x", 1, 2) for r in data])
    got = st.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "n_shingles"]
    codes = [plain_fingerprint(t) for _, t in data]
    want = [(i, f"{c:016x}", k) for (i, _), c, k in zip(data, codes, plain_classes([i for i, _ in data], codes), strict=True)]
    assert sorted(map(str, (tuple(r)[:3] for r in got.collect()))) == sorted(map(str, want))
    assert st.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    codes = [plain_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{c:016x}", k) for r, c, k in zip(docs, codes, plain_classes([r.doc_id for r in docs], codes), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op13_simhash_trees(spark, SMALL).collect()} == want
