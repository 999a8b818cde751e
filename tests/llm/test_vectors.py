"""Vector codes and hard negatives against plain loops and SQL."""

import math
import os

import duckdb
import numpy as np
import pytest

from panelweave.llm import hard_negatives as hn, integer_vectors as iv, queries, vector_codes as vc

ROOT = "/root/testdata"


def sql(query, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{ROOT}/{sf}/embeddings.parquet')")
    cur = con.execute(query)
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, sf):
    got = queries.QUERIES[name](spark, f"{ROOT}/{sf}")
    names, want = sql(queries.ORACLES[name], sf)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want)


# vector codes


def test_hilbert_keys_visit_neighbouring_cells():
    side = np.arange(16)
    grid = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    key = vc.hilbert_keys(grid * 4369)  # 16 bits a dimension: cell k of 16 is k * 65535 / 15
    walk = grid[np.argsort(key)]
    assert len(set(key.tolist())) == 256 and np.abs(np.diff(walk, axis=0)).sum(axis=1).max() == 1
    assert len(vc.hilbert_keys(np.ones((3, 90), np.int64))) == 3


@pytest.mark.parametrize("seed", range(4))
def test_shortlists_keep_every_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-40, 40, (30, 3))
    for _ in range(50):
        points = rng.integers(-40, 40, 3) + rng.integers(-6, 7, (20, 3))
        fit = vc.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
        entry, gap = vc.nearest(points, book, np.flatnonzero(fit))
        full = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (gap == full.min(axis=1)).all()


def plain_codes(data, parts=16, entries=64, rounds=2):
    """[(vec_id, code, error, label_error)] of (vec_id, label, ints), in loops."""
    data = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(data[0][2]) // parts
    cut = [[r[2][p * width : (p + 1) * width] for r in data] for p in range(parts)]
    codes, errors = [], [0] * len(data)
    for own in cut:
        book = [list(x) for x, r in zip(own, data, strict=True) if r[0] is not None][:entries]
        for step in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book)) for x in own]
            if step == rounds:
                break
            for k in {k for _, k in near}:
                mine = [x for x, (_, j) in zip(own, near, strict=True) if j == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        codes.append([k for _, k in near])
        errors = [e + d for e, (d, _) in zip(errors, near, strict=True)]
    by_label = {}
    for r, e in zip(data, errors, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    text = ["".join(f"{c:02x}" for c in code) for code in zip(*codes, strict=True)]
    return [(r[0], t, e, by_label[r[1]]) for r, t, e in zip(data, text, errors, strict=True)]


@pytest.mark.parametrize("chunk,block", [(1 << 15, 64), (50, 7)])
def test_codes_against_loops(spark, rows, chunk, block):
    rng = np.random.default_rng(9)
    data = [(int(i), int(rng.integers(3)), rng.normal(0, 40, 32).astype(int).tolist()) for i in rng.permutation(230)]
    data += [data[0], data[1], (None, 1, data[5][2]), (7, None, [3] * 32), (400, None, [3] * 32)]
    frame = rows("vec_id long, label long, v array<int>", data).repartition(3)
    found, books = vc.compressed(frame, chunk=chunk, block=block)
    want = [r[:3] for r in plain_codes(data)]
    assert sorted(map(str, ((r.vec_id, r.code, r.error) for r in found.collect()))) == sorted(map(str, want))
    assert books.shape == (16, 64, 2)


def test_codes_of_rows_in_all_conditions(rows):
    full = [[0.01 * i * (-1) ** d * (d + 1) for d in range(16)] for i in range(20)]
    data = [(i, i % 2, v) for i, v in enumerate(full)] + [(30, None, full[3]), (31, None, full[4]), (3, 1, full[3])]
    bad = [(40, 1, None), (41, 1, []), (42, 1, [math.nan] * 16), (43, 1, [None, *[1.0] * 15]), (44, 1, [math.inf, *[1.0] * 15]), (45, 1, [1.0] * 5)]
    schema = "vec_id long, label int, embedding array<float>, code string, part int, chunk int, dim int, x int, v int"
    frame = rows(schema, [(*r, "c", 1, 2, 3, 4, 5) for r in data + bad])
    got = vc.code_report(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain_codes([(i, y, [math.floor(256 * float(np.float32(c))) for c in v]) for i, y, v in data])
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert vc.code_report(frame.limit(0)).count() == 0
    assert vc.code_report(rows(schema, [(1, 1, [1.0] * 5, *"abc", 1, 1, 1)][:0])).count() == 0
    assert vc.code_report(rows("vec_id long, label int, embedding array<float>", [(1, 1, [1.0] * 5), (None, 1, [1.0] * 16)])).count() == 0


def test_too_large_components_say_so(rows):
    frame = rows("vec_id long, label int, embedding array<double>", [(1, 1, [1e30] * 16)])
    with pytest.raises(Exception, match="a component exceeds"):
        iv.integer_vectors(frame).collect()


# hard negatives


def plain_negatives(data, every=50, positives=5, negatives=3, low=50, high=95):
    data = sorted({(i, y, tuple(v)) for i, y, v in data})
    out = []
    for a, label, v in data:
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in data if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            hard = [(i, -t) for t, i, y in scored if y != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(hard[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("seed,spread,shard_rows", [(1, 1.0, 1 << 16), (2, 0.1, 90), (3, 4.0, 40)])
def test_negatives_against_loops(spark, rows, monkeypatch, seed, spread, shard_rows):
    monkeypatch.setattr(hn, "FIRST_BLOCK", 8)
    monkeypatch.setattr(hn, "LAST_BLOCK", 16)
    monkeypatch.setattr(hn, "MEMBERS", 6)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 30, (6, 12))
    x = (centres[rng.integers(6, size=400)] + rng.normal(0, 30 * spread, (400, 12))).astype(int)
    x[50], x[100], x[7] = 0, x[0], x[8]
    data = [(int(i), int(rng.integers(4)), v.tolist()) for i, v in zip(rng.permutation(400), x, strict=True)]
    data += data[:20] + [(0, 3, [5] * 12), (50, 1, [2] * 7), (51, 1, [3] * 7), (52, 2, [1] * 7), (-50, 2, [9] * 12)]
    frame = rows("vec_id long, label long, v array<int>", data).repartition(3)
    got = sorted(map(tuple, hn.hard_negatives(frame, every=10, shard_rows=shard_rows).collect()))
    assert got == plain_negatives(data, every=10) and len(got) > 100


def test_walk_stops_early_and_misses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (20, 16))
    x = (centres[rng.integers(20, size=4000)] + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    shard = hn.Shard(np.arange(4000), np.zeros(4000, np.int64), x)
    members = (centres[0] + rng.normal(0, 5, (10, 16))).astype(np.int64)
    ids = np.arange(-10, 0)
    seen = 0
    steps = shard.walk(members)
    scores = shard.scores
    shard.scores = lambda m, r: globals().update(_seen=globals().get("_seen", 0) + len(r)) or scores(m, r)
    best = hn.walk_positives(shard, ids, np.zeros(10, np.int64), members, 5)
    seen = globals().pop("_seen")
    full = members @ shard.x.T
    for m in range(10):
        assert best.score[best.unit == m].tolist() == np.sort(full[m])[::-1][:5].tolist()
    assert seen < 2000 and next(steps) is not None


def test_scores_are_exact_beyond_floats():
    big = np.array([[(1 << 26) - 1] * 8, [(1 << 26) - 3] * 8])
    shard = hn.Shard(np.arange(2), np.zeros(2, np.int64), big)
    assert shard.scores(big, np.arange(2)).tolist() == [[int(a) * int(b) * 8 for b in big[:, 0]] for a in big[:, 0]]


def test_negatives_of_rows_in_all_conditions(rows):
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(3)), rng.normal(0.3, 0.2, 8).round(3).tolist()) for i in range(0, 160, 2)]
    bad = [(50, 1, None), (None, 1, [1.0] * 8), (100, None, [1.0] * 8), (0, 1, [math.nan] * 8), (0, 1, [None] * 8), (50, 0, [])]
    schema = "vec_id long, label int, embedding array<double>, score int, shard int, twin int, w int, v int"
    frame = rows(schema, [(*r, 1, 2, 3, 4, 5) for r in data + data[:5] + bad])
    got = hn.mined(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    moved = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in v]) for i, y, v in data]
    assert sorted(map(tuple, got.collect())) == plain_negatives(moved)
    assert hn.mined(frame.limit(0)).count() == 0
    assert hn.mined(rows(schema, [(50, 1, [1.0], 1, 2, 3, 4, 5)])).count() == 0
