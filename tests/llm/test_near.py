from collections import defaultdict

import numpy as np

from ledgerloom.llm import near
from tests.llm.samples import SMALL, awkward, documents, empty, shingles


def brute(rows, threshold=75):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    holders, shared = defaultdict(list), defaultdict(int)
    for d, own in sets.items():
        for s in own:
            holders[s].append(d)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] += 1
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def compare(rows, out):
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_small_table(spark):
    compare([(d, t) for d, t, _ in documents()], near.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect())


def test_awkward(spark):
    frame, rows = awkward(spark)
    compare(rows, near.near_duplicates(frame).collect())
    assert near.near_duplicates(empty(spark)).collect() == []


def test_chains_and_crowds(spark):
    """A chain of neighbours, a crowd around one text, and texts that share half their words."""
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    base = list(rng.choice(vocabulary, 120))
    rows, text = [], list(base)
    for i in range(12):  # each differs from the one before in a few words, the ends have little in common
        text[8 * i : 8 * i + 3] = rng.choice(vocabulary, 3)
        rows.append((100 - i, " ".join(text)))
    for i in range(60):
        own = list(base)
        own[rng.integers(120)] = f"x{i}"
        rows.append((200 + i, " ".join(own)))
    half = list(rng.choice(vocabulary, 100))
    rows += [(400 + i, " ".join(half + list(rng.choice(vocabulary, 45)))) for i in range(60)]
    compare(rows, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_small_chunks(spark, monkeypatch):
    """Crowded buckets of many chunks: every chunk still meets every other one."""
    monkeypatch.setattr(near, "CHUNK", 8)
    monkeypatch.setattr(near, "OPEN_CHUNK", 16)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    half = list(rng.choice(words, 100))
    kinds = [half + list(rng.choice(words, 25)) for _ in range(8)]
    rows = []
    for i in range(120):
        own = list(kinds[i % 8])
        own[100 + rng.integers(25)] = f"x{i}"
        rows.append((i, " ".join(own)))
    compare(rows, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_tiles_cover_every_pair_once(monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 3)
    one, two = np.arange(8), np.arange(8, 19)
    seen = [(a, b) for x, y in near.tiles(one, two, False) for a in x for b in y]
    assert len(seen) == len(set(seen)) == 8 * 11
    own = [(a, b) for x, y in near.tiles(one, one, True) for a in x for b in y if a < b]
    assert len(own) == len(set(own)) == 8 * 7 // 2


def test_picked_keeps_every_row_asked_for(spark):
    rows = spark.range(5000).selectExpr("id AS doc", "cast(id AS string) AS text")
    ids = spark.range(0, 5000, 7).selectExpr("id AS n")
    got = {r.doc for r in near.picked(rows, "doc", ids, "n").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 1500
    assert near.picked(rows, "doc", ids.where("false"), "n").collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b, c = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 200, 60))
    one, two = np.concatenate([a, b]), np.concatenate([a, c])
    own = near.sketches(np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)]), 2)
    both = near.sketches(np.concatenate([a, b, c]), np.zeros(560, np.int64), 1)
    assert (near.merge(own[0], own[1]) == both[0]).all()
    estimate = near.similarity(own[:1], own[1:], np.array([500.0]), np.array([360.0]))[0]
    assert abs(estimate - 300 / 560) < 0.12
