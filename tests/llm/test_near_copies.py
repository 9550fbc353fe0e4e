"""The near-duplicate stage of the pipeline against brute-force Jaccard on 5-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from seqwarden.llm import near_copies


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize(("block", "closest"), [(4096, 4), (16, 1)])
def test_stage_finds_all_near_copies(spark, monkeypatch, block, closest):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "CLOSEST", closest)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 90, 200]))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 22))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + common if base % 3 == 0 else copy)))
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    want = sorted({root(i) for i in range(len(rows))})
    assert 40 < len(want) < 200
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.choice([1, 3, 10, 31, 32, 33, 100, 500, 3000])
        base = [rng.getrandbits(64) for _ in range(n)]
        other = base[: max(1, n - rng.randrange(0, n // 4 + 1))] + [rng.getrandbits(64) for _ in range(rng.randrange(0, n // 4 + 1))]
        sets = [np.unique(np.array(x, np.uint64)).view(np.int64) for x in (base, other)]
        both = len(np.intersect1d(*sets))
        similar = both >= 0.8 * (len(sets[0]) + len(sets[1]) - both)
        i, j, more = near_copies.closest(np.array([len(x) for x in sets]), [near_copies.bitmap(x) for x in sets], np.array([0, 1]), None, 0.8, 1)
        assert not more and (not similar or {(0, 1), (1, 0)} == set(zip(i.tolist(), j.tolist())))


def test_one_shingle_in_many_unlike_texts(spark):
    """20,000 texts share a passage and nothing else: no pair of them is compared on whole texts, and none is lost or joined."""
    rng = random.Random(5)
    texts = [f"the very same five words {' '.join(f'u{rng.randrange(10**9)}' for _ in range(3))}" for _ in range(20_000)]
    texts += [t + " " for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_similar(df).select("doc_id").collect()) == list(range(20_000))


def test_a_large_group_of_near_copies_is_one(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        copy = list(words)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert [r["doc_id"] for r in near_copies.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_close_fingerprints_are_found_and_decided_before_lists(spark, monkeypatch):
    """SimHash with segment popcounts links the close copies without any list."""
    rng = random.Random(7)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(600)] for _ in range(3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(i + 10, " ".join([*w[:-1], "x"])) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_copies._sets(df, "doc_id", "text", near_copies.WORDS).filter("slot IS NULL").drop("slot").collect()
    of = {r["doc_id"]: r for r in sets}
    near = {frozenset((i, i + 10)) for i in range(3) if (of[i]["fp"] ^ of[i + 10]["fp"]).bit_count() <= 2}
    assert near
    found = near_copies._close_fingerprints(spark.createDataFrame(sets, "doc_id long, text_hash long, key long, fp long, n long")).collect()
    by_key = {r["key"]: r["doc_id"] for r in sets}
    assert {frozenset((by_key[r["a"]], by_key[r["b"]])) for r in found} == near
    monkeypatch.setattr(near_copies, "_shared", lambda found: found.sparkSession.createDataFrame([], "list long, key long, size long, h long, g long"))
    kept = {r["doc_id"] for r in near_copies.drop_similar(df).collect()}
    assert kept == {0, 1, 2, 10, 11, 12} - {max(p) for p in near}


def test_shared_shingles_are_those_of_two_sets():
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 60, (300, 2))
    of = {}
    for s, k in pairs.tolist():
        of.setdefault(s, set()).add(k)
    shingle, key, size, h, g = near_copies.shared_shingles(pairs)
    assert sorted(zip(shingle.tolist(), key.tolist())) == sorted((s, k) for s, ks in of.items() if len(ks) > 1 for k in ks)
    assert all(n == len(of[s]) for s, n in zip(shingle.tolist(), size.tolist()))
    assert all(len(x) == 0 for x in near_copies.shared_shingles(np.empty((0, 2), np.int64)))
