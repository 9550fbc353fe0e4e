"""The grid join of fingerprints must not be sent to the driver, however small Spark takes the exploded cells to be."""

import random

from seqwarden.llm import near_copies, simhash
from seqwarden.session import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_never_broadcast(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(500)]
    fps += [f ^ 1 << rng.randrange(60) ^ 1 << 61 for f in fps[:50]]
    stored = materialize(spark.createDataFrame([(f,) for f in fps], "fp long").distinct())
    pairs = simhash.close_pairs(stored)
    assert "SortMergeJoin" in _plan(pairs) and "Broadcast" not in _plan(pairs)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if a != b and (a ^ b).bit_count() <= 2}
    assert {tuple(r) for r in pairs.collect()} == want and len(want) >= 50


def test_the_pipelines_fingerprints_neither(spark):
    rows = spark.createDataFrame([(i, i, i * 10**15, 5) for i in range(200)], "doc_id long, key long, fp long, n long")
    near = near_copies._close_fingerprints(materialize(rows))
    assert "SortMergeJoin" in _plan(near)


def test_rows_that_are_kept_are_not_broadcast(spark):
    docs = materialize(spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string"))
    for kept, n in ((simhash.drop_near_duplicates(docs), 50), (near_copies.drop_similar(docs), 50)):
        assert "SortMergeJoin" in _plan(kept) and kept.count() == n
