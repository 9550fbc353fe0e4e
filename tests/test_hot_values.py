"""Joins in which one value holds nine tenths of the rows: the same result, and no task with more than its share."""

import random

import pytest
from pyspark.sql import functions as F

from seqwarden.operators import model
from seqwarden.operators.templates import MiningSpec, apply_templates, mine_templates
from seqwarden.plans import skew
from seqwarden.plans.skew import hot_values, join_hot, with_salt

SHARE = 100


def rows_of(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, None if i % 100 == 7 else "hot" if rng.random() < 0.9 else f"v{rng.randrange(40)}") for i in range(n)]
    return spark.createDataFrame(rows, "i long, k string").repartition(5)


def counts(df):
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_the_plain_one(spark, how):
    big = rows_of(spark)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("v1", 3), ("v2", 4), ("none", 5), (None, 6)], "k string, x int")
    hot = hot_values(counts(big), ["k"], rows_per_task=SHARE)
    got = sorted(map(str, join_hot(big, small, ["k"], hot, how).collect()))
    assert got == sorted(map(str, join_hot(big, small, ["k"], None, how).collect())) and len(got) > 4000
    with pytest.raises(ValueError):
        join_hot(big, small, ["k"], hot, "full")


def test_largest_task_is_bounded(spark):
    big = rows_of(spark)
    hot = hot_values(counts(big), ["k"], rows_per_task=SHARE)
    assert {r["k"] for r in hot.collect()} == {"hot"}
    sizes = [r["count"] for r in with_salt(big, ["k"], hot).groupBy("k", "_salt").count().collect()]
    assert max(sizes) < 1.7 * SHARE and sum(sizes) == 3000
    assert hot_values(counts(big), ["k"], rows_per_task=10_000) is None
    assert hot_values(counts(big.filter("i < 0")), ["k"]) is None


def test_mining_and_frozen_keys_with_a_hot_message(spark):
    rng = random.Random(2)
    texts = ["a b c d" if rng.random() < 0.9 else " ".join(rng.choice("abcde") for _ in range(4)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(4)
    spec = MiningSpec(depth=2, threshold=0.6)
    plain, spread = (mine_templates(df, "text", ["pos"], spec, rows_per_task=n) for n in (10**6, 50))
    assert sorted(map(tuple, plain.keys.collect())) == sorted(map(tuple, spread.keys.collect()))
    frozen = [apply_templates(df, "text", plain.templates, spec, rows_per_task=n) for n in (10**6, 50)]
    assert sorted(map(tuple, frozen[0].collect())) == sorted(map(tuple, frozen[1].collect()))


@pytest.mark.parametrize("backoff", [False, True])
def test_flags_with_a_hot_context(spark, backoff):
    rng = random.Random(3)
    rows = [(s, i, 0 if rng.random() < 0.95 else rng.randrange(4)) for s in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "session int, seq long, key int")
    samples = model.context_windows(df, ["session"], "seq", "key", 2)
    learned = model.count_model(samples.filter("session = 0"), "key")
    learned = model.with_suffixes(learned) if backoff else learned
    plain, spread = (model.detect(df, learned, ["session"], "seq", "key", 2, 1, backoff, rows_per_task=n) for n in (10**6, 40))
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect())) and plain.filter("flag").count() > 3


def test_first_order_flags_by_join(spark):
    counts = spark.createDataFrame([([1, 2], 5, 9), ([7, 2], 6, 8), ([7, 2], 4, 3), ([9, 3], 5_000_000, 1)], "ctx array<long>, target long, n long")
    rows = [(i, [8, 2], 5) for i in range(50)] + [(60, [1, 2], 6), (61, [1, 2], 4), (62, [2, 3], 5_000_000), (63, [2, 99], 5)]
    samples = spark.createDataFrame(rows, "id long, ctx array<long>, key long")
    flags = {r.id: r.flag for r in model.detect_first_order(samples, counts, "key", 2, rows_per_task=10).collect()}
    assert len(flags) == 54 and {i for i, f in flags.items() if f} == {61, 63}


def test_pieces_of_an_ordered_table_do_not_grow_with_small_tasks(spark, monkeypatch):
    """The driver hears of every piece, so a small ``rows_per_task`` must not make one for every few rows of a large table."""
    assert skew.ordered_pieces(1000, 300) == 7
    assert skew.ordered_pieces(36_000_000, 300) == skew.ordered_pieces(360_000_000, 300) == skew.SMALL_PIECES
    assert skew.ordered_pieces(10**11, 300) == skew.ordered_pieces(10**11, skew.ROWS_PER_TASK)
    monkeypatch.setattr(skew, "SMALL_PIECES", 5)
    df = spark.createDataFrame([((i * 7) % 1000 // 2, i) for i in range(1000)], "t long, i long")
    got = skew.positions_overall(df, ["t", "i"], rows_per_task=2).orderBy("pos").collect()
    assert [(r["t"], r["i"]) for r in got] == sorted((r["t"], r["i"]) for r in got) and [r["pos"] for r in got] == list(range(1000))
    one = df.withColumn("k", F.lit("a"))
    got = skew.positions_within(one, ["k"], ["t", "i"], profile=skew.profile_keys(one, ["k"], 2)).orderBy("pos").collect()
    assert [(r["t"], r["i"]) for r in got] == sorted((r["t"], r["i"]) for r in got) and [r["pos"] for r in got] == list(range(1000))
