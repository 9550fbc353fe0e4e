import random

import pytest
from pyspark.sql import functions as F

from seqwarden.operators import evaluate, model, sessions, windows
from seqwarden.plans.skew import positions_overall, positions_within, profile_keys

SEQUENCES = {
    0: [0, 1, 2, 3, 4] * 3,
    1: [1, 2, 3, 4, 0] * 3,
    2: [2, 3],
}


def keyed(spark, sequences):
    rows = [(s, i, k) for s, keys in sequences.items() for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "session int, seq long, key int").repartition(3)


def test_windows_of_the_fixture(spark):
    df = keyed(spark, SEQUENCES)
    out = windows.context_windows(df, ["session"], "seq", "key", 3)
    assert out.count() == 24
    assert windows.sample_count(df, ["session"], 3).first().n_samples == 24
    first = out.filter("session = 0 and seq = 3").first()
    assert (first.ctx, first.key) == ([0, 1, 2], 3)
    with pytest.raises(ValueError):
        windows.context_windows(df, ["session"], "seq", "key", 0)


def test_windows_do_not_cross_sessions(spark):
    df = keyed(spark, {0: [0, 1, 2, 3], 1: [10, 11, 12, 13]})
    got = {(tuple(r.ctx), r.key) for r in windows.context_windows(df, ["session"], "seq", "key", 3).collect()}
    assert got == {((0, 1, 2), 3), ((10, 11, 12), 13)}


@pytest.mark.parametrize("width,block", [(1, 1), (3, 3), (3, 5), (4, 7)])
def test_blocks_give_the_same_windows(spark, width, block):
    rng = random.Random(width * 10 + block)
    df = keyed(spark, {s: [rng.randrange(5) for _ in range(n)] for s, n in enumerate([40, 7, width, width + 1, 14, 21])})
    plain = windows.context_windows(df, ["session"], "seq", "key", width, profile_keys(df, ["session"]))
    cut = windows.context_windows(df, ["session"], "seq", "key", width, None, block)

    def rows(d):
        return sorted((r.session, r.seq, tuple(r.ctx), r.key) for r in d.collect())

    assert rows(plain) == rows(cut)
    assert plain.count() > 0


def skewed(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b", "c"]), rng.randrange(5), i) for i in range(400)]
    return spark.createDataFrame(rows, "k string, t int, o int").repartition(6)


def test_hot_keys_get_the_same_positions(spark):
    df = skewed(spark)
    plain = positions_within(df, ["k"], ["t", "o"])
    profile = profile_keys(df, ["k"], rows_per_task=60)
    assert (profile.n_rows, profile.n_keys, profile.skewed) == (400, 4, True)
    split = positions_within(df, ["k"], ["t", "o"], profile=profile)
    assert sorted(plain.collect(), key=str) == sorted(split.collect(), key=str)


def test_overall_positions_by_ranges(spark):
    df = skewed(spark)
    plain = positions_overall(df, ["t", "o"])
    ranged = positions_overall(df, ["t", "o"], rows_per_task=50)
    assert sorted(plain.collect(), key=str) == sorted(ranged.collect(), key=str)
    assert sorted(r.pos for r in ranged.collect()) == list(range(400))


def test_sessions(spark):
    df = skewed(spark)
    for limit in (10**6, 60):
        rows = sessions.assign_sessions(df, ["k"], ["t", "o"], rows_per_task=limit).orderBy("t", "o").collect()
        seen, want = {}, []
        counts = {}
        for r in rows:
            seen.setdefault(r.k, len(seen))
            counts[r.k] = counts.get(r.k, -1) + 1
            want.append((seen[r.k], counts[r.k]))
        assert [(r.session_id, r.seq) for r in rows] == want
    alone = sessions.assign_sessions(df, ["nothing"], ["t", "o"])
    assert [r.seq for r in alone.orderBy("t", "o").collect()] == list(range(400))
    assert alone.select("session_id").distinct().collect() == [(0,)]
    assert sessions.count_sessions(df, ["k"]).first() == (4, 400)
    assert sessions.count_sessions(df, ["k"], approximate=True).first().n_events == 400
    assert sessions.with_surrogate_id(df, ["k"]).select("session_key").distinct().count() == 4


def fitted(spark, width=3):
    train = keyed(spark, {s: [0, 1, 2, 3, 4] * 4 for s in range(3)})
    return model.count_model(windows.context_windows(train, ["session"], "seq", "key", width), "key")


def flags(spark, counts, keys, k, **kw):
    out = model.detect(keyed(spark, {0: keys}), counts, ["session"], "seq", "key", 3, k, **kw)
    return sorted(r.seq for r in out.filter("flag").collect())


def test_flags(spark):
    counts = fitted(spark)
    broken = [0, 1, 2, 3, 4, 0, 1, 2, 0, 1, 2, 3]
    assert 8 in flags(spark, counts, broken, 1)
    assert flags(spark, counts, broken[:8], 1) == []
    assert flags(spark, counts, [0, 1, 2], 1) == []
    # k as large as the vocabulary flags nothing
    with pytest.warns(UserWarning):
        assert flags(spark, counts, broken, 5, num_keys=5) == []
    # shorter contexts fill the places that the longest one leaves open
    assert flags(spark, model.with_suffixes(counts), broken, 5, backoff=True) == []
    assert 8 in flags(spark, model.with_suffixes(counts), broken, 1, backoff=True)
    assert 8 in flags(spark, model.with_suffixes(counts), [0, 1, 2, 3, 4, 0, 1, 2, 99], 5, backoff=True)
    df = keyed(spark, {0: broken})
    scored = model.detect(df, counts, ["session"], "seq", "key", 3, 1)
    every = model.with_all_rows(df, scored, ["session"], "seq").orderBy("seq").collect()
    assert len(every) == len(broken) and not any(r.flag for r in every[:3])
    counted = model.with_suffixes(counts)
    for backoff, table in ((False, counts), (True, counted)):
        part = model.detect(df, table, ["session"], "seq", "key", 3, 1, backoff)
        want = model.with_all_rows(df, part, ["session"], "seq").orderBy("seq").collect()
        same = model.detect(df, table, ["session"], "seq", "key", 3, 1, backoff, all_rows=True).orderBy("seq").collect()
        assert [r.flag for r in same] == [r.flag for r in want]
    with pytest.raises(ValueError):
        model.rank_next_keys(counts, 0)


def test_models_add_up(spark):
    counts = fitted(spark)
    twice = model.merge_models(counts, counts)
    assert {r.n for r in twice.collect()} == {2 * r.n for r in counts.collect()}
    assert model.prune(counts, 10**6).count() == 0
    with pytest.raises(ValueError):
        model.check_key_range(keyed(spark, SEQUENCES), "key", 4)
    model.check_key_range(keyed(spark, SEQUENCES), "key", 5)


@pytest.mark.parametrize(
    "predicted,truth,want",
    [
        ("TFTF", "TFTF", dict(precision=1, recall=1, f1=1, accuracy=1)),
        ("FFF", "TTT", dict(recall=0, fn=3, precision=0, f1=0)),
        ("TTT", "FFF", dict(precision=0, fp=3)),
        ("TTFFT", "TFTFT", dict(tp=2, fp=1, fn=1, tn=1, precision=2 / 3, recall=2 / 3, f1=2 / 3, accuracy=3 / 5)),
        ("", "", dict(precision=0, recall=0, f1=0, accuracy=0, tp=0)),
        ("F" * 100, "F" * 99 + "T", dict(accuracy=0.99, recall=0)),
    ],
)
def test_evaluation(spark, predicted, truth, want):
    rows = [(p == "T", t == "T") for p, t in zip(predicted, truth)]
    got = evaluate.evaluate(spark.createDataFrame(rows, "predicted boolean, truth boolean")).first().asDict()
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_alignment(spark):
    left = spark.createDataFrame([(0, True), (1, False)], "i int, predicted boolean")
    right = spark.createDataFrame([(0, True), (2, True)], "i int, truth boolean")
    assert evaluate.align(left, right, ["i"]).count() == 1
    assert evaluate.align(left, right, ["i"], strict=True).filter("unmatched").count() == 2


def test_same_result_for_any_partitioning(spark):
    df = skewed(spark).withColumn("key", F.col("t"))
    results = []
    for n in (1, 4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        seq = sessions.with_positions(df.repartition(n), ["k"], ["t", "o"])
        out = windows.context_windows(seq, ["k"], "seq", "key", 2)
        results.append(sorted((str(r.k), r.seq, tuple(r.ctx)) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
