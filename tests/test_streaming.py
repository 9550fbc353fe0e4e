"""Scoring on a stream against the batch run, and back-off against a plain statement of it."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqwarden.operators import model, windows
from seqwarden.session import materialize
from seqwarden.streaming import scoring

WIDTH = 3


def sequences(seed, sessions=6, most=40):
    rng = random.Random(seed)
    return {f"s{i}": [rng.choice([0, 1, 1, 2, 2, 2, 3]) for _ in range(rng.randint(1, most))] for i in range(sessions)}


def table(spark, found):
    rows = [(s, i, 1_700_000_000 + 10 * i, k) for s, keys in found.items() for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "session string, seq long, at long, key int")
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def counts_of(spark, found, suffixes):
    samples = windows.context_windows(table(spark, found), ["session"], "seq", "key", WIDTH)
    counts = model.count_model(samples, "key")
    return materialize(model.with_suffixes(counts) if suffixes else counts, "counts")


def plain_flags(train, test, width, k, support):
    """Back-off by its definition: the top keys of the longest known context, then of ever shorter ones."""
    seen = defaultdict(Counter)
    for keys in train.values():
        for i in range(width, len(keys)):
            for n in range(width + 1):
                seen[tuple(keys[i - n : i])][keys[i]] += 1
    seen = {c: {t: n for t, n in of.items() if n >= support} for c, of in seen.items()}
    flags = {}
    for s, keys in test.items():
        for i in range(width, len(keys)):
            expected = []
            for n in range(width, -1, -1):
                of = seen.get(tuple(keys[i - n : i]), {})
                expected += [t for t in sorted(of, key=lambda t: (-of[t], t))[:k] if t not in expected]
            flags[s, i] = keys[i] not in expected[:k]
    return flags


@pytest.mark.parametrize(("width", "k", "support"), [(1, 1, 1), (3, 1, 1), (3, 2, 2), (4, 1, 3), (6, 2, 1)])
def test_backoff_by_search_equals_its_definition(spark, width, k, support):
    train, test = sequences(1, 5, 30), sequences(2, 5, 30)
    samples = windows.context_windows(table(spark, train), ["session"], "seq", "key", width)
    counts = model.prune(model.with_suffixes(model.count_model(samples, "key")), support)
    rows = model.detect(table(spark, test), counts, ["session"], "seq", "key", width, k, True).collect()
    assert {(r["session"], r["seq"]): r["flag"] for r in rows} == plain_flags(train, test, width, k, support)


def test_an_empty_model_expects_nothing(spark):
    none = counts_of(spark, {}, True)
    rows = model.detect(table(spark, sequences(3)), none, ["session"], "seq", "key", WIDTH, 1, True).collect()
    assert rows and all(r["flag"] for r in rows)


@pytest.mark.parametrize("width", range(1, 14))
def test_every_length_is_searched_once(width):
    rounds = model.search_lengths(width)
    assert sorted(n for lengths in rounds for n in lengths) == list(range(1, width + 1))
    assert len(rounds) == width.bit_length()


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(scoring.STATE_STORE, scoring.ROCKSDB)
    yield
    spark.conf.unset(scoring.STATE_STORE)


def run_batches(spark, tmp_path, batches, make):
    """Each list of (session, seconds, tie, key) is one file and one batch of the stream."""
    schema = "session string, at long, tie long, key int"
    for i, rows in enumerate(batches):
        path = tmp_path / f"in{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        (tmp_path / "src").mkdir(exist_ok=True)
        part = next(path.glob("part-*"))
        (tmp_path / "src" / f"{i}.parquet").write_bytes(part.read_bytes())
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
        out = make(events.withColumn("ts", F.timestamp_seconds("at")))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("backoff", [False, True])
def test_stream_in_three_batches_equals_the_batch_run(spark, rocksdb, tmp_path, backoff):
    train, test = sequences(4), sequences(5, 4, 30)
    counts = counts_of(spark, train, backoff)
    rows = [(s, 1_700_000_000 + 10 * i, i, k) for s, keys in test.items() for i, k in enumerate(keys)]
    rows.sort(key=lambda r: r[1])
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    # some rows arrive in the wrong batch, but within the delay
    batches[0][-1], batches[1][3] = batches[1][3], batches[0][-1]
    for b in batches:
        random.Random(1).shuffle(b)
    end = [("end", 1_700_000_000 + 10_000, 0, 0)]  # moves the watermark past all other rows

    def flags(events):
        contexts = scoring.stream_contexts(events, ["session"], "ts", "tie", "key", WIDTH, "10 minutes")
        return scoring.stream_flags(contexts, counts, "key", WIDTH, 1, backoff)

    got = [r for r in run_batches(spark, tmp_path, [*batches, end, [("end", 1_700_000_000 + 10_100, 1, 0)]], flags) if r["session"] != "end"]
    want = model.detect(table(spark, test), counts, ["session"], "seq", "key", WIDTH, 1, backoff, all_rows=True).collect()
    assert {(r["session"], r["seq"]): (r["key"], r["flag"]) for r in got} == {(r["session"], r["seq"]): (r["key"], r["flag"]) for r in want}
    assert len(got) == len(rows) and any(r["flag"] for r in got)


def test_late_rows_and_expiry(spark, rocksdb, tmp_path):
    def contexts(events):
        return scoring.stream_contexts(events, ["session"], "ts", "tie", "key", 2, "10 seconds", idle_ms=100_000)

    batches = [
        [("a", 1000, 0, 1), ("a", 1005, 1, 2), ("b", 1000, 0, 7)],
        [("a", 1060, 2, 3)],
        [("a", 1001, 3, 9), ("a", 1062, 4, None)],  # the first is behind the watermark
        [("b", 1300, 1, 8)],  # long after b's last row
        [("c", 5000, 0, 0)],
        [("a", 5001, 5, 4), ("c", 9000, 1, 0)],
        [("c", 9100, 2, 0)],
    ]
    got = {(r["session"], r["tie"]): (r["seq"], r["key"], r["ctx"]) for r in run_batches(spark, tmp_path, batches, contexts)}
    assert {k: v for k, v in got.items() if k[0] != "c"} == {
        ("a", 0): (0, 1, []), ("a", 1): (1, 2, [1]), ("a", 2): (2, 3, [1, 2]), ("a", 4): (3, None, [2, 3]), ("a", 5): (0, 4, []),
        ("b", 0): (0, 7, []), ("b", 1): (0, 8, []),
    }


def test_needs_a_store_with_timers(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'s' AS session", "timestamp AS ts", "value AS tie", "1 AS key")
    with pytest.raises(RuntimeError):
        scoring.stream_contexts(stream, ["session"], "ts", "tie", "key", 2)
    with pytest.raises(ValueError):
        scoring.stream_contexts(stream, ["session"], "ts", "tie", "key", 0)
