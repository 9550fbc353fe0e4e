"""Two-level softmax on hashed features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwarden.operators import softmax

SCHEMA = "ctx array<long>, target long, n long"


def counted(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def chain(spark):
    # the next key follows from the last one; one key holds a third of all rows
    rows = [([a, b], (b * 7 + 1) % 40, 3) for a in range(40) for b in range(40)] + [([a, 5], 36, 60) for a in range(40)]
    return counted(spark, rows).groupBy("ctx", "target").agg(F.sum("n").alias("n"))


def test_probabilities_add_up_and_rank(spark, chain):
    model = softmax.fit(chain, buckets=1 << 10, rounds=2)
    assert model.n_keys == 40 and model.side == 7
    keys = spark.range(40).select(F.array(F.lit(3).cast("long"), F.lit(4).cast("long")).alias("ctx"), F.col("id").alias("key"))
    rows = softmax.rank_pairs(keys, model).collect()
    assert abs(sum(np.exp(r.log_p) for r in rows) - 1) < 1e-4
    assert sorted(r["rank"] for r in rows) == list(range(40))
    assert min(rows, key=lambda r: r["rank"]).key == 29 and max(rows, key=lambda r: r.log_p).key == 29


def test_learns_in_one_task_and_in_many(chain):
    for per_task in (10_000, 300):
        losses = softmax.log_losses(chain, softmax.fit(chain, pairs_per_task=per_task)).first()
        assert losses.n_rows == 40 * 40 * 3 + 40 * 60 and losses.model_loss < 0.6 * losses.frequency_loss


def test_flags(spark, chain):
    model = softmax.fit(chain)
    samples = spark.createDataFrame([(1, [0, 4], 29), (2, [9, 4], 29), (3, [0, 4], 30), (4, [0, 4], 777), (5, [7, 8], 17), (5, [7, 8], 17), (6, [4], 29)], "id long, ctx array<long>, key long")
    got = sorted((r.id, r.flag) for r in softmax.detect(samples, model, "key", 1, rows_per_task=2).collect())
    assert got[:6] == [(1, False), (2, False), (3, True), (4, True), (5, False), (5, False)] and len(got) == 7
    assert softmax.detect(samples.filter("id > 99"), model, "key", 1).collect() == []


def test_nothing_to_learn(spark):
    model = softmax.fit(counted(spark, []))
    samples = spark.createDataFrame([(1, [0, 4], 29)], "id long, ctx array<long>, key long")
    assert model.n_keys == 0 and softmax.detect(samples, model, "key", 3).first().flag


def test_large_vocabulary(spark):
    counts = spark.range(50_000).select(F.array(F.col("id") % 200, F.floor(F.col("id") / 200)).alias("ctx"), F.col("id").alias("target"), F.lit(1).cast("long").alias("n"))
    model = softmax.fit(counts, buckets=1 << 12, rounds=1, epochs=1)
    assert model.side == 224 and model.upper.nbytes + model.lower.nbytes == 8 * (1 << 12) * 224
    ranks = [r["rank"] for r in softmax.rank_pairs(counts.filter("target < 300").withColumnRenamed("target", "key"), model).collect()]
    assert len(ranks) == 300 and np.mean(ranks) < 20_000
