"""Tables in buckets of session and block: same rows as the plain join, no shuffle, sessions of any length."""

import uuid

import pytest
from pyspark.sql import functions as F

from seqwarden.sources import position_tables as pt

LAYOUT = pt.Layout(("s",), "seq", buckets=4, block_rows=10)
BLOCKS = pt.Layout(("s",), "seq", buckets=4, block_rows=10, whole_blocks=True)


def stored(df, tmp_path, layout=LAYOUT):
    name = f"t_{uuid.uuid4().hex}"
    return pt.save(df, name, str(tmp_path / name), layout)


@pytest.fixture
def rows(spark):
    # one session holds most rows
    return spark.range(500).select(F.when(F.col("id") < 450, 0).otherwise(F.col("id") % 7).alias("s"), F.col("id").alias("seq"), (F.col("id") % 5).alias("key"))


def test_join_needs_no_shuffle(spark, rows, tmp_path):
    left, right = stored(rows, tmp_path), stored(rows.filter("seq % 3 > 0").select("s", "seq", F.lit("x").alias("note")), tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pt.with_missing(pt.join(left, right, LAYOUT), ["note"], "N/A")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        grouped = pt.sequences(stored(rows, tmp_path, BLOCKS), "key", BLOCKS)
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        got = {(r.s, r.seq): (r.key, r.note) for r in out.collect()}
        keys = {(r.s, r.block): r["keys"] for r in grouped.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {(r.s, r.seq): (r.key, "x" if r.seq % 3 else "N/A") for r in rows.collect()}
    assert got == want
    assert max(map(len, keys.values())) <= 10 and keys[0, 3] == [i % 5 for i in range(30, 40)]


def test_long_session_is_spread(rows, spark, tmp_path):
    for layout in (LAYOUT, BLOCKS):
        sizes = [r["count"] for r in stored(rows, tmp_path, layout).groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 300


def test_edges(spark, rows, tmp_path):
    assert stored(rows.limit(0), tmp_path).collect() == []
    with pytest.raises(Exception, match="s is null"):
        stored(rows.withColumn("s", F.when(F.col("seq") > 3, F.col("s"))), tmp_path)
    with pytest.raises(ValueError, match="_block"):
        stored(rows.withColumn("_block", F.lit(1)), tmp_path)
    twice = stored(rows.union(rows), tmp_path)
    assert pt.join(twice, stored(rows.select("s", "seq"), tmp_path), LAYOUT, "inner").count() == 1000


def test_tables_of_another_session(spark, rows, tmp_path):
    pt.save(rows, f"w_{uuid.uuid4().hex}", str(tmp_path / "w"), LAYOUT)
    again = pt.register(spark, f"r_{uuid.uuid4().hex}", str(tmp_path / "w"), "s BIGINT, seq BIGINT, key BIGINT", LAYOUT)
    assert sorted(again.drop(pt.BLOCK).collect()) == sorted(rows.collect())
