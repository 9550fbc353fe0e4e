"""Vectors that meet in rounds of tables: little is moved at once, and every round decides alike."""

import os
from pathlib import Path

import numpy as np

from seqwarden import session
from seqwarden.llm import vectors


def _random(spark, n, dims, kind="float"):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(n, dims)).astype(np.float32)
    base[n // 2 :: 7] = base[: len(base[n // 2 :: 7])] + rng.normal(size=(len(base[n // 2 :: 7]), dims)).astype(np.float32) * 0.15
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    return base.astype(np.float64), spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def _size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_no_step_stores_a_copy_of_the_vectors_for_each_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_dir", lambda spark: str(tmp_path))
    _, df = _random(spark, 3000, 64)
    written, write = [], session.materialize_at

    def measured(table, label="step"):
        out = write(table, label)
        written.append(_size(out[1]))
        return out

    monkeypatch.setattr(vectors, "materialize_at", measured)
    monkeypatch.setattr(session, "materialize_at", measured)
    vectors.linked_vectors(df)
    assert max(written) < 2 * 3000 * 64 * 4


def test_rounds_of_tables_find_what_one_round_finds(spark, monkeypatch):
    e, df = _random(spark, 600, 24)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    links = (e @ e.T >= 0.9).sum(axis=1) - 1
    one = vectors.linked_vectors(df).orderBy("vec_id").collect()
    monkeypatch.setattr(vectors, "ROUND_BYTES", 1)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    several = vectors.linked_vectors(df).orderBy("vec_id").collect()
    assert one == several
    assert links.sum() > 50 and sum(r["n_links"] for r in one) >= 0.97 * links.sum()
    assert all(r["n_links"] <= links[r["vec_id"]] for r in one)


def test_buckets_do_not_depend_on_the_rows_beside():
    rng = np.random.default_rng(12)
    for dims in (1, 3, 64, 300):
        v = rng.normal(size=(500, dims))
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        whole = vectors.buckets(v, 7, 9, 7, 0, 9)
        for at in range(0, 500, 37):
            assert (vectors.buckets(v[at : at + 37], 7, 9, 7, 3, 5) == whole[at : at + 37, 3:5]).all()


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = spark.conf.get(session.CLEANUP_CONF, None)
    local = spark.conf.get("spark.local.dir", None) or "/tmp"
    mine = lambda: {str(f) for d in Path(local).glob("blockmgr-*") if os.access(d, os.R_OK) for f in d.rglob("shuffle_*.data")}
    seen = mine()
    spark.range(10_000).repartition(5, "id").write.format("noop").mode("overwrite").save()
    assert mine() - seen, "the files are looked for in the wrong place"
    seen = mine()
    session.materialize(spark.range(10_000).repartition(5, "id"))
    assert not mine() - seen
    assert spark.conf.get(session.CLEANUP_CONF, None) == before
