"""What template mining keeps on disk, and how it finds the rows of repeated messages and puts templates together."""

import pytest
from pyspark.sql import functions as F

from seqwarden import session
from seqwarden.operators import templates as tm
from seqwarden.session import materialize


def _rows(spark, n=400):
    texts = [f"user {i % 7} opened file {i % 90} at {'night' if i % 3 else 'noon'} {'x' * 200}" for i in range(n)]
    texts += [f"alone {'abcdefghij'[i]}{i} {'y' * 200} unlike {i * 31}" for i in range(10)] + ["", "same line"] * 5
    return texts, spark.createDataFrame(list(enumerate(texts)), "i long, text string")


def test_tables_that_nothing_reads_any_more_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_dir", lambda spark: str(tmp_path))
    texts, df = _rows(spark)
    mined = tm.mine_templates(df, "text", ["i"], masked=False)
    kept = {f.name.rsplit("-", 5)[0] for f in tmp_path.iterdir()}
    assert "lookup" in kept and not kept & {"work", "messages", "again", "routes", "routed", "prefixes", "assigned"}
    assert mined.keys.count() == len(texts) and mined.templates.agg(F.sum("size")).first()[0] == len(texts)


def test_one_row_for_each_template_moves_instead_of_one_for_each_token(spark):
    _, df = _rows(spark)
    plan = tm.mine_templates(df, "text", ["i"], masked=False).templates._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.8])
def test_templates_hold_what_their_messages_share(spark, threshold):
    texts, df = _rows(spark)
    mined = tm.mine_templates(df, "text", ["i"], tm.MiningSpec(threshold=threshold), masked=False)
    of = {r["i"]: r["key"] for r in mined.keys.collect()}
    members = {}
    for i, text in enumerate(texts):
        members.setdefault(of[i], []).append(text.split())
    want = {k: ([a if all(m[p] == a for m in ms) else "<*>" for p, a in enumerate(ms[0])], len(ms)) for k, ms in members.items()}
    got = {r["key"]: (r["tokens"], r["size"], r["template"]) for r in mined.templates.collect()}
    assert got == {k: (t, n, " ".join(t)) for k, (t, n) in want.items()}


def test_merging_does_not_depend_on_the_memory(spark, monkeypatch):
    rows = [(k, f"a {k} {i % (k + 1)} z", 5, f"r{k}") for i in range(60) for k in range(9)]
    df = materialize(spark.createDataFrame(rows, tm.TEMPLATE).repartition(3))
    want = {k: f"a {k} {'0' if k == 0 else '<*>'} z" for k in range(9)}
    assert {r["key"]: r["template"] for r in tm._merged_templates(df).collect()} == want

    import pyarrow as pa

    monkeypatch.setattr(tm, "HELD_CHARACTERS", 1)
    batch = lambda some: pa.RecordBatch.from_pylist([dict(zip(("key", "template", "size", "route"), r)) for r in some])
    first = [r for b in tm._common_tokens(False)(iter([batch(rows[:200]), batch(rows[200:])])) for r in b.to_pylist()]
    assert len(first) > 9
    first.sort(key=lambda r: r["key"])
    last = [r for b in tm._common_tokens(True)(iter([pa.RecordBatch.from_pylist(first)])) for r in b.to_pylist()]
    assert {r["key"]: r["template"] for r in last} == want and len(last) == 9


def test_rows_of_repeated_messages_with_equal_hashes_are_told_apart(spark, monkeypatch):
    work = materialize(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "_msg string, _pos long"))
    messages = materialize(spark.createDataFrame([("a", 2)], "_msg string, _n long"))
    want = [("a", 1), ("a", 3)]
    assert sorted(map(tuple, tm._repeated(work, messages, None).collect())) == want
    monkeypatch.setattr(tm.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert sorted(map(tuple, tm._repeated(work, messages, None).collect())) == want
