"""Rows must not be lost, doubled or wrongly expected."""

import pytest
from pyspark.sql import functions as F

from seqwarden.operators import model, quality
from seqwarden.operators import templates as tm
from seqwarden.plans import flow


@pytest.mark.filterwarnings("ignore:k=9 covers")
def test_unknown_keys_are_flagged_whatever_k(spark):
    rows = [("s", i, k) for i, k in enumerate([0, 1, 0, 1, -1, 0, 7, None])]
    df = spark.createDataFrame(rows, "session string, seq int, key int")
    ctx = spark.createDataFrame([([0], 1, 5), ([1], 0, 5), ([1], -1, 9)], "ctx array<int>, target int, n long")
    for k, n in ((2, 3), (9, 2)):
        got = model.detect(df, ctx, ["session"], "seq", "key", 1, k=k, num_keys=n, all_rows=True)
        flags = {r.seq: r.flag for r in got.collect()}
        assert {s for s, f in flags.items() if f} >= {4, 6, 7} and not any(flags[s] for s in (0, 1, 2, 3))


def test_order_of_mining_must_be_total(spark):
    for rows in ([(1, "a b"), (1, "a c")], [(None, "a b"), (1, "a c")], [(1, ""), (1, "")]):
        with pytest.raises(ValueError):
            tm.mine_templates(spark.createDataFrame(rows, "pos int, message string"), "message", ["pos"])


def test_nested_cells_after_any_white_space(spark):
    df = spark.createDataFrame([("\t{x",), ("\n [1",), (" [MOCK]",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(quality.looks_nested(F.col("v"))).collect()] == [True, True, False, False, False]


def test_mining_parameters_belong_to_the_model(spark):
    fitted = flow.Fitted(None, None, {"depth": 3, "threshold": 0.5, "max_children": 7})
    assert flow.mining_spec(fitted, None) == tm.MiningSpec(3, 0.5, 7)
    with pytest.raises(ValueError):
        flow.mining_spec(fitted, tm.MiningSpec())


def test_reports_are_divided_not_closed(spark, tmp_path):
    from seqwarden.sources.tables import REPORT_RULE, save_reports

    rows = [("b", 0, False, "B1\n"), ("b", 1, True, "B2"), ("a", 0, True, "A")]
    save_reports(spark.createDataFrame(rows, "s string, page long, is_last_page boolean, report string"), str(tmp_path / "r"), ["s"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text == f"A{REPORT_RULE}B1\nB2\n"
