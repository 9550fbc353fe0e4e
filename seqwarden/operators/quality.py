"""Data-quality checks as aggregations; each returns rows ``(check, passed, n_bad, detail)``.

Row-order checks compare neighbours inside bounded blocks of rows and then the ends of
adjacent blocks, so no window ever spans the whole table or a whole session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.functions.text import contains_any
from seqwarden.operators.prepare import NoiseSpec, SplitSpec

BLOCK_ROWS = 1_000_000
SKIP_NESTED = ("userAgent", "resources")
RESULT = ("check", "passed", "n_bad", "detail")

Check = Callable[[DataFrame], DataFrame]


class ChecksFailed(Exception):
    """At least one check did not pass."""


@dataclass(frozen=True)
class Columns:
    """Names the checks look at; ``ordinal`` is a row number that gives the row order."""

    time: str = "eventTime"
    ordinal: str = "ordinal"
    session: str = "session_id"
    seq: str = "seq"
    user_agent: str = "userAgent"
    invoked_by: str = "userIdentity_invokedBy"
    skip_nested: Sequence[str] = field(default=SKIP_NESTED)


def _result(df: DataFrame, check: str, n_bad: Column, detail: Column) -> DataFrame:
    n_bad = F.coalesce(n_bad, F.lit(0)).cast("long")
    return df.select(
        F.lit(check).alias("check"),
        (n_bad == 0).alias("passed"),
        n_bad.alias("n_bad"),
        F.when(n_bad > 0, detail).otherwise(F.lit("")).alias("detail"),
    )


def _side_by_side(*parts: DataFrame) -> DataFrame:
    """One-row tables as one row."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _missing(df: DataFrame, check: str, columns: Sequence[str]) -> DataFrame | None:
    absent = sorted(set(columns) - set(df.columns))
    if not absent:
        return None
    one = df.sparkSession.range(1)
    return _result(one, check, F.lit(len(absent)), F.lit(f"missing columns: {absent}"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def looks_nested(value: Column) -> Column:
    text = F.regexp_replace(value, r"^[\s\x1c-\x1f\x85\xa0\u2000-\u200a\u2028\u2029\u3000]+", "")
    listed = text.startswith("[") & ~text.startswith("[MOCK")
    return F.coalesce(text.startswith("{") | listed, F.lit(False))


def column_profile(df: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Per text column: nested-looking cells with the first as a sample, and nulls. One pass over the data."""
    names = text_columns(df)
    cells = []
    for name in names:
        c = F.col(name)
        nested = looks_nested(c) if name not in cols.skip_nested else F.lit(False)
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count_if(nested).alias("n_nested"),
                F.min_by(F.substring(F.trim(c), 1, 80), F.when(nested, F.col(cols.ordinal))).alias("sample"),
                F.count_if(c.isNull()).alias("n_null"),
            ).alias(f"_{name}")
        )
    wide = df.agg(*cells)
    return wide.select(F.posexplode(F.array(*[F.col(f"`_{n}`") for n in names])).alias("_i", "_c")).select(
        F.col("_i").alias("position"), "_c.*"
    )


def _listed(profile: DataFrame, bad: Column, text: Column, limit: int) -> DataFrame:
    """One row: number of bad columns and their first texts in column order. Its input has one row per column."""
    items = F.array_sort(F.collect_list(F.when(bad, F.struct("position", text.alias("t")))))
    return profile.agg(
        F.count_if(bad).alias("n"), F.transform(F.slice(items, 1, limit), lambda e: e["t"]).alias("texts")
    )


def check_structure(profile: DataFrame) -> DataFrame:
    text = F.concat("column", F.lit(" (e.g. '"), "sample", F.lit("')"))
    found = _listed(profile, F.col("n_nested") > 0, text, 5)
    detail = F.concat(
        F.col("n").cast("string"), F.lit(" column(s) contain nested-looking values: "), F.array_join("texts", "; ")
    )
    return _result(found, "tabular structure", F.col("n"), detail)


def check_nulls(profile: DataFrame) -> DataFrame:
    text = F.concat("column", F.lit(" ("), F.col("n_null").cast("string"), F.lit(" NaN)"))
    found = _listed(profile, F.col("n_null") > 0, text, 10)
    return _result(found, "null handling", F.col("n"), F.concat(F.lit("columns with NaN: "), F.array_join("texts", ", ")))


def inversions(df: DataFrame, value: str, order: Sequence[str], block: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: neighbours whose ``value`` falls, and the order columns of the first such row.

    ``block`` names leading order columns that already cut the rows into bounded pieces,
    such as file and split. Without them the one order column is cut by value.
    """
    names = list(block)
    if not names:
        df = df.withColumn("_block", F.floor(F.col(order[0]) / block_rows))
        names = ["_block"]
    at = F.struct(*order)
    df = df.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(names)], F.col(value).alias("_v"), at.alias("_at"))
    blocks = [f"_b{i}" for i in range(len(names))]
    previous = F.lag("_v").over(Window.partitionBy(*blocks).orderBy("_at"))
    falls = F.coalesce(F.col("_v") < F.col("_prev"), F.lit(False))
    ends = (
        df.withColumn("_prev", previous)
        .groupBy(*blocks)
        .agg(
            F.count_if(falls).alias("n"),
            F.min(F.when(falls, F.col("_at"))).alias("first_bad"),
            F.min_by("_v", "_at").alias("first"),
            F.max_by("_v", "_at").alias("last"),
            F.min("_at").alias("start"),
        )
    )
    # one row per block from here on
    seam = F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy(*blocks)), F.lit(False))
    ends = ends.withColumn("_seam", seam)
    return ends.agg(
        F.coalesce(F.sum(F.col("n") + F.col("_seam").cast("int")), F.lit(0)).alias("n_inversions"),
        F.min(F.least("first_bad", F.when(F.col("_seam"), F.col("start")))).alias("first_bad"),
    )


def check_time_order(df: DataFrame, cols: Columns = Columns(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    missing = _missing(df, "temporal order", [cols.time])
    if missing is not None:
        return missing
    parsed = _parsed_time(df, cols.time)
    unread = parsed.agg(F.count_if(F.col("_t").isNull()).alias("n_unread"))
    found = inversions(parsed, "_t", [cols.ordinal], block_rows=block_rows)
    both = _side_by_side(unread, found)
    unread_text = F.concat(F.col("n_unread").cast("string"), F.lit(f" unparseable {cols.time} values"))
    first_text = F.concat(
        F.lit("first out-of-order row at index "), F.col(f"first_bad.{cols.ordinal}").cast("string")
    )
    n_bad = F.when(F.col("n_unread") > 0, F.col("n_unread")).otherwise(F.col("n_inversions"))
    return _result(both, "temporal order", n_bad, F.when(F.col("n_unread") > 0, unread_text).otherwise(first_text))


def check_text_order(df: DataFrame, text: str, order: Sequence[str], block: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The raw time text never falls from one row to the next; missing counts as empty."""
    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = inversions(filled, "_text", order, block, block_rows)
    detail = F.concat(F.lit("first out-of-order row at "), F.to_json("first_bad"))
    return _result(found, "raw time order", F.col("n_inversions"), detail)


def _parsed_time(df: DataFrame, time: str) -> DataFrame:
    if isinstance(df.schema[time].dataType, T.StringType):
        return df.withColumn("_t", F.try_to_timestamp(time))
    return df.withColumn("_t", F.col(time))


def _first_values(bad: DataFrame, column: str, ordinal: str, n: int = 5) -> DataFrame:
    """One row: the first ``n`` distinct values in row order."""
    firsts = bad.groupBy(column).agg(F.min(ordinal).alias("_o")).orderBy("_o").limit(n)
    texts = F.array_sort(F.collect_list(F.struct("_o", F.coalesce(F.col(column), F.lit("null")).alias("v"))))
    return firsts.agg(F.array_join(F.transform(texts, lambda e: e["v"]), ", ").alias("values"))


def value_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values; equal counts by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(n)


def _counts_text(bad: DataFrame, column: str, name: str) -> DataFrame:
    top = value_counts(bad, column)
    pair = F.struct((-F.col("count")).alias("c"), F.coalesce(F.col(column), F.lit("null")).alias("v"))
    texts = F.transform(F.array_sort(F.collect_list(pair)), lambda e: F.concat(e["v"], F.lit(": "), (-e["c"]).cast("string")))
    return top.agg(F.array_join(texts, ", ").alias(name))


def check_train_split(df: DataFrame, spec: SplitSpec = SplitSpec(), cols: Columns = Columns()) -> DataFrame:
    missing = _missing(df, "train split", [spec.type_column])
    if missing is not None:
        return missing
    bad = df.filter(~spec.is_train())
    both = _side_by_side(
        bad.agg(F.count(F.lit(1)).alias("n")), _first_values(bad, spec.type_column, cols.ordinal)
    )
    detail = F.concat(
        F.col("n").cast("string"), F.lit(f" non-{spec.train_type} rows; unique types: ["), "values", F.lit("]")
    )
    return _result(both, "train split", F.col("n"), detail)


def check_test_split(df: DataFrame, spec: SplitSpec = SplitSpec(), cols: Columns = Columns()) -> DataFrame:
    missing = _missing(df, "test split", [spec.name_column, spec.type_column])
    if missing is not None:
        return missing
    bad = df.filter(~spec.is_test())
    one = _side_by_side(
        bad.agg(F.count(F.lit(1)).alias("n")),
        _counts_text(bad, spec.type_column, "types"),
        _counts_text(bad, spec.name_column, "users"),
    )
    detail = F.concat(
        F.col("n").cast("string"), F.lit(" violating rows; types={"), "types", F.lit("}, users={"), "users", F.lit("}")
    )
    return _result(one, "test split", F.col("n"), detail)


def check_noise(df: DataFrame, spec: NoiseSpec = NoiseSpec()) -> DataFrame:
    """Rows that still match a noise pattern; here an absent column is a failure."""
    counts, texts, n = [], [], F.lit(0)
    for column, patterns in spec.rules:
        if column not in df.columns:
            n = n + 1
            texts.append(F.lit(f"{column} column missing"))
            continue
        for i, pattern in enumerate(patterns):
            name = f"_{column}_{i}"
            counts.append(F.count_if(contains_any(column, [pattern], spec.literal)).alias(name))
            n = n + F.col(name)
            text = F.concat(F.col(name).cast("string"), F.lit(f" rows contain '{pattern}' in {column}"))
            texts.append(F.when(F.col(name) > 0, text))
    found = df.agg(*counts) if counts else df.sparkSession.range(1)
    return _result(found, "noise filter", n, F.concat_ws("; ", *texts))


def broken_sessions(df: DataFrame, cols: Columns = Columns(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per session: does ``seq`` run 0..n-1 in row order, and does time never fall."""
    rows = _parsed_time(df, cols.time).select(
        F.col(cols.session).alias("session"), F.col(cols.seq).alias("_s"), "_t", F.col(cols.ordinal).alias("_o")
    ).withColumn("_block", F.floor(F.col("_o") / block_rows))
    near = Window.partitionBy("session", "_block").orderBy("_o")
    rows = rows.withColumn("_ps", F.lag("_s").over(near)).withColumn("_pt", F.lag("_t").over(near))
    ends = rows.groupBy("session", "_block").agg(
        F.count_if(F.col("_s") != F.col("_ps") + 1).alias("bad_s"),
        F.count_if(F.col("_t") < F.col("_pt")).alias("bad_t"),
        *[agg(c, "_o").alias(n) for c, n, agg in (
            ("_s", "first_s", F.min_by), ("_t", "first_t", F.min_by), ("_s", "last_s", F.max_by), ("_t", "last_t", F.max_by))],
        F.min("_o").alias("start"),
        F.count_if(F.col("_t").isNull()).alias("unread"),
    )
    blocks = Window.partitionBy("session").orderBy("_block")  # one row per session and block
    expected = F.coalesce(F.lag("last_s").over(blocks) + 1, F.lit(0))
    ends = ends.withColumn("seam_s", F.coalesce(F.col("first_s") != expected, F.lit(True))).withColumn(
        "seam_t", F.coalesce(F.col("first_t") < F.lag("last_t").over(blocks), F.lit(False))
    )
    return ends.groupBy("session").agg(
        F.max((F.col("bad_s") > 0) | F.col("seam_s")).alias("bad_seq"),
        F.max((F.col("bad_t") > 0) | F.col("seam_t")).alias("bad_time"),
        F.min("start").alias("start"),
        F.sum("unread").alias("n_unread"),
    )


def check_sessions(df: DataFrame, cols: Columns = Columns(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    missing = _missing(df, "session integrity", [cols.session, cols.seq, cols.time])
    if missing is not None:
        return missing
    per_session = broken_sessions(df, cols, block_rows)
    totals = per_session.agg(
        F.count_if("bad_seq").alias("n_seq"), F.count_if("bad_time").alias("n_time"),
        F.coalesce(F.sum("n_unread"), F.lit(0)).alias("n_unread"),
    )
    parts = [totals]
    for flag, name in (("bad_seq", "seqs"), ("bad_time", "times")):
        first = per_session.filter(flag).orderBy("start").limit(3)
        listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "session"))), lambda e: e["session"].cast("string"))
        parts.append(first.agg(F.array_join(listed, ", ").alias(name)))
    totals = _side_by_side(*parts)
    issues = F.concat_ws(
        "; ",
        F.when(F.col("n_seq") > 0, F.concat(F.col("n_seq").cast("string"), F.lit(" session(s) with non-sequential positions (e.g. ["), "seqs", F.lit("])"))),
        F.when(F.col("n_time") > 0, F.concat(F.col("n_time").cast("string"), F.lit(" session(s) not sorted by time (e.g. ["), "times", F.lit("])"))),
    )
    unread = F.col("n_unread") > 0
    n_bad = F.when(unread, F.col("n_unread")).otherwise(F.col("n_seq") + F.col("n_time"))
    return _result(totals, "session integrity", n_bad, F.when(unread, F.lit(f"unparseable {cols.time} values")).otherwise(issues))


def shared_checks(cols: Columns = Columns(), noise: NoiseSpec = NoiseSpec(), block_rows: int = BLOCK_ROWS) -> list[Check]:
    return [
        lambda df: check_structure(column_profile(df, cols)),
        lambda df: check_time_order(df, cols, block_rows),
        lambda df: check_nulls(column_profile(df, cols)),
        lambda df: check_noise(df, noise),
        lambda df: check_sessions(df, cols, block_rows),
    ]


def run_checks(df: DataFrame, checks: Sequence[Check], split: str) -> DataFrame:
    """Results of a list of functions from the table to result rows."""
    results = [check(df) for check in checks]
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(split).alias("split"), *RESULT)


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed")
    )


def require_passed(results: DataFrame) -> None:
    """Raise with the details of the failed checks; there is one row per check."""
    failed = results.filter(~F.col("passed")).collect()
    if failed:
        raise ChecksFailed("; ".join(f"[{r.split}] {r.check}: {r.detail}" for r in failed))
