"""Nested events to flat columns: schema profile, pruning, alignment, list cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.fixed_values import FILL_THRESHOLD, KEEP_LIST_COLUMNS, REQUIRED_COLUMNS
from seqwarden.functions.variant import json_path, list_text, scalar_text


def column_name(dotted: str) -> str:
    """Dots need quoting in Spark, so nested names use underscores."""
    return dotted.replace(".", "_")


def prefix_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of the input order."""
    return df.orderBy(*order).limit(n)


def event_schema(events: DataFrame, raw: str = "raw") -> T.StructType:
    """Merged schema of all events, found by one map-side combined aggregation."""
    text = events.agg(F.schema_of_variant_agg(raw).alias("s")).first().s
    if not text.startswith("OBJECT"):
        return T.StructType()
    return T.DataType.fromDDL(text.replace("OBJECT<", "STRUCT<"))


def leaf_paths(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths that become columns: nested objects to any depth, lists as they are, empty objects not at all."""
    leaves: list[tuple[tuple[str, ...], T.DataType]] = []
    for f in schema.fields:
        path = (*prefix, f.name)
        leaves += leaf_paths(f.dataType, path) if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return leaves


def _cell_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.ArrayType):
        return "array<variant>" if _mixed(dtype.elementType) else dtype.simpleString()
    # a column of nulls only has no kind of its own
    return "string" if isinstance(dtype, T.NullType) else dtype.simpleString()


def _mixed(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NullType, T.VariantType, T.StructType, T.ArrayType))


def name_map(schema: T.StructType) -> dict[str, str]:
    """Column name -> dotted source name."""
    names: dict[str, str] = {}
    for path, _ in leaf_paths(schema):
        dotted = ".".join(path)
        name = column_name(dotted)
        if name in names:
            raise ValueError(f"{dotted!r} and {names[name]!r} both become column {name!r}")
        names[name] = dotted
    return names


def flatten(events: DataFrame, schema: T.StructType, raw: str = "raw") -> DataFrame:
    """One column per leaf of ``schema``; the other columns of ``events`` stay."""
    name_map(schema)
    cells = []
    for path, dtype in leaf_paths(schema):
        cell = F.try_variant_get(raw, json_path(path), _cell_type(dtype))
        # values of mixed kinds become text, so that they can be grouped and compared
        cell = scalar_text(cell, dtype) if isinstance(dtype, T.VariantType) else cell
        cells.append(cell.alias(column_name(".".join(path))))
    return events.select(*[c for c in events.columns if c != raw], *cells)


def fill_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of non-null cells: one row per column, from one aggregation over the data."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "fill_rate")


def kept_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = FILL_THRESHOLD,
    required: Sequence[str] = REQUIRED_COLUMNS,
) -> list[str]:
    """Columns filled often enough, or required; in their order. Reads one row per column."""
    columns = list(columns or df.columns)
    must = {column_name(r) for r in required}
    rates = {r.column: r.fill_rate or 0.0 for r in fill_rates(df, columns).collect()}
    return [c for c in columns if rates[c] >= threshold or c in must]


def align(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of ``schema`` (name -> type): unknown ones dropped, missing ones null."""
    have = set(df.columns)
    return df.select(
        *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in schema.items()]
    )


def with_required(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Add required columns the data never had, as null texts."""
    missing = [column_name(r) for r in required if column_name(r) not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing})


def _cell_text(name: str, dtype: T.DataType, lists: bool) -> Column:
    if isinstance(dtype, T.ArrayType) and lists:
        return list_text(F.col(name), dtype.elementType)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(name)
    return scalar_text(F.col(name), dtype)


def unnest_lists(df: DataFrame, keep: Sequence[str] = KEEP_LIST_COLUMNS) -> DataFrame:
    """List cells to text, except in the columns to keep."""
    return df.select(
        *[
            _cell_text(f.name, f.dataType, True).alias(f.name)
            if isinstance(f.dataType, T.ArrayType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
