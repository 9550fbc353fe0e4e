"""Field access and text forms of semi-structured values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.fixed_values import NULL_TEXT
from seqwarden.functions.text import ColumnOrName, as_col


def json_path(path: Sequence[str]) -> str:
    quoted = (p.replace("\\", "\\\\").replace('"', '\\"') for p in path)
    return "$" + "".join(f'["{p}"]' for p in quoted)


def field(raw: ColumnOrName, path: Sequence[str], default: str | None = None, kind: str = "string") -> Column:
    """Value at ``path``; a missing key, an explicit null or a non-object parent give the default."""
    value = F.try_variant_get(as_col(raw), json_path(path), kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def has_explicit_null(raw: ColumnOrName, path: Sequence[str]) -> Column:
    """True where the key is present with a JSON null, which the other functions treat as missing."""
    return F.is_variant_null(F.try_variant_get(as_col(raw), json_path(path), "variant"))


def scalar_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a scalar; booleans read True and False."""
    text = value.cast("string")
    if isinstance(dtype, T.BooleanType):
        return F.initcap(text)
    if isinstance(dtype, T.VariantType):
        return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)
    return text


def list_text(value: Column, element: T.DataType) -> Column:
    """Elements joined by a comma: one element is its own text, none is the empty text."""
    text = F.transform(value, lambda x: F.coalesce(scalar_text(x, element), F.lit(NULL_TEXT)))
    return F.array_join(text, ",")
