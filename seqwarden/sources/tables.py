"""Tables and exports that later stages read: sessions, keys, templates, models, incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.fixed_values import RULE_LINE

REPORT_RULE = f"\n\n{RULE_LINE}\n\n"
MODEL_FIELDS = ("num_keys", "window_size", "vocab_fingerprint")
MODEL_DEFAULTS: dict[str, int] = {"top_k": 9, "min_support": 1, "epoch": 0}


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, partitioned by low-cardinality columns such as ``split``."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes inside values are doubled and empty texts stay apart from null."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def import_csv(spark: SparkSession, path: str, null_text: str = "", columns: Sequence[str] | None = None) -> DataFrame:
    """All columns as text. ``null_text`` is the one text read as null: ``None`` or the empty text."""
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", False)
        .option("nullValue", null_text)
        .option("inferSchema", False)
    )
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def fingerprint(templates: DataFrame) -> str:
    """Hash of the whole vocabulary, key by key: the same count with other texts differs.

    The sum of row hashes does not depend on row order, so no sort and no collect is needed.
    """
    row_hash = F.xxhash64("key", "template").cast("decimal(38,0)")
    row = templates.agg(F.sum(row_hash).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{row.n}:{row.h or 0}"


def save_model(counts: DataFrame, meta: Mapping[str, object], path: str, mode: str = "errorifexists") -> None:
    """Count table and one metadata row."""
    missing = [f for f in MODEL_FIELDS if f not in meta]
    if missing:
        raise KeyError(f"model metadata lacks {missing}")
    counts.write.mode(mode).parquet(f"{path}/counts")
    spark = counts.sparkSession
    spark.createDataFrame([dict(meta)]).write.mode(mode).json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Count table and metadata; required fields must be there, others get defaults."""
    row = spark.read.json(f"{path}/meta").first()
    meta = row.asDict() if row else {}
    missing = [f for f in MODEL_FIELDS if f not in meta]
    if missing:
        raise KeyError(f"model at {path} lacks {missing}; it has {sorted(meta)}")
    return spark.read.parquet(f"{path}/counts"), {**MODEL_DEFAULTS, **meta}


def require_same_vocabulary(meta: Mapping[str, object], templates: DataFrame) -> None:
    """Refuse a model that was fitted on another vocabulary."""
    current = fingerprint(templates)
    if meta["vocab_fingerprint"] != current:
        raise ValueError(
            f"model and templates differ: fitted on {meta['vocab_fingerprint']}, given {current}; retrain the model"
        )


def save_reports(reports: DataFrame, path: str, session: Sequence[str], text: str = "report", mode: str = "errorifexists") -> None:
    """One text in session order, the rule line between reports only.

    ``reports`` has the session, ``page``, ``is_last_page`` and the text. The pages of a session follow each other without a
    rule; they may lie in two part files, which are read in order of their names.
    """
    key = F.struct(*session)
    last = reports.agg(F.max(key).alias("last")).first().last
    is_end = F.lit(True)
    for name in session:
        is_end = is_end & F.col(name).eqNullSafe(F.lit(last[name] if last else None))
    body = F.regexp_replace(F.col(text), "\n$", "")  # the line end is the writer's
    closed = F.when(F.col("is_last_page") & ~is_end, F.concat(body, F.lit(REPORT_RULE.removesuffix("\n")))).otherwise(body)
    ordered = reports.orderBy(*session, "page").select(closed.alias("value"))
    ordered.write.mode(mode).option("lineSep", "\n").text(path)
