"""Cleaning between the flat event table and sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwarden.fixed_values import (
    NOISE_INVOKED_BY,
    NOISE_USER_AGENTS,
    NULL_TEXT,
    TEST_TYPE,
    TEST_USER_NAMES,
    TRAIN_TYPE,
)
from seqwarden.functions.text import contains_any, utc_time
from seqwarden.functions.variant import scalar_text


@dataclass(frozen=True)
class SplitSpec:
    """Which rows form the normal baseline and which the evaluation set; both are plain data."""

    type_column: str = "userIdentity_type"
    name_column: str = "userIdentity_userName"
    train_type: str = TRAIN_TYPE
    test_type: str = TEST_TYPE
    test_names: Sequence[str] = TEST_USER_NAMES

    def is_train(self) -> Column:
        return F.coalesce(F.col(self.type_column) == self.train_type, F.lit(False))

    def is_test(self) -> Column:
        named = F.coalesce(F.col(self.name_column).isin(*self.test_names), F.lit(False))
        return named | F.coalesce(F.col(self.type_column) == self.test_type, F.lit(False))


@dataclass(frozen=True)
class NoiseSpec:
    """Columns with the patterns that mark automated traffic."""

    rules: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("userAgent", NOISE_USER_AGENTS),
        ("userIdentity_invokedBy", NOISE_INVOKED_BY),
    )
    literal: bool = False

    def is_noise(self, columns: Sequence[str]) -> Column:
        found = F.lit(False)
        for column, patterns in self.rules:
            if column in columns:
                found = found | contains_any(column, patterns, self.literal)
        return found


def with_time(df: DataFrame, column: str = "eventTime", strict: bool = True) -> DataFrame:
    return df.withColumn(column, utc_time(column, strict))


def fill_missing(
    df: DataFrame, time: str = "eventTime", sentinel: str = NULL_TEXT, keep: Sequence[str] = ()
) -> DataFrame:
    """Every column but the time and those to keep as text, null replaced by the sentinel."""
    return df.select(
        *[
            F.col(f.name)
            if f.name == time or f.name in keep
            else F.coalesce(scalar_text(F.col(f.name), f.dataType), F.lit(sentinel)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as text, null replaced by the empty text."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present})


def drop_without_session(df: DataFrame, session: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(session))


def split_train_test(df: DataFrame, spec: SplitSpec = SplitSpec()) -> tuple[DataFrame, DataFrame]:
    return df.filter(spec.is_train()), df.filter(spec.is_test())


def with_splits(df: DataFrame, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """One row per split a row belongs to, in one pass: rows may be in both or in none."""
    member = F.filter(
        F.array(F.when(spec.is_train(), F.lit("train")), F.when(spec.is_test(), F.lit("test"))),
        lambda s: s.isNotNull(),
    )
    return df.withColumn("split", F.explode(member))


def drop_noise(df: DataFrame, spec: NoiseSpec = NoiseSpec()) -> DataFrame:
    return df.filter(~spec.is_noise(df.columns))


def stage_counts(df: DataFrame, split: SplitSpec = SplitSpec(), noise: NoiseSpec = NoiseSpec()) -> DataFrame:
    """Rows in all, per split, and per split without noise; one pass."""
    quiet = ~noise.is_noise(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(split.is_train()).alias("n_train"),
        F.count_if(split.is_test()).alias("n_test"),
        F.count_if(split.is_train() & quiet).alias("n_train_kept"),
        F.count_if(split.is_test() & quiet).alias("n_test_kept"),
    )


def leaked_rows(train: DataFrame, test: DataFrame, on: Sequence[str]) -> DataFrame:
    """Training rows that are also in the test set."""
    return train.join(test.select(*on), list(on), "left_semi")


def require_training_only(df: DataFrame, split: str = "split") -> None:
    """Refuse to fit on rows that are not marked as training rows."""
    other = df.filter(~F.col(split).eqNullSafe("train")).limit(1).count()
    if other:
        raise ValueError("templates and model must be fitted on training rows only")
