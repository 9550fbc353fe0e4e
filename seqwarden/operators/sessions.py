"""Sessions: equal keys, ordered by time, no gap and no timeout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.fixed_values import UNKNOWN_SESSION
from seqwarden.plans.skew import (
    ROWS_PER_TASK,
    KeyProfile,
    join_on,
    order_value,
    positions_overall,
    positions_within,
    profile_keys,
)


def present_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def with_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seq", profile: KeyProfile | None = None
) -> DataFrame:
    """Dense 0-based position inside the session."""
    return positions_within(df, keys, order, out, profile)


def session_firsts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per session with the place of its first event and its length."""
    return df.groupBy(*keys).agg(F.min(order_value(df, order)).alias("_first"), F.count(F.lit(1)).alias("n_events"))


def assign_sessions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    session_id: str = "session_id",
    seq: str = "seq",
    rows_per_task: int = ROWS_PER_TASK,
    missing: str = UNKNOWN_SESSION,
) -> DataFrame:
    """Session ordinal by first event, and position inside the session.

    A missing key counts as the text ``missing``. With none of the key columns present all rows form session 0. Only the one-row-
    per-session table is ranked overall; events are never sorted globally.
    """
    keys = present_keys(df, keys)
    if not keys:
        return positions_overall(df.withColumn(session_id, F.lit(0).cast("long")), order, seq, rows_per_task=rows_per_task)
    # never null, so that the join below reuses the partitioning of the window
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns(
        {n: F.coalesce(F.col(k).cast("string"), F.lit(missing)) for n, k in zip(names, keys)}
    )
    profile = profile_keys(keyed, names, rows_per_task)
    ordinals = session_ordinals(keyed, names, order, session_id, profile)
    positioned = with_positions(keyed, names, order, seq, profile)
    return join_on(positioned, ordinals, names).select(*df.columns, session_id, seq)


def session_ordinals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], session_id: str, profile: KeyProfile
) -> DataFrame:
    ranked = positions_overall(
        session_firsts(df, keys, order), ["_first"], session_id, profile.n_keys, profile.rows_per_task
    )
    return ranked.select(*keys, session_id)


def with_surrogate_id(df: DataFrame, keys: Sequence[str], out: str = "session_key") -> DataFrame:
    """Order-free session id that needs no ranking and no shuffle."""
    return df.withColumn(out, F.xxhash64(*keys))


def summarize_sessions(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Length and time range per session."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def count_sessions(df: DataFrame, keys: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct sessions and rows; ``approximate`` trades exactness for a fixed-size sketch."""
    if approximate:
        n = F.approx_count_distinct(F.struct(*keys))
        return df.agg(n.alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_events")
    )


def time_range(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def order_for_output(df: DataFrame, time: str, session_id: str = "session_id", seq: str = "seq") -> DataFrame:
    """Global output order; the range shuffle splits any hot value of ``time`` by the tie columns."""
    return df.orderBy(time, session_id, seq)


def key_sequences(df: DataFrame, session: Sequence[str], seq: str, key: str) -> DataFrame:
    """Ordered key array per session, for export of sessions that fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(key).alias("key"))))
    return df.groupBy(*session).agg(F.transform(ordered, lambda e: e["key"]).alias("keys"))
