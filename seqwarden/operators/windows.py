"""Count-based context windows over session positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwarden.plans.skew import KeyProfile

BLOCK_ROWS = 1_000_000


def context_windows(
    df: DataFrame,
    session: Sequence[str],
    seq: str,
    key: str,
    width: int,
    profile: KeyProfile | None = None,
    block_rows: int = BLOCK_ROWS,
    full_only: bool = True,
) -> DataFrame:
    """Rows with a full context: ``ctx`` holds the ``width`` keys before ``key``.

    ``full_only=False`` keeps the first rows of a session too, with nulls in ``ctx``.

    ``seq`` must be dense per session. If the profile shows a hot session, or none is
    given, sessions are cut into blocks of ``block_rows`` positions and the last
    ``width`` rows of a block are copied to the next one, so no task ever holds more
    than one block; the result is the same.
    """
    if width < 1:
        raise ValueError(f"width must be at least 1, got {width}")
    group = list(session)
    if profile is None or profile.skewed:
        block_rows = max(block_rows, width)
        own = F.floor(F.col(seq) / F.lit(block_rows)).cast("long")
        near_end = F.pmod(F.col(seq), F.lit(block_rows)) >= block_rows - width
        blocks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
        df = df.withColumn("_own", own).withColumn("_block", F.explode(blocks))
        group.append("_block")
    window = Window.partitionBy(*group).orderBy(seq)
    context = F.array(*[F.lag(key, i).over(window) for i in range(width, 0, -1)])
    out = df.withColumn("ctx", context)
    out = out.filter(F.col(seq) >= width) if full_only else out
    if "_block" in group:
        out = out.filter(F.col("_own") == F.col("_block")).drop("_own", "_block")
    return out


def sample_count(df: DataFrame, session: Sequence[str], width: int) -> DataFrame:
    """Number of windows: the sum of ``length - width`` over sessions long enough."""
    sizes = df.groupBy(*session).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.greatest(F.col("_n") - F.lit(width), F.lit(0))
    return sizes.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("n_samples"))
