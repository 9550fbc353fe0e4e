"""Ordered work over keys of any size.

``row_number() over (partition by key)`` puts a whole key into one task. These
helpers give the same numbers when one key holds a large share of all rows: such
hot keys are cut into ordered chunks by a range shuffle, numbered chunk by chunk,
and shifted by the sizes of the chunks before. Keys that fit in a task take the
plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.session import materialize, shuffles_removed

ROWS_PER_TASK = 4_000_000
BROADCAST_ROWS = 100_000
SMALL_PIECES = 1_000  # pieces of an ordered table that are made as small as the caller asks
CHUNK = "_chunk"


@dataclass(frozen=True)
class KeyProfile:
    """Row counts per key, and the keys with more rows than one task should hold."""

    n_rows: int
    n_keys: int
    max_rows: int
    n_hot: int
    rows_per_task: int
    hot: DataFrame | None = None

    @property
    def skewed(self) -> bool:
        return self.n_hot > 0


def profile_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> KeyProfile:
    """One map-side combined count per key; only totals reach the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    is_hot = F.col("_n") > rows_per_task
    row = sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_rows"),
        F.count_if(is_hot).alias("n_hot"),
    ).first()
    hot = None
    if row.n_hot:
        # at most n_rows / rows_per_task rows by construction
        hot = materialize(sizes.filter(is_hot), "hot")
    return KeyProfile(row.n_rows, row.n_keys, row.max_rows, row.n_hot, rows_per_task, hot)


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on an input that comes in fewer pieces than there are cores.

    For a scan before heavy text work. Large inputs have many more pieces and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _as_integer(column: str, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return F.col(column).cast("long")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{column}`)")
    return None


def order_value(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value for the order columns.

    Two integer or time columns become one decimal, because a minimum over a fixed-width
    value is combined in a hash map, while a struct would need sorting first. The second
    column must not be negative.
    """
    if len(order) == 1:
        return F.col(order[0])
    parts = [_as_integer(c, df.schema[c].dataType) for c in order]
    if len(order) == 2 and all(p is not None for p in parts):
        high, low = (p.cast("decimal(19,0)") for p in parts)
        return (high * F.lit("10000000000000000000").cast("decimal(20,0)") + low).cast("decimal(38,0)")
    return F.struct(*order)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal. The right side's keys are renamed first, so
    both sides may come from one table; the result has the left columns and the right's others.

    A key that cannot be null is compared plainly, which lets the join reuse a partitioning.
    """
    theirs = {k: f"_right_{k}" for k in keys}
    renamed = right.select(*[F.col(c).alias(theirs.get(c, c)) for c in right.columns])

    def equal(k: str) -> Column:
        if left.schema[k].nullable and right.schema[k].nullable:
            return F.col(k).eqNullSafe(F.col(theirs[k]))
        return F.col(k) == F.col(theirs[k])

    on = reduce(lambda a, b: a & b, (equal(k) for k in keys))
    return left.join(renamed, on, how).drop(*theirs.values())


def hot_values(counts: DataFrame, keys: Sequence[str], n: str = "_n", rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """(keys, _salts) of the values with more rows than a task should hold, or None. ``counts`` has one row per value, or several to be added.

    At most ``BROADCAST_ROWS`` values are hot, since each holds at least that share of all rows.
    """
    sizes = counts.groupBy(*keys).agg(F.sum(n).alias("_rows"))
    with shuffles_removed(counts.sparkSession):
        total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("all"), F.coalesce(F.max("_rows"), F.lit(0)).alias("most")).first()
    if total.most <= rows_per_task:
        return None
    share = max(rows_per_task, -(-total.all // BROADCAST_ROWS))
    return materialize(sizes.filter(F.col("_rows") > share).select(*keys, F.ceil(F.col("_rows") / F.lit(share)).cast("int").alias("_salts")), "salts")


def with_salt(big: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Deals the rows of hot values to ``_salt`` 0 to n - 1 by a hash of all their columns; a retried task deals them alike."""
    salts = join_on(big, F.broadcast(hot), keys, "left")
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    return salts.withColumn("_salt", dealt).drop("_salts")


def join_hot(big: DataFrame, small: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` on ``keys``; rows of a hot value are spread over tasks and its partners copied to each.

    Only for inner and left joins, in which a row of ``big`` finds its partners wherever it lies. Rows of ``big`` that are
    equal in all columns stay together. The result has the columns of ``big`` and the others of ``small``.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be spread")
    if hot is None:
        return join_on(big, small, keys, how)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt")
    partners = join_on(small, F.broadcast(hot), keys, "left").select(*small.columns, copies)
    return join_on(with_salt(big, keys, hot), partners, [*keys, "_salt"], how).drop("_salt")


def ordered_pieces(n_rows: int, rows_per_task: int) -> int:
    """Number of pieces of an ordered table: half of ``rows_per_task`` rows each, if these are not too many pieces.

    The driver hears of each piece: the sample for its bounds, its task and its files. Beyond ``SMALL_PIECES`` there are only
    as many as ``ROWS_PER_TASK`` asks for; a larger piece is sorted with spilling and numbered as it streams by.
    """
    asked, needed = -(-2 * n_rows // rows_per_task), -(-2 * n_rows // ROWS_PER_TASK)
    return max(1, min(asked, max(SMALL_PIECES, needed)))


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], profile: KeyProfile) -> DataFrame:
    """Add ``_chunk``: 0 for ordinary keys, an order-preserving piece for hot ones."""
    hot = profile.hot.select(*keys)
    hot = hot if profile.n_hot > BROADCAST_ROWS else F.broadcast(hot)
    pieces = max(2, ordered_pieces(profile.n_rows, profile.rows_per_task))
    # written once: the range bounds come from a sample, so the piece numbers must not be recomputed
    hot_rows = materialize(
        join_on(df, hot, keys, "left_semi")
        .repartitionByRange(pieces, *keys, *order)
        .withColumn(CHUNK, F.spark_partition_id() + 1),
        "chunks",
    )
    cold_rows = join_on(df, hot, keys, "left_anti").withColumn(CHUNK, F.lit(0))
    return cold_rows.unionByName(hot_rows)


def row_index(window: Window) -> Column:
    return F.row_number().over(window).cast("long") - 1


def positions_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    profile: KeyProfile | None = None,
) -> DataFrame:
    """Dense 0-based position of every row inside its key."""
    profile = profile or profile_keys(df, keys)
    if not profile.skewed:
        return df.withColumn(out, row_index(Window.partitionBy(*keys).orderBy(*order)))
    pieces = chunked(df, keys, order, profile)
    numbered = pieces.withColumn(out, row_index(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per piece of a hot key: bounded by the number of pieces plus hot keys
    offsets = (
        pieces.filter(F.col(CHUNK) > 0)
        .groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    offsets = offsets if profile.n_hot > BROADCAST_ROWS else F.broadcast(offsets)
    shifted = join_on(numbered, offsets, [*keys, CHUNK], "left")
    return shifted.select(*df.columns, (F.col(out) + F.coalesce("_offset", F.lit(0))).alias(out))


def positions_overall(
    df: DataFrame,
    order: Sequence[str],
    out: str = "pos",
    n_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Dense 0-based position of every row in one overall order."""
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= rows_per_task:
        return df.withColumn(out, row_index(Window.orderBy(*order)))
    pieces = ordered_pieces(n_rows, rows_per_task)
    ranged = materialize(
        df.repartitionByRange(pieces, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "ranked",
    )
    # the id is the partition number in the upper bits and the row number in the lower 33
    piece, row = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumn("_piece", piece).withColumn("_row", row)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_piece")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranged.join(F.broadcast(offsets), "_piece")
        .withColumn(out, F.col("_row") + F.col("_offset"))
        .select(*df.columns, out)
    )
