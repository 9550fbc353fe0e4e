"""Events of sessions on disk, so that joins by session and position need no shuffle.

The rows of a session are cut into blocks of positions. A table is bucketed by session, block and position, for joins of tables with the
same layout, or by session and block, for work along the positions; Spark reuses buckets for a join only if they are of all its keys.
Either way a session of any length is spread over all buckets, and files are sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "_block"
BLOCK_ROWS = 10_000


@dataclass(frozen=True)
class Layout:
    """What tables must share to be joined without a shuffle: names of the session columns, the position, buckets and block length."""

    session: tuple[str, ...]
    seq: str = "seq"
    buckets: int = 200
    block_rows: int = BLOCK_ROWS
    whole_blocks: bool = False  # a block lies in one bucket

    @property
    def bucketed_by(self) -> list[str]:
        return self.group if self.whole_blocks else self.on

    @property
    def group(self) -> list[str]:
        return [*self.session, BLOCK]

    @property
    def on(self) -> list[str]:
        return [*self.group, self.seq]

    def block(self) -> Column:
        return F.floor(F.col(self.seq) / self.block_rows).cast("long")


def save(df: DataFrame, table: str, path: str, layout: Layout, mode: str = "errorifexists") -> DataFrame:
    """Writes ``df`` as table ``table`` in folder ``path`` and returns it as a scan of its buckets.

    One task writes one bucket, so each is one sorted file. Session and position must not be null: the plain equality that
    buckets serve would lose such rows, so the write fails. An existing column of the block's name is refused.
    """
    taken = {c.lower() for c in df.columns}
    if BLOCK in taken:
        raise ValueError(f"the table has a column {BLOCK}")
    must = [*layout.session, layout.seq]
    known = df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)) for c in must})
    dealt = known.withColumn(BLOCK, layout.block()).repartition(layout.buckets, *layout.bucketed_by)
    writer = dealt.write.mode(mode).format("parquet").option("path", path)
    writer.bucketBy(layout.buckets, *layout.bucketed_by).sortBy(*layout.on).saveAsTable(table)
    return df.sparkSession.table(table)


def register(spark: SparkSession, table: str, path: str, columns: str, layout: Layout) -> DataFrame:
    """A table that another session wrote with :func:`save`; ``columns`` is its schema as DDL, without the block."""
    group, on = ", ".join(layout.bucketed_by), ", ".join(layout.on)
    spark.sql(
        f"CREATE TABLE {table} ({columns}, {BLOCK} BIGINT) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({group}) SORTED BY ({on}) INTO {layout.buckets} BUCKETS"
    )
    return spark.table(table)


def join(left: DataFrame, right: DataFrame, layout: Layout, how: str = "left") -> DataFrame:
    """Rows of the same session and position; columns of ``left`` first, then what ``right`` has besides the keys."""
    return left.join(right, layout.on, how)


def with_missing(joined: DataFrame, columns: Sequence[str], missing: str) -> DataFrame:
    """Context of a position as text; what is missing becomes the text ``missing``."""
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns})


def sequences(table: DataFrame, key: str, layout: Layout) -> DataFrame:
    """Ordered values of ``key`` by session and block: an array holds one block at most, whatever the length of its session.

    Of a table stored in whole blocks this needs no shuffle.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(layout.seq).alias("s"), F.col(key).alias("k"))))
    grouped = table.groupBy(*layout.group).agg(F.transform(rows, lambda e: e["k"]).alias("keys"))
    return grouped.withColumnRenamed(BLOCK, "block")
