"""Connected components of a link table, as joins and aggregates over rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import releasing
from seqwarden.session import materialize


@releasing
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of one partition by a star for each tree they form."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    tree = [(x, r) for x in list(parent) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in tree], pa.int64()) for i in (0, 1)], ["hi", "lo"])


def _large_star(links: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the node's smallest neighbour."""
    both = links.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionByName(
        links.select(F.col("lo").alias("v"), F.col("hi").alias("u"))
    )
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    return (
        both.join(least, "v")
        .filter("u > v")
        .select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that ``links`` names; component is the smallest node reachable.

    Links of one partition are first reduced to stars, then large-star and small-star
    rounds follow until nothing changes: a number of rounds that grows with the logarithm of
    the longest path. Each round is a written table, so a lost executor costs one round at
    most. A node with very many links is a skewed join, which adaptive execution splits.
    Rows with a null end are no links; loops are ignored.
    """
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = ends.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    e = materialize(e.mapInArrow(_forest, "hi long, lo long"), "links")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = materialize(_small_star(_large_star(e)), "links")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
