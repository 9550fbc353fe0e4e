"""Near-duplicate vectors: p-stable hashing of normalised vectors, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.llm.batches import bounded, releasing
from seqwarden.llm.components import connected_components
from seqwarden.session import materialize, materialize_at, remove_table

WIDTH = 2.0  # of a quantised projection
FOREIGN = 0.486  # probability that orthogonal unit vectors share one quantised projection of this width
BUCKET = 256  # foreign vectors that a bucket may hold on average
MISS = 0.003  # links at exactly the threshold that all tables may miss
BLOCK = 2048  # rows of a bucket that one task compares with each other
STRIP = 512
SMALL = 8  # rows of a bucket up to which it is compared together with others
ROUND_BYTES = 128 << 20  # of vectors that are moved at once, if two tables take no more
LEAST_PARTS, PART_BYTES = 256, 8 << 20  # of the vectors that are moved at once, which are dealt out by bucket
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 18  # in which the rows of each table's buckets are counted
COUNTERS = 256  # tasks that count them
PAIRS = 1 << 18  # found pairs that are looked at together
BATCH = 2048  # vectors hashed at once


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance share one quantised Gaussian projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(projections of a table, number of tables) so that a link at the threshold is missed with probability ``MISS``.

    Projections grow with the logarithm of the number of vectors, so buckets keep their size.
    """
    k = max(2, math.ceil(math.log(max(2, n) / BUCKET) / -math.log(FOREIGN))) if n > BUCKET else 2
    p = collision(math.sqrt(2 - 2 * threshold)) ** k
    return k, max(4, math.ceil(math.log(MISS) / math.log(1 - p)) if p < 1 else 4)


def _links(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest index that links reach from each index."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


@lru_cache(maxsize=2)
def _drawn(dims: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Projections and shifts as whole numbers of 2^-bits and 2^-2bits, factors and salts of the hashes, and the bits."""
    rng = np.random.default_rng((seed, dims))
    a, b = rng.standard_normal((dims, k * tables)), rng.uniform(0, WIDTH, k * tables)
    # no sum of a unit vector's products exceeds 8 * sqrt(dims), so all sums stay below 2^53 and are exact in any order
    bits = (49 - math.ceil(math.log2(dims) / 2)) // 2
    return np.rint(np.clip(a, -8, 8) * 2.0**bits), np.rint(b * 4.0**bits), rng.integers(1, 1 << 62, (tables, k)) * 2 + 1, rng.integers(1, 1 << 62, tables), bits


def buckets(v: np.ndarray, k: int, tables: int, seed: int, first: int, last: int) -> np.ndarray:
    """The buckets of unit vectors in the tables from ``first`` to before ``last``; the same wherever they are computed."""
    a, b, odd, salt, bits = _drawn(v.shape[1], k, tables, seed)
    own = slice(first * k, last * k)
    cells = np.floor((np.rint(v * 2.0**bits) @ a[:, own] + b[own]) / (WIDTH * 4.0**bits)).astype(np.int64).reshape(len(v), last - first, k)
    with np.errstate(over="ignore"):
        bucket = (cells * odd[first:last]).sum(axis=2) + salt[first:last]
    return bucket ^ bucket >> 29


def _unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v


def _mixed(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A hash of each row of the columns."""
    x = x.view(np.uint64)
    for y in (np.zeros(1, np.int64), *more):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + y.astype(np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _record(dims: int, number: str) -> np.dtype:
    """A vector on its way to the group it is compared in; ``side`` is 0 if the group is compared with itself, else the block's."""
    return np.dtype([("group", "<i8"), ("class", "<i8"), ("n", "<i8"), ("table", "<i2"), ("side", "<i2"), ("v", number, (dims,))])


def _blocks(table: int, bucket: np.ndarray, slots: int, hot: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Into how many blocks each bucket is cut."""
    slot = table * slots + (bucket & (slots - 1))
    at = np.minimum(np.searchsorted(hot, slot), max(0, len(hot) - 1))
    return np.where(hot[at] == slot, cuts[at], 1) if len(hot) else np.ones(len(slot), np.int64)


def _addressed(rows: np.ndarray, table: int, bucket: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The records of rows in one table; in a bucket that is cut, a row goes to the meeting of its block with each block."""
    if (blocks == 1).all():
        out = rows.copy()
        out["group"], out["side"] = _mixed(bucket), 0
    else:
        who = np.repeat(np.arange(len(rows)), blocks)
        other = np.arange(len(who)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        out = rows[who]
        own = (_mixed(out["class"].copy()).view(np.uint64) % blocks[who].astype(np.uint64)).astype(np.int64)
        out["group"] = np.where(blocks[who] == 1, _mixed(bucket[who]), _mixed(bucket[who], np.minimum(own, other), np.maximum(own, other)))
        out["side"] = np.where(own == other, 0, np.where(own < other, 1, 2))
    out["table"] = table
    return out


def _close(group: np.ndarray, side: np.ndarray, v: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, whether sure) of rows of one group, which is sorted, whose cosine in single precision may reach the threshold, a few at a time."""
    margin = 2.5e-7 * (v.shape[1] + 8)  # more than single precision can be off
    size = np.diff(np.append(starts := np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    few = np.repeat(size <= SMALL, size)
    for step in range(1, SMALL):
        i = np.flatnonzero(few[step:] & (group[step:] == group[:-step]) & ((side[step:] != side[:-step]) | (side[step:] == 0)))
        cosine = np.einsum("ij,ij->i", v[i], v[i + step])
        near = cosine >= threshold - margin
        yield i[near], i[near] + step, cosine[near] >= threshold + margin
    for a, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
        at = side[a : a + n]
        x, y = (np.arange(a, a + n),) * 2 if not at[0] else (a + np.flatnonzero(at == 1), a + np.flatnonzero(at == 2))
        vy = v[a : a + n] if not at[0] else v[y]
        for begin in range(0, len(x), STRIP):
            # of a group compared with itself, only rows that come later
            later = begin if not at[0] else 0
            cosine = v[x[begin : begin + STRIP]] @ vy[later:].T
            i, j = np.nonzero(cosine >= threshold - margin)
            sure = cosine[i, j] >= threshold + margin
            i, j = x[begin + i], y[later + j]
            if not at[0]:
                once = i < j
                i, j, sure = i[once], j[once], sure[once]
            yield i, j, sure


def _met_first(i: np.ndarray, j: np.ndarray, table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of the pairs share the bucket of their table and of no earlier one; ``own`` are the buckets of all tables so far."""
    at = np.flatnonzero(own[i, table] == own[j, table])
    for t in range(own.shape[1] - 1):
        if not len(at):
            break
        at = at[(own[i[at], t] != own[j[at], t]) | (table[at] <= t)]
    return at


def _solved(rows: np.ndarray, threshold: float, k: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(class, other, links) of records of one length: links to others and a spanning set of links."""
    rows = rows[np.argsort(rows["group"], kind="stable")]
    cls, n, table, exact = rows["class"].copy(), rows["n"].copy(), rows["table"].astype(np.int64), _unit(rows["v"])

    def links(found: list) -> Iterator[pa.RecordBatch]:
        i, j, sure = (np.concatenate(c) for c in zip(*found))
        use, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        last = int(table[use].max(initial=-1)) + 1
        own = np.concatenate([buckets(exact[use[at : at + STRIP]], k, tables, seed, 0, last) for at in range(0, len(use), STRIP)]) if len(use) else None
        i, j = at[: len(i)], at[len(i) :]
        if len(i):
            first = _met_first(i, j, table[use[i]], own)
            i, j, sure = i[first], j[first], sure[first]
            doubtful = np.flatnonzero(~sure)
            sure[doubtful] = np.einsum("ij,ij->i", exact[use[i[doubtful]]], exact[use[j[doubtful]]]) >= threshold
            i, j = i[sure], j[sure]
        if len(i):
            # of a class that is in several groups all rows are one
            name, who = np.unique(cls[use], return_inverse=True)
            copies = np.zeros(len(name), np.int64)
            copies[who] = n[use]
            i, j = who[i], who[j]
            count = np.zeros(len(name), np.int64)
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            linked = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(name[linked]), pa.array(name[_links(i, j, len(name))[linked]]), pa.array(count[linked])], ["class", "other", "links"])

    found, many = [], 0
    for some in _close(rows["group"].copy(), rows["side"].copy(), exact.astype(np.float32), threshold):
        if len(some[0]):
            found.append(some)
            many += len(some[0])
        if many >= PAIRS:
            yield from links(found)
            found, many = [], 0
    if found:
        yield from links(found)


def linked_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors with equal components form a class first, so copies are counted and never compared. Each
    class gets one bucket in each table: the hash of its quantised random projections. The tables are taken a few at a
    time, in rounds that move each vector as it was read to its buckets, many of one part in a row; what a round has moved is removed
    when it ends, so disk holds the vectors and a round's copies, however many tables there are. Buckets of
    more than ``BLOCK`` rows are cut into blocks and every two blocks meet in a group of their own, so no pair
    is lost and no task holds more than two blocks of one bucket. A pair is counted in the first table where it meets, for which the
    buckets of linked vectors are computed again; per task only sums and a spanning set of links leave. The cosine is computed in double
    precision and decides alone; single precision only rules out pairs further below the threshold than it can be off.

    Vectors of each length are compared among themselves, with projections of their own; those of different lengths have no cosine.
    A vector that is null, empty, zero, or with a null or non-finite component has no link. A null id is
    returned with its links; it is never the smallest.
    """
    spark = vectors.sparkSession
    single = isinstance(getattr(vectors.schema[embedding].dataType, "elementType", None), T.FloatType)
    kind, number, width = ("float", "<f4", 4) if single else ("double", "<f8", 8)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = rows.select("vec_id", F.when(fine, F.xxhash64(F.transform("v", lambda x: x.cast("double") + 0.0))).alias("class"), F.when(fine, F.col("v")).alias("v"))
    stored, at = materialize_at(keyed, "vectors")

    @releasing
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(3).value_lengths()).astype(np.int32)
            values, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(number), np.cumsum(lengths)
            raw = pa.array([values[b - n : b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths), raw], ["class", "rep", "n", "dims", "v"])

    classes = stored.filter("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.select("class", "rep", "n", "v").mapInArrow(packed, "class long, rep long, n long, dims int, v binary"), "classes")
    ids = materialize(stored.select("vec_id", "class"), "ids")
    remove_table(spark, at)
    # tables for the most frequent length serve the others too: more rows only ask for more of them
    sizes = classes.groupBy("dims").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n"), F.sum(F.col("n") * (36 + width * F.col("dims")))).first()
    k, tables = plan(sizes[0] or 0, threshold)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(0, (sizes[1] or 0).bit_length() - 8)))

    def of_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """(dims, records) of (class, n, dims, v), a few of one length at a time."""
        for batch in bounded(batches, 3):
            lengths = batch.column(2).to_numpy()
            for dims in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                rows = np.zeros(part.num_rows, _record(dims, number))
                rows["class"], rows["n"] = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows["v"] = np.frombuffer(b"".join(part.column(3).to_pylist()), number).reshape(-1, dims)
                for begin in range(0, len(rows), BATCH):
                    yield dims, rows[begin : begin + BATCH]

    points = classes.select("class", "n", "dims", "v")
    counters = min(COUNTERS, max(1, points.rdd.getNumPartitions()))
    least = max(1, BLOCK // (2 * counters))  # a task is silent of fewer rows of a slot

    @releasing
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(tables * slots, np.int32)
        for _, rows in of_length(batches):
            bucket = buckets(_unit(rows["v"]), k, tables, seed, 0, tables)
            np.add.at(counts, (np.arange(tables) * slots + (bucket & (slots - 1))).reshape(-1), 1)
        slot = np.flatnonzero(counts >= least)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot].astype(np.int64))], ["slot", "n"])

    told = points.coalesce(counters).mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # at most two slots for each block of rows, and few where vectors are not alike
    told = told.withColumn("n", F.col("n") + counters * (least - 1)).filter(F.col("n") > BLOCK).toArrow()
    order = np.argsort(slot := told["slot"].to_numpy())
    hot, cuts = slot[order], -(-told["n"].to_numpy()[order] // BLOCK)
    once = sizes[2] or 0  # bytes that one table moves
    per_round = max(2, ROUND_BYTES // max(1, once))
    parts = max(LEAST_PARTS, once * min(tables, per_round) // PART_BYTES)

    def compared(first: int, last: int) -> DataFrame:
        @releasing
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dims, rows in of_length(batches):
                bucket = buckets(_unit(rows["v"]), k, tables, seed, first, last)
                for t in range(first, last):
                    own = np.ascontiguousarray(bucket[:, t - first])
                    out = _addressed(rows, t, own, _blocks(t, own, slots, hot, cuts))
                    part = (out["group"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts)
                    out, part = out[order := np.argsort(part, kind="stable")], part[order].astype(np.int64)
                    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    blobs = [out[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(out)])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(np.full(len(cut), dims, np.int32)), pa.array(blobs, pa.binary())], ["part", "dims", "rows"])

        @releasing
        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, key = [], None
            for batch in batches:
                for *at, blob in zip(*(c.to_pylist() for c in batch.columns)):
                    if at != key and waiting:
                        yield from _solved(np.frombuffer(b"".join(waiting), _record(key[1], number)), threshold, k, tables, seed)
                        waiting = []
                    key = at
                    waiting.append(blob)
            if waiting:
                yield from _solved(np.frombuffer(b"".join(waiting), _record(key[1], number)), threshold, k, tables, seed)

        moved = points.mapInArrow(dealt, "part long, dims int, rows binary").repartition("part", "dims").sortWithinPartitions("part", "dims")
        return materialize(moved.mapInArrow(met, "class long, other long, links long"), "found")

    found = reduce(DataFrame.unionByName, [compared(t, min(tables, t + per_round)) for t in range(0, tables, per_round)])
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.select("class", "other"), "class", "other")
    placed = materialize(nodes.join(classes.select(F.col("class").alias("node"), "rep"), "node"), "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    moved = placed.join(least, "component").select(F.col("node").alias("class"), "least")
    final = classes.join(sums, "class", "left").join(moved, "class", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    final = materialize(final, "final")
    return ids.join(final, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
