"""Next-key probabilities for vocabularies of any size: hashed features of the context and a softmax in two levels.

Keys are numbered by frequency and dealt to about sqrt(V) groups of about sqrt(V) keys. P(key) = P(group) * P(key in group), each a softmax
whose scores are sums of one table row for each hashed feature. Both tables have ``buckets`` rows of sqrt(V) columns, so the model's size is
known beforehand: 8 * buckets * sqrt(V) bytes, 30 MB for 50,000 keys. The vocabulary stays a table and is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwarden.plans.skew import ROWS_PER_TASK, hot_values, join_hot, positions_overall
from seqwarden.session import materialize

BUCKETS = 1 << 14
PAIRS_PER_TASK = 50_000
ROUNDS = 4
EPOCHS = 10
RATE = 0.5
BATCH = 4096
SCORED = 64
ROWS_IN_BLOCK = 512


@dataclass(frozen=True)
class SoftmaxModel:
    """``upper`` scores groups, ``lower`` the keys of a group; ``vocabulary`` has (key, code), code = group * side + place."""

    upper: np.ndarray
    lower: np.ndarray
    vocabulary: DataFrame
    n_keys: int

    @property
    def side(self) -> int:
        return self.upper.shape[1]


def features(ctx: str, buckets: int) -> Column:
    """A bucket for each position with its key, and one for the bias."""
    placed = F.transform(ctx, lambda k, i: F.pmod(F.xxhash64(i, k), F.lit(buckets)).cast("int"))
    return F.concat(F.array(F.pmod(F.xxhash64(F.lit(-1)), F.lit(buckets)).cast("int")), placed)


def _in_group(f: np.ndarray, group: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the features crossed with a group."""
    with np.errstate(over="ignore"):
        h = (f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (group.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x165667B19E3779F9)
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=-1, keepdims=True))


def _scores(table: np.ndarray, rows: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Log-probabilities from the sums of the table rows named in the last axis of ``rows``."""
    z = np.zeros((*rows.shape[:-1], table.shape[1]))
    for i in range(rows.shape[-1]):
        z += table[rows[..., i]]
    return _log_softmax(np.where(allowed, z, -np.inf))


def _train(upper: np.ndarray, lower: np.ndarray, f: np.ndarray, code: np.ndarray, weight: np.ndarray, n_keys: int, epochs: int, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Adagrad over the rows of one task; (table, how much weight used each of its rows)."""
    tables = [upper.copy(), lower.copy()]
    side, buckets = upper.shape[1], upper.shape[0]
    used = [np.zeros(buckets), np.zeros(buckets)]
    speed = [np.full(buckets, 1e-6), np.full(buckets, 1e-6)]
    group, place = code // side, code % side
    rows = [f, _in_group(f, group[:, None], buckets)]
    groups = -(-n_keys // side)
    allowed = [np.broadcast_to(np.arange(side) < groups, (len(f), side)), group[:, None] * side + np.arange(side) < n_keys]
    for t in (0, 1):
        np.add.at(used[t], rows[t], weight[:, None])
    for _ in range(epochs):
        for at in range(0, len(f), BATCH):
            part = slice(at, at + BATCH)
            share = weight[part] / weight[part].sum()
            for t, own in ((0, group), (1, place)):
                r = rows[t][part]
                g = np.exp(_scores(tables[t], r, allowed[t][part]))
                g[np.arange(len(g)), own[part]] -= 1
                g *= share[:, None]
                names, back = np.unique(r, return_inverse=True)
                total = np.zeros((len(names), side))
                np.add.at(total, back.reshape(r.shape), g[:, None, :])
                speed[t][names] += (total * total).sum(axis=1)
                tables[t][names] -= rate * total / np.sqrt(speed[t][names])[:, None]
    return list(zip(tables, used, strict=True))


def fit(counts: DataFrame, buckets: int = BUCKETS, rounds: int = ROUNDS, epochs: int = EPOCHS, pairs_per_task: int = PAIRS_PER_TASK) -> SoftmaxModel:
    """Learns from counted pairs (ctx, target, n), as of ``count_model``; contexts may have different lengths.

    Each round every task trains on its share of the distinct pairs, starting from the common tables, and a row's new value is the mean over the
    tasks that used it, weighted by their counts. Rows are averaged in blocks by Spark; the driver gets the two tables, whose size is
    fixed. An empty table gives a model without keys, which flags everything.
    """
    spark = counts.sparkSession
    sizes = materialize(counts.groupBy(F.col("target").alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs")), "sizes")
    totals = sizes.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    ordered = positions_overall(sizes.withColumn("_most", -F.col("n")), ["_most", "key"], "code", totals.keys)
    vocabulary = materialize(ordered.select("key", "code"), "vocabulary")
    side = max(1, int(np.ceil(np.sqrt(totals.keys))))
    upper, lower = np.zeros((buckets, side), np.float32), np.zeros((buckets, side), np.float32)
    if not totals.pairs:
        return SoftmaxModel(upper, lower, vocabulary, 0)
    pieces = max(1, -(-totals.pairs // pairs_per_task))
    # pairs are distinct, so pieces by hash are of nearly equal size
    place = F.xxhash64("ctx", "code")
    coded = counts.join(vocabulary, F.col("target") == F.col("key")).withColumn("_h", place)
    coded = coded.select(features("ctx", buckets).alias("f"), "code", F.col("n").cast("double").alias("n"), "_h", F.pmod("_h", F.lit(pieces)).cast("int").alias("_piece"))
    shares = materialize(coded, "shares").groupBy("_piece")
    n_keys = totals.keys

    for number_of_round in range(rounds):
        rate = RATE / (1 + 3 * number_of_round)
        start = spark.sparkContext.broadcast((upper, lower))

        def learn(rows: pd.DataFrame) -> pd.DataFrame:
            # a piece is bounded; contexts of each length are trained as a block of their own, in an order that a retry repeats
            rows, changed = rows.sort_values(["_h", "code"]), []
            tables, used = [t.astype(np.float64) for t in start.value], [np.zeros(buckets), np.zeros(buckets)]
            for _, same in rows.groupby(rows["f"].map(len)):
                order = np.random.default_rng(len(same)).permutation(len(same))
                f = np.stack(same["f"].to_numpy()).astype(np.int64)[order]
                code, n = same["code"].to_numpy(np.int64)[order], same["n"].to_numpy(np.float64)[order]
                out = _train(*tables, f, code, n, n_keys, epochs, rate)
                tables = [t for t, _ in out]
                used = [a + b for a, (_, b) in zip(used, out, strict=True)]
            for number, (t, u) in enumerate(zip(tables, used, strict=True)):
                for at in range(0, buckets, ROWS_IN_BLOCK):
                    w = u[at : at + ROWS_IN_BLOCK]
                    if w.any():
                        value = (t[at : at + ROWS_IN_BLOCK] * w[:, None]).astype(np.float64)
                        changed.append((number, at, w.tobytes(), value.tobytes()))
            return pd.DataFrame(changed, columns=["number", "at", "w", "v"])

        def mean(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, v = 0.0, 0.0
            for batch in batches:
                for a, b in zip(batch["w"], batch["v"], strict=True):
                    w, v = w + np.frombuffer(a), v + np.frombuffer(b).reshape(-1, side)
            yield pd.DataFrame({"number": [key[0]], "at": [key[1]], "w": [w.tobytes()], "v": [(v / np.where(w > 0, w, 1)[:, None]).astype(np.float32).tobytes()]})

        schema = "number int, at int, w binary, v binary"
        for row in shares.applyInPandas(learn, schema).groupBy("number", "at").applyInPandas(mean, schema).collect():
            here = np.frombuffer(row["w"]) > 0
            table = (upper, lower)[row["number"]][row["at"] : row["at"] + ROWS_IN_BLOCK]
            table[here] = np.frombuffer(row["v"], np.float32).reshape(-1, side)[here]
        start.unpersist()
    return SoftmaxModel(upper, lower, vocabulary, n_keys)


def rank_pairs(pairs: DataFrame, model: SoftmaxModel, key: str = "key") -> DataFrame:
    """(ctx, key, log_p, rank) of distinct pairs; the most probable key has rank 0, equal ones by their number.

    A key that the model does not know has neither.
    """
    buckets, side, n_keys = model.upper.shape[0], model.side, model.n_keys
    shared = pairs.sparkSession.sparkContext.broadcast((model.upper, model.lower))  # 8 * buckets * sqrt(V) bytes
    coded = pairs.select("ctx", key).join(model.vocabulary.withColumnRenamed("key", key), key, "left")
    coded = coded.select("ctx", key, F.coalesce("code", F.lit(-1)).cast("long").alias("code"), features("ctx", buckets).alias("f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper, lower = shared.value
        groups = np.arange(side)
        exists = groups[:, None] * side + np.arange(side) < n_keys
        for batch in batches:
            log_p, rank = np.full(len(batch), np.nan), np.full(len(batch), -1, np.int64)
            code = batch["code"].to_numpy(np.int64)
            lengths = batch["f"].map(len).to_numpy()
            for length in np.unique(lengths[code >= 0]):
                chosen = np.nonzero((lengths == length) & (code >= 0))[0]
                for at in range(0, len(chosen), SCORED):
                    rows = chosen[at : at + SCORED]
                    f = np.stack(batch["f"].to_numpy()[rows]).astype(np.int64)
                    over = _scores(upper, f, exists.any(axis=1))
                    # groups without keys are left out of both softmaxes
                    inner = _scores(lower, _in_group(f[:, None, :], groups[None, :, None], buckets), exists | ~exists.any(axis=1, keepdims=True))
                    p = np.where(exists, over[:, :, None] + inner, -np.inf).reshape(len(rows), -1)
                    own = p[np.arange(len(rows)), code[rows]]
                    log_p[rows] = own
                    earlier = np.arange(p.shape[1]) < code[rows, None]
                    rank[rows] = (p > own[:, None]).sum(axis=1) + ((p == own[:, None]) & earlier).sum(axis=1)
            out = batch[["ctx", key]].copy()
            known = code >= 0
            yield out.assign(log_p=pd.Series(log_p, index=out.index).where(known, None), rank=pd.Series(rank, index=out.index).astype("Int64").where(known))

    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    return coded.mapInPandas(run, f"ctx {kinds['ctx']}, `{key}` {kinds[key]}, log_p double, rank long")


def detect(samples: DataFrame, model: SoftmaxModel, key: str, k: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of ``samples`` with ``flag``: the key is not among the ``k`` most probable ones. Decided once for each distinct (ctx, key)."""
    sizes = materialize(samples.groupBy("ctx", key).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    ranked = rank_pairs(sizes, model, key).select("ctx", key, F.coalesce(F.col("rank") >= k, F.lit(True)).alias("flag"))
    return join_hot(samples, materialize(ranked, "ranked"), ["ctx", key], hot_values(sizes, ["ctx", key], rows_per_task=rows_per_task), "left")


def log_losses(counts: DataFrame, model: SoftmaxModel) -> DataFrame:
    """One row: counted rows, and the mean loss of the model and of plain key frequencies over them."""
    ranked = rank_pairs(counts.select("ctx", F.col("target").alias("key")), model)
    scored = ranked.join(counts.select("ctx", F.col("target").alias("key"), "n"), ["ctx", "key"])
    by_key = counts.groupBy("target").agg(F.sum("n").alias("n"))
    totals = by_key.agg(F.sum("n").alias("n_rows"), (-F.sum(F.col("n") * F.log("n"))).alias("_own"))
    own = totals.select("n_rows", (F.col("_own") / F.col("n_rows") + F.log("n_rows")).alias("frequency_loss"))
    loss = scored.agg((-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("model_loss"))
    return own.withColumn("_one", F.lit(1)).join(loss.withColumn("_one", F.lit(1)), "_one").drop("_one")
