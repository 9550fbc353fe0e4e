"""Next-key model by counting, and top-k anomaly flags.

The model is a table ``(ctx ARRAY, target, n)``. Flags come from the ``k`` most
frequent targets per context, ties broken by the smaller key.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwarden.operators.windows import context_windows
from seqwarden.plans.skew import ROWS_PER_TASK, KeyProfile, hot_values, join_hot, join_on
from seqwarden.session import materialize


UNKNOWN_CONTEXT = False  # a context the model never saw expects nothing


def count_model(samples: DataFrame, key: str) -> DataFrame:
    """Occurrences of every (context, next key) pair."""
    return samples.groupBy("ctx", F.col(key).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def with_suffixes(counts: DataFrame) -> DataFrame:
    """Add the counts of every shorter context, down to the empty one.

    Runs on the already counted pairs, so each event is expanded at most once per
    distinct (context, next key), not once per row.
    """
    width = F.size("ctx")
    suffix = F.explode(F.transform(F.sequence(F.lit(0), width), lambda n: F.slice("ctx", width - n + 1, n)))
    return (
        counts.withColumn("_suffix", suffix)
        .groupBy(F.col("_suffix").alias("ctx"), "target")
        .agg(F.sum("n").alias("n"))
    )


def merge_models(*models: DataFrame) -> DataFrame:
    """Continue training: counts are additive."""
    merged = models[0]
    for other in models[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("ctx", "target").agg(F.sum("n").alias("n"))


def prune(model: DataFrame, min_support: int) -> DataFrame:
    """Drop pairs seen fewer than ``min_support`` times."""
    return model.filter(F.col("n") >= min_support)


def capped_k(k: int, num_keys: Column | int) -> Column:
    num_keys = num_keys if isinstance(num_keys, Column) else F.lit(num_keys)
    return F.least(F.lit(k), num_keys)


def rank_next_keys(model: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent next keys per context with their rank."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    order = Window.partitionBy("ctx").orderBy(F.desc("n"), F.asc("target"))
    return model.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_table(model: DataFrame, k: int) -> DataFrame:
    """One row per context: its top keys, best first, as an array of at most ``k``."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "target")))
    ranked = rank_next_keys(model, k)
    return ranked.groupBy("ctx").agg(F.transform(ordered, lambda e: e["target"]).alias("top"))


def check_key_range(df: DataFrame, key: str, num_keys: int) -> None:
    """Refuse keys the model was never sized for."""
    top = df.agg(F.coalesce(F.max(key), F.lit(-1)).alias("m")).first().m
    if top >= num_keys:
        raise ValueError(
            f"stale model: the data holds log key {top} but the model covers 0..{num_keys - 1}; retrain it"
        )


def detect(
    df: DataFrame,
    model: DataFrame,
    session: Sequence[str],
    seq: str,
    key: str,
    width: int,
    k: int = 9,
    backoff: bool = False,
    profile: KeyProfile | None = None,
    num_keys: int | None = None,
    all_rows: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Scored rows (``seq >= width``) with ``flag``: the key is outside the top ``k``.

    Earlier rows cannot be predicted; ``all_rows`` keeps them as normal. With
    ``backoff`` the longest context suffix known to the model ranks first, and shorter
    ones fill the places it leaves open; without, an unknown context is an anomaly.
    A ``k`` that covers all ``num_keys`` keys flags only keys outside of the vocabulary: a key
    that is null, negative or too large is never expected.
    """
    samples = context_windows(df, session, seq, key, width, profile, full_only=not all_rows)
    scored = F.col(seq) >= width
    known = F.coalesce(F.col(key) >= 0, F.lit(False))
    if num_keys is not None:
        known = known & F.coalesce(F.col(key) < num_keys, F.lit(False))
        if k >= num_keys:
            warnings.warn(f"k={k} covers all {num_keys} keys, so only unknown keys can be flagged", stacklevel=2)
            return samples.withColumn("flag", scored & ~known)
    # written once: training is not repeated, and Spark broadcasts the table only if its files are small
    if backoff:
        found = _hits_with_backoff(samples, samples.filter(scored), filled_lists(model, k, width), key, width, rows_per_task)
    else:
        top = materialize(top_k_table(model, k), "top")
        hot = hot_values(samples.groupBy("ctx").agg(F.count(F.lit(1)).alias("_n")), ["ctx"], rows_per_task=rows_per_task) if _may_be_hot(profile, rows_per_task) else None
        found = join_hot(samples, top, ["ctx"], hot, "left").withColumn("_hit", F.array_contains("top", F.col(key))).drop("top")
    return found.withColumn("flag", scored & ~(known & F.coalesce("_hit", F.lit(False)))).drop("_hit")


def filled_lists(model: DataFrame, k: int, width: int) -> DataFrame:
    """(len, ctx, top): the top keys of every context, with those of its shorter suffixes in the places it leaves open.

    Needs a model with all suffixes (``with_suffixes``, pruned by support or not). Contexts of one length are joined to the finished lists
    of the next shorter one, so each context is moved twice in all.
    """
    lists = materialize(top_k_table(model, k).withColumn("len", F.size("ctx")), "top")
    done = lists.filter("len = 0").select("len", "ctx", "top")
    filled = [done]
    for n in range(1, width + 1):
        shorter = filled[-1].select(F.col("ctx").alias("_suffix"), F.col("top").alias("_more"))
        own = lists.filter(F.col("len") == n).withColumn("_suffix", F.slice("ctx", 2, n - 1))
        both = F.slice(F.array_distinct(F.concat("top", F.coalesce("_more", F.array().cast(lists.schema["top"].dataType)))), 1, k)
        filled.append(materialize(own.join(shorter, "_suffix", "left").select("len", "ctx", both.alias("top")), "filled"))
    out = filled[0]
    for part in filled[1:]:
        out = out.unionByName(part)
    return out


def suffix_hashes(width: int) -> Column:
    """Hashes of the suffixes of ``ctx`` of length 0 to ``width``, each from the one before in one pass."""
    ids = F.transform(F.reverse(F.coalesce("ctx", F.array())), lambda c: F.xxhash64(c))
    start = F.array(F.lit(0).cast("long"))
    step = lambda done, h: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), h)))
    return F.aggregate(ids, start, step)


def search_lengths(width: int) -> list[list[int]]:
    """The lengths that a binary search over 0 to ``width`` asks for in each round; each length is asked in one round only."""
    spans, rounds = [(0, width)], []
    while spans := [s for s in spans if s[0] < s[1]]:
        rounds.append([(a + b + 1) // 2 for a, b in spans])
        spans = [half for a, b in spans for m in [(a + b + 1) // 2] for half in ((a, m - 1), (m, b))]
    return rounds


def longest_known(pairs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """``pairs`` (with ``ctx`` of ``width`` keys) and ``_len``: the length of the longest suffix that ``known`` (len, ctx) holds.

    If a context is known so are its suffixes; therefore a binary search finds the length with one row for each pair and
    round, about log2(width) in all. A round joins on the hash of the middle suffix and on the suffix itself, and reads
    only contexts of the lengths it asks for.
    """
    index = known.select(F.col("len").alias("_l"), F.col("ctx").alias("_c"), F.element_at(suffix_hashes(width), -1).alias("_h"))
    out = pairs.withColumn("_hashes", suffix_hashes(width)).withColumn("_low", F.lit(0)).withColumn("_high", F.lit(width))
    for lengths in search_lengths(width):
        middle = F.floor((F.col("_low") + F.col("_high") + 1) / 2).cast("int")
        searching = F.col("_low") < F.col("_high")
        out = out.withColumn("_mid", F.when(searching, middle)).withColumn("_hash", F.get("_hashes", F.col("_mid")))
        out = out.withColumn("_part", F.slice("ctx", F.lit(width) - F.col("_mid") + 1, F.col("_mid")))
        asked = index.filter(F.col("_l").isin(lengths))
        same = (F.col("_hash") == F.col("_h")) & (F.col("_mid") == F.col("_l")) & (F.col("_part") == F.col("_c"))
        out = out.join(asked, same, "left").drop("_h", "_c")
        found = F.col("_l").isNotNull()
        out = out.withColumn("_low", F.when(found, F.col("_mid")).otherwise(F.col("_low"))).withColumn(
            "_high", F.when(searching & ~found, F.col("_mid") - 1).otherwise(F.col("_high"))
        )
        out = out.drop("_l", "_mid", "_hash", "_part")
    return out.withColumnRenamed("_low", "_len").drop("_high", "_hashes")


def _may_be_hot(profile: KeyProfile | None, rows_per_task: int) -> bool:
    """A table that fits into one task has no hot value."""
    return profile is None or profile.n_rows > rows_per_task


def _hits_with_backoff(samples: DataFrame, scored: DataFrame, filled: DataFrame, key: str, width: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    # decided once per distinct (context, key); the suffixes never multiply the event rows
    sizes = materialize(scored.groupBy("ctx", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    pairs = sizes.select("ctx", "_key")
    lengths = longest_known(pairs, filled.select("len", "ctx"), width)
    lengths = lengths.withColumn("_suffix", F.slice("ctx", F.lit(width) - F.col("_len") + 1, F.col("_len")))
    lists = filled.select(F.col("ctx").alias("_suffix"), "top")
    hits = lengths.join(lists, "_suffix").withColumn("_hit", F.array_contains("top", F.col("_key")))
    hot = hot_values(sizes.select("ctx", F.col("_key").alias(key), "_n"), ["ctx", key], rows_per_task=rows_per_task)
    return join_hot(samples, hits.select("ctx", F.col("_key").alias(key), "_hit"), ["ctx", key], hot, "left")


def longest_known_by_row(rows: DataFrame, model: DataFrame, width: int, k: int) -> DataFrame:
    """``rows`` with ``top``, the filled list of the longest known suffix of ``ctx``: one lookup for each length, for streams."""
    filled = materialize(filled_lists(model, k, width), "lists")
    out, found = rows, []
    for n in range(width, -1, -1):
        lists = filled.filter(F.col("len") == n).select(F.col("ctx").alias(f"_c{n}"), F.col("top").alias(f"_t{n}"))
        part = F.slice("ctx", F.size("ctx") - n + 1, n)
        out = out.withColumn("_part", F.when(F.size("ctx") >= n, part)).join(lists, F.col("_part") == F.col(f"_c{n}"), "left")
        found.append(f"_t{n}")
    return out.select(*rows.columns, F.coalesce(*found).alias("top"))


def with_all_rows(df: DataFrame, scored: DataFrame, session: Sequence[str], seq: str) -> DataFrame:
    """Flags for every event: the first ``width`` of a session are normal."""
    on = [*session, seq]
    joined = join_on(df, scored.select(*on, F.col("flag").alias("_flag")), on, "left")
    return joined.select(*df.columns, F.coalesce("_flag", F.lit(False)).alias("flag"))


def predicted_anti_join(df_scored: DataFrame, model: DataFrame, key: str, k: int) -> DataFrame:
    """The anomalous rows alone: scored rows without a partner among the ranked next keys."""
    ranked = rank_next_keys(model, k).select("ctx", F.col("target").alias(key))
    return df_scored.join(ranked, ["ctx", key], "left_anti")


def anomaly_totals(flags: DataFrame, session: Sequence[str]) -> DataFrame:
    """Scored rows, flagged rows and sessions with a flag."""
    per_session = flags.groupBy(*session).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("flag").alias("_f")
    )
    return per_session.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_scored"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("n_flagged"),
        F.count_if(F.col("_f") > 0).alias("n_sessions_flagged"),
    )


def session_ratios(flags: DataFrame, session: Sequence[str]) -> DataFrame:
    """Flagged share per session over all of its events."""
    return flags.groupBy(*session).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if("flag").alias("n_flagged"),
        F.avg(F.col("flag").cast("double")).alias("ratio"),
    )


def vocabulary_stats(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys and the largest key, -1 when there is none."""
    return df.groupBy(key).agg(F.lit(1).alias("_one")).agg(
        F.count(F.lit(1)).alias("num_keys"), F.coalesce(F.max(key), F.lit(-1)).alias("max_key")
    )


Scorer = Callable[[np.ndarray], np.ndarray]


def score_with(samples: DataFrame, scorer: Scorer, key: str) -> DataFrame:
    """Flag with a user's batch function: contexts ``(n, width)`` in, top keys ``(n, k)`` out."""
    schema = T.StructType([*samples.schema.fields, T.StructField("flag", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                top = np.asarray(scorer(np.stack(batch["ctx"].to_numpy())))
                hit = (top == batch[key].to_numpy()[:, None]).any(axis=1)
            else:
                hit = np.zeros(0, dtype=bool)
            yield batch.assign(flag=~hit)

    return samples.mapInPandas(run, schema)


def first_order_scorer(model: DataFrame, num_keys: int, k: int, max_keys: int = 2_000) -> Scorer:
    """A scorer from the last key only; its table has ``num_keys`` x ``k`` cells, so its size is known."""
    if num_keys > max_keys:
        raise ValueError(f"{num_keys} keys are too many for an in-memory transition table")
    last = F.element_at("ctx", -1)
    pairs = model.groupBy(F.array(last).alias("ctx"), "target").agg(F.sum("n").alias("n"))
    table = np.full((num_keys, k), -1, dtype=np.int64)
    for row in rank_next_keys(pairs, k).select(F.element_at("ctx", 1).alias("c"), "target", "rank").collect():
        table[row.c, row["rank"] - 1] = row.target
    return lambda contexts: table[contexts[:, -1].astype(np.int64)]


def detect_first_order(samples: DataFrame, model: DataFrame, key: str, k: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The flags of :func:`first_order_scorer` for any number of keys: the table of last keys is joined and never collected."""
    last = F.element_at("ctx", -1)
    lists = top_k_table(model.groupBy(F.array(last).alias("ctx"), "target").agg(F.sum("n").alias("n")), k)
    lists = materialize(lists.select(F.element_at("ctx", 1).alias("_last"), "top"), "lists")
    rows = samples.withColumn("_last", last)
    hot = hot_values(rows.groupBy("_last").agg(F.count(F.lit(1)).alias("_n")), ["_last"], rows_per_task=rows_per_task)
    found = join_hot(rows, lists, ["_last"], hot, "left").withColumn("flag", ~F.coalesce(F.array_contains("top", F.col(key)), F.lit(False)))
    return found.select(*samples.columns, "flag")


def fit_regression(samples: DataFrame, key: str, width: int, num_keys: int, max_iter: int = 20):
    """Multinomial logistic regression on one-hot contexts, for vocabularies of a few hundred keys."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    if width * num_keys > 20_000:
        raise ValueError(f"{width} x {num_keys} one-hot columns are too many; use the count model")
    slots = [f"_k{i}" for i in range(width)]
    encoder = OneHotEncoder(
        inputCols=slots, outputCols=[f"{s}v" for s in slots], dropLast=False, handleInvalid="keep"
    )
    assembler = VectorAssembler(inputCols=[f"{s}v" for s in slots], outputCol="features")
    regression = LogisticRegression(
        featuresCol="features", labelCol="_label", family="multinomial", maxIter=max_iter, regParam=1e-4
    )
    return Pipeline(stages=[encoder, assembler, regression]).fit(context_slots(samples, key, width))


def context_slots(samples: DataFrame, key: str, width: int) -> DataFrame:
    slots = [F.element_at("ctx", i + 1).cast("double").alias(f"_k{i}") for i in range(width)]
    return samples.select("*", F.col(key).cast("double").alias("_label"), *slots)


def detect_with_regression(fitted, samples: DataFrame, key: str, width: int, k: int) -> DataFrame:
    """Flag keys that are not among the ``k`` most probable classes."""
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(context_slots(samples, key, width)).withColumn("_p", vector_to_array("probability"))
    own = F.try_element_at("_p", F.col(key).cast("int") + 1)
    # rank of the true key: classes with a higher probability, or the same one and a smaller number
    better = F.size(
        F.filter("_p", lambda p, i: (p > own) | ((p == own) & (i < F.col(key))))
    )
    return scored.withColumn("flag", F.coalesce(better >= k, F.lit(True))).select(*samples.columns, "flag")
