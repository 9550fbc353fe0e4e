"""Stored keys, templates and models, and the guards on them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.adapter import audit_events
from seqwarden.catalog import Query
from seqwarden.catalog.sequences import EV, SESSION, TOP, WIDTH, WIN, ctx_text, positioned, split_positions
from seqwarden.operators import model, prepare, sessions, windows
from seqwarden.session import scratch_dir
from seqwarden.sources import tables


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _refuses(guard, *args) -> bool:
    try:
        guard(*args)
    except (ValueError, KeyError):
        return True
    return False


def vocabulary(events: DataFrame) -> DataFrame:
    return events.select("key", F.concat("event_name", F.lit(" <*>")).alias("template")).distinct()


def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each guard on data it must accept and on data it must refuse."""
    events = audit_events(spark, sf_dir, "key", "event_name", "split")
    words = vocabulary(events)
    num_keys = model.vocabulary_stats(events, "key").first().num_keys
    same_count = words.withColumn("template", F.concat("template", F.lit(" x")))
    meta = {"num_keys": num_keys, "window_size": WIDTH, "vocab_fingerprint": tables.fingerprint(words)}
    counts = events.groupBy(F.array("key").alias("ctx"), F.col("key").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    results = {
        "key_range_ok": not _refuses(model.check_key_range, events, "key", num_keys),
        "key_range_stale": _refuses(model.check_key_range, events, "key", num_keys - 1),
        "vocabulary_ok": not _refuses(tables.require_same_vocabulary, meta, words),
        "vocabulary_changed": _refuses(tables.require_same_vocabulary, meta, same_count),
        "metadata_incomplete": _refuses(tables.save_model, counts, {"num_keys": num_keys}, _folder(spark, "model")),
        "fit_on_test_rows": _refuses(prepare.require_training_only, events),
        "fit_on_training_rows": not _refuses(prepare.require_training_only, events.filter(F.col("split") == "train")),
    }
    return events.agg(F.count(F.lit(1)).alias("n_events"), *[F.lit(v).alias(k) for k, v in results.items()])


Q29 = f"""WITH {EV} SELECT count(*) AS n_events, max(key) < count(DISTINCT key) AS key_range_ok,
max(key) >= count(DISTINCT key) - 1 AS key_range_stale, true AS vocabulary_ok, true AS vocabulary_changed,
true AS metadata_incomplete, bool_or(split <> 'train') AS fit_on_test_rows, bool_or(split = 'train') AS fit_on_training_rows FROM ev"""


def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form keys and templates written, read back, and exported as one sequence per session."""
    df, _ = positioned(spark, sf_dir, "event_name")
    keys_path, words_path = _folder(spark, "keys"), _folder(spark, "templates")
    tables.save_table(df.select("user_id", "seq", "key", "split"), keys_path, ["split"])
    tables.save_table(vocabulary(df), words_path)
    keys, words = tables.load_table(spark, keys_path), tables.load_table(spark, words_path)
    text = F.array_join(F.transform("keys", lambda k: k.cast("string")), " ")
    sequences = sessions.key_sequences(keys, SESSION, "seq", "key").select("user_id", text.alias("keys"))
    return sequences.withColumn("num_keys", F.lit(words.count()).cast("long"))


Q36 = f"""WITH {EV} SELECT user_id, string_agg(CAST(key AS VARCHAR), ' ' ORDER BY seq) AS keys,
(SELECT count(DISTINCT key) FROM ev) AS num_keys FROM ev GROUP BY user_id"""


def q36b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model written with its metadata, loaded with defaults, and continued with the same counts."""
    train, _, profile = split_positions(spark, sf_dir)
    counts = model.count_model(windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile), "key")
    words = vocabulary(audit_events(spark, sf_dir, "key", "event_name"))
    path = _folder(spark, "model")
    meta = {"num_keys": words.count(), "window_size": WIDTH, "vocab_fingerprint": tables.fingerprint(words)}
    tables.save_model(counts, meta, path)
    loaded, meta = tables.load_model(spark, path)
    tables.require_same_vocabulary(meta, words)
    twice = model.merge_models(loaded, loaded)
    return twice.select(
        ctx_text().alias("ctx"), "target", "n",
        *[F.lit(meta[m]).cast("long").alias(m) for m in ("num_keys", "window_size", "top_k")],
    )


Q36B = f"""WITH {EV}, {WIN}, {TOP} SELECT c1 || ',' || c2 || ',' || c3 AS ctx, key AS target, 2 * n AS n,
(SELECT count(DISTINCT key) FROM ev) AS num_keys, CAST(3 AS BIGINT) AS window_size, CAST(9 AS BIGINT) AS top_k FROM cnt"""

QUERIES = [
    Query("q29_guards", q29, Q29),
    Query("q36_key_artifacts", q36, Q36),
    Query("q36_model_artifacts", q36b, Q36B),
]
