"""Sessions, windows, next-key model and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.adapter import audit_events, audit_sql, table
from seqwarden.catalog import Query
from seqwarden.operators import evaluate, model, sessions, softmax, windows
from seqwarden.plans.skew import profile_keys
from seqwarden.session import materialize

SESSION = ["user_id"]
ORDER = ["ts", "ordinal"]
WIDTH = 3
K = 2

# the positions every check query builds on
EV = f"""
base AS ({audit_sql('ordinal', 'ts', 'user_id', 'key', 'split', 'event_name', 'source_ip', 'user_arn', 'event_source')}),
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, ordinal) - 1 AS seq FROM base)"""
WIN = """
win AS (SELECT * FROM (
  SELECT *, lag(key, 3) OVER w AS c1, lag(key, 2) OVER w AS c2, lag(key, 1) OVER w AS c3
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE seq >= 3)"""
TOP = """
cnt AS (SELECT c1, c2, c3, key, count(*) AS n FROM win WHERE split = 'train' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY n DESC, key) AS rank FROM cnt)"""
FLAGS = """
flags AS (SELECT w.*, rk.key IS NULL AS flag FROM win w
  LEFT JOIN rk ON rk.c1 = w.c1 AND rk.c2 = w.c2 AND rk.c3 = w.c3 AND rk.key = w.key AND rk.rank <= 2
  WHERE w.split = 'test')"""
CTX = "c1 || ',' || c2 || ',' || c3"


def positioned(spark: SparkSession, sf_dir: str, *extra: str):
    """Events with their session position, and the key profile that later steps reuse."""
    columns = dict.fromkeys(["ordinal", "ts", "user_id", "key", "split", *extra])
    df = audit_events(spark, sf_dir, *columns)
    profile = profile_keys(df, SESSION)
    return sessions.with_positions(df, SESSION, ORDER, "seq", profile), profile


def split_positions(spark: SparkSession, sf_dir: str, *extra: str):
    """Training and test events with positions. A session lies in one split, so the split is
    taken before the shuffle and each side moves only its own rows."""
    columns = dict.fromkeys(["ordinal", "ts", "user_id", "key", "split", *extra])
    df = audit_events(spark, sf_dir, *columns)
    profile = profile_keys(df, SESSION)
    train, test = (
        sessions.with_positions(df.filter(F.col("split") == s), SESSION, ORDER, "seq", profile)
        for s in ("train", "test")
    )
    return train, test, profile


def ctx_text(column: str = "ctx"):
    return F.array_join(F.transform(column, lambda k: k.cast("string")), ",")


def train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, profile = split_positions(spark, sf_dir)
    return model.count_model(windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile), "key")


def flagged(spark: SparkSession, sf_dir: str, *extra: str, k: int = K, backoff: bool = False) -> DataFrame:
    train, test, profile = split_positions(spark, sf_dir, *extra)
    counts = model.count_model(windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile), "key")
    if backoff:
        counts = model.with_suffixes(counts)
    return model.detect(test, counts, SESSION, "seq", "key", WIDTH, k, backoff, profile)


def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "ts", "source_ip", "user_arn")
    out = sessions.assign_sessions(df, ["source_ip", "user_arn", "absent_column"], ORDER, "session_id", "seq")
    return sessions.order_for_output(out, "ts").select("session_id", "seq", "ordinal")


Q01 = f"""WITH {EV},
f AS (SELECT *, first_value(ts) OVER s AS ft, first_value(ordinal) OVER s AS fo,
        row_number() OVER s - 1 AS pos FROM ev
      WINDOW s AS (PARTITION BY source_ip, user_arn ORDER BY ts, ordinal))
SELECT CAST(dense_rank() OVER (ORDER BY ft, fo) - 1 AS BIGINT) AS session_id,
       CAST(pos AS BIGINT) AS seq, ordinal FROM f"""


def q01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of the key columns is there: one session over all events, cut into pieces of bounded size."""
    df = audit_events(spark, sf_dir, "ordinal", "ts")
    out = sessions.assign_sessions(df, ["absent_column", "another_one"], ORDER, "session_id", "seq", rows_per_task=300)
    return out.select("session_id", "seq", "ordinal")


Q01B = f"""WITH {EV} SELECT CAST(0 AS BIGINT) AS session_id, row_number() OVER (ORDER BY ts, ordinal) - 1 AS seq, ordinal FROM ev"""


def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ts", "source_ip", "user_arn")
    return sessions.summarize_sessions(df, ["source_ip", "user_arn"], "ts")


Q02 = f"""WITH {EV} SELECT source_ip, user_arn, count(*) AS n_events, min(ts) AS first_time, max(ts) AS last_time
FROM ev GROUP BY source_ip, user_arn"""


def q02b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ts", "source_ip", "user_arn")
    per_session = sessions.summarize_sessions(df, ["source_ip", "user_arn"], "ts")
    return per_session.agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_events").alias("n_events"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


Q02B = f"""WITH {EV}, s AS (SELECT source_ip, user_arn, count(*) AS n, min(ts) AS a, max(ts) AS b FROM ev GROUP BY ALL)
SELECT count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, min(a) AS first_time, max(b) AS last_time FROM s"""


def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, profile = positioned(spark, sf_dir)
    out = windows.context_windows(df, SESSION, "seq", "key", WIDTH, profile)
    return out.select("user_id", "seq", ctx_text().alias("ctx"), "key")


Q05 = f"WITH {EV}, {WIN} SELECT user_id, CAST(seq AS BIGINT) AS seq, {CTX} AS ctx, key FROM win"


def q05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_count(audit_events(spark, sf_dir, "user_id"), SESSION, WIDTH)


Q05B = """SELECT CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS n_samples
FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"""


def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_counts(spark, sf_dir).select(ctx_text().alias("ctx"), "target", "n")


Q06 = f"WITH {EV}, {WIN}, {TOP} SELECT {CTX} AS ctx, key AS target, n FROM cnt"


def q06b(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = model.with_suffixes(train_counts(spark, sf_dir))
    return counts.select(ctx_text().alias("ctx"), "target", "n")


SUFFIXES = """
sfx AS (SELECT c1 || ',' || c2 || ',' || c3 AS ctx, 3 AS len, key FROM win WHERE split = 'train'
  UNION ALL SELECT c2 || ',' || c3, 2, key FROM win WHERE split = 'train'
  UNION ALL SELECT CAST(c3 AS VARCHAR), 1, key FROM win WHERE split = 'train'
  UNION ALL SELECT '', 0, key FROM win WHERE split = 'train'),
scnt AS (SELECT ctx, len, key, count(*) AS n FROM sfx GROUP BY ALL),
srk AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, key) AS rank FROM scnt)"""
Q06B = f"WITH {EV}, {WIN}, {SUFFIXES} SELECT ctx, key AS target, n FROM scnt"


def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = model.rank_next_keys(train_counts(spark, sf_dir), K)
    return ranked.select(ctx_text().alias("ctx"), "target", "n", "rank")


Q07 = f"""WITH {EV}, {WIN}, {TOP}
SELECT {CTX} AS ctx, key AS target, n, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 2"""


def q07b(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = model.vocabulary_stats(audit_events(spark, sf_dir, "key"), "key")
    return stats.withColumn("effective_k", model.capped_k(9, F.col("num_keys")))


Q07B = f"""WITH {EV} SELECT count(DISTINCT key) AS num_keys, max(key) AS max_key,
least(9, count(DISTINCT key)) AS effective_k FROM ev"""


def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("user_id", "seq", "key", "flag")


Q08 = f"WITH {EV}, {WIN}, {TOP}, {FLAGS} SELECT user_id, CAST(seq AS BIGINT) AS seq, key, flag FROM flags"


def q08b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.anomaly_totals(flagged(spark, sf_dir), SESSION)


Q08B = f"""WITH {EV}, {WIN}, {TOP}, {FLAGS}
SELECT count(*) AS n_scored, count(*) FILTER (WHERE flag) AS n_flagged,
       count(DISTINCT CASE WHEN flag THEN user_id END) AS n_sessions_flagged FROM flags"""


def q08c(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, profile = split_positions(spark, sf_dir)
    counts = model.count_model(windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile), "key")
    samples = windows.context_windows(test, SESSION, "seq", "key", WIDTH, profile)
    return model.predicted_anti_join(samples, counts, "key", K).select("user_id", "seq", "key")


Q08C = f"""WITH {EV}, {WIN}, {TOP}, {FLAGS}
SELECT user_id, CAST(seq AS BIGINT) AS seq, key FROM flags WHERE flag"""


def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pairs seen at least twice only, so that some contexts do fall back
    train, test, profile = split_positions(spark, sf_dir)
    samples = windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile)
    counts = model.prune(model.with_suffixes(model.count_model(samples, "key")), 2)
    out = model.detect(test, counts, SESSION, "seq", "key", WIDTH, 1, True, profile)
    return out.select("user_id", "seq", "key", "flag")


Q09 = f"""WITH {EV}, {WIN}, {SUFFIXES},
top AS (SELECT ctx, len, key FROM srk WHERE rank = 1 AND n >= 2),
t AS (SELECT * FROM win WHERE split = 'test')
SELECT t.user_id, CAST(t.seq AS BIGINT) AS seq, t.key,
       t.key IS DISTINCT FROM coalesce(t3.key, t2.key, t1.key, t0.key) AS flag
FROM t
LEFT JOIN top t3 ON t3.len = 3 AND t3.ctx = c1 || ',' || c2 || ',' || c3
LEFT JOIN top t2 ON t2.len = 2 AND t2.ctx = c2 || ',' || c3
LEFT JOIN top t1 ON t1.len = 1 AND t1.ctx = CAST(c3 AS VARCHAR)
LEFT JOIN top t0 ON t0.len = 0"""


def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        (F.col("toxic") == 1).alias("predicted"), (F.col("quality") == 0).alias("truth")
    )
    return evaluate.evaluate(labels).select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "tp", "fp", "fn", "tn"
    )


EVAL = """
c AS (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
  count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn FROM x),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM c)
SELECT round(CAST(pr AS DOUBLE), 9) AS precision, round(CAST(re AS DOUBLE), 9) AS recall,
  round(CAST(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS DOUBLE), 9) AS f1,
  round(CAST((tp + tn) / (tp + fp + fn + tn) AS DOUBLE), 9) AS accuracy, tp, fp, fn, tn FROM m"""
Q11 = f"WITH x AS (SELECT toxic = 1 AS p, quality = 0 AS t FROM labels), {EVAL}"


def q11b(spark: SparkSession, sf_dir: str) -> DataFrame:
    # flags at k=1 against flags at k=2 as the truth, joined on (session, position)
    left = flagged(spark, sf_dir, k=1).select("user_id", "seq", F.col("flag").alias("predicted"))
    right = flagged(spark, sf_dir, k=2).select("user_id", "seq", F.col("flag").alias("truth"))
    joined = evaluate.align(left, right, ["user_id", "seq"])
    return evaluate.evaluate(joined).select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "tp", "fp", "fn", "tn"
    )


Q11B = f"""WITH {EV}, {WIN}, {TOP}, x AS (SELECT r1.key IS NULL AS p, r2.key IS NULL AS t FROM win w
  LEFT JOIN rk r1 ON r1.c1 = w.c1 AND r1.c2 = w.c2 AND r1.c3 = w.c3 AND r1.key = w.key AND r1.rank <= 1
  LEFT JOIN rk r2 ON r2.c1 = w.c1 AND r2.c2 = w.c2 AND r2.c3 = w.c3 AND r2.key = w.key AND r2.rank <= 2
  WHERE w.split = 'test'), {EVAL}"""


def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "system", 1).otherwise(2)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", roles.alias("key"))
    profile = profile_keys(turns, ["conv_id"])
    df = sessions.with_positions(turns, ["conv_id"], ["turn"], "seq", profile)
    samples = windows.context_windows(df, ["conv_id"], "seq", "key", 2, profile)
    ranked = model.rank_next_keys(model.count_model(samples, "key"), 2)
    return ranked.select(ctx_text().alias("ctx"), "target", "n", "rank")


Q25 = """WITH ev AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS key
  FROM conversations),
w AS (SELECT lag(key, 2) OVER s AS a, lag(key, 1) OVER s AS b, key, row_number() OVER s AS rn FROM ev
  WINDOW s AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT a || ',' || b AS ctx, key AS target, count(*) AS n FROM w WHERE rn > 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, target) AS rank FROM c)
SELECT ctx, target, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""


def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, profile = split_positions(spark, sf_dir)
    samples = windows.context_windows(train, SESSION, "seq", "key", WIDTH, profile)
    halves = [model.count_model(samples.filter(F.col("ordinal") % 2 == r), "key") for r in (0, 1)]
    return model.merge_models(*halves).select(ctx_text().alias("ctx"), "target", "n")


Q28 = Q06


def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, profile = split_positions(spark, sf_dir)
    train, test = (windows.context_windows(s, SESSION, "seq", "key", WIDTH, profile) for s in sides)
    fitted = model.fit_regression(train, "key", WIDTH, num_keys=5)
    flags = model.detect_with_regression(fitted, test, "key", WIDTH, K)
    return flags.select("user_id", "seq", "key", "flag")


def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    *sides, profile = split_positions(spark, sf_dir)
    train, test = (windows.context_windows(s, SESSION, "seq", "key", WIDTH, profile) for s in sides)
    scorer = model.first_order_scorer(model.count_model(train, "key"), num_keys=5, k=K)
    return model.score_with(test.select("user_id", "seq", "key", "ctx"), scorer, "key").drop("ctx")


def q31b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same flags from a joined table of last keys."""
    *sides, profile = split_positions(spark, sf_dir)
    train, test = (windows.context_windows(s, SESSION, "seq", "key", WIDTH, profile) for s in sides)
    flags = model.detect_first_order(test.select("user_id", "seq", "key", "ctx"), model.count_model(train, "key"), "key", K)
    return flags.drop("ctx")


def q30b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A softmax in two levels, fitted on all training windows: rows, whether it fits better than key frequencies, and test rows scored."""
    *sides, profile = split_positions(spark, sf_dir)
    train, test = (windows.context_windows(s, SESSION, "seq", "key", WIDTH, profile) for s in sides)
    counts = materialize(model.count_model(train, "key"), "counts")
    fitted = softmax.fit(counts, buckets=1 << 12)
    flags = softmax.detect(test.select("user_id", "seq", "key", "ctx"), fitted, "key", K)
    scored = flags.agg(F.count("flag").alias("n_scored")).withColumn("_one", F.lit(1))
    losses = softmax.log_losses(counts, fitted).select(F.lit(1).alias("_one"), "n_rows", (F.col("model_loss") < F.col("frequency_loss")).alias("fits_better"))
    return losses.join(scored, "_one").drop("_one")


Q30B = f"""WITH {EV}, {WIN} SELECT count(*) FILTER (WHERE split = 'train') AS n_rows, true AS fits_better,
count(*) FILTER (WHERE split = 'test') AS n_scored FROM win"""

Q31 = f"""WITH {EV}, {WIN},
c AS (SELECT c3, key, count(*) AS n FROM win WHERE split = 'train' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c3 ORDER BY n DESC, key) AS rank FROM c)
SELECT w.user_id, CAST(w.seq AS BIGINT) AS seq, w.key, r.key IS NULL AS flag FROM win w
LEFT JOIN r ON r.c3 = w.c3 AND r.key = w.key AND r.rank <= 2 WHERE w.split = 'test'"""

QUERIES = [
    Query("q01_sessionize", q01, Q01),
    Query("q01_no_session_keys", q01b, Q01B),
    Query("q02_session_summary", q02, Q02),
    Query("q02_session_totals", q02b, Q02B),
    Query("q05_sliding_windows", q05, Q05),
    Query("q05_sample_count", q05b, Q05B),
    Query("q06_next_key_counts", q06, Q06),
    Query("q06_suffix_counts", q06b, Q06B),
    Query("q07_topk_next", q07, Q07),
    Query("q07_capped_k", q07b, Q07B),
    Query("q08_detect", q08, Q08),
    Query("q08_anomaly_totals", q08b, Q08B),
    Query("q08_anomalies_anti_join", q08c, Q08C),
    Query("q09_detect_backoff", q09, Q09),
    Query("q11_evaluate_labels", q11, Q11),
    Query("q11_evaluate_flags", q11b, Q11B),
    Query("q25_conversation_windows", q25, Q25),
    Query("q28_merge_model", q28, Q28),
    Query("q30_regression_next_key", q30),
    Query("q30_softmax_fit", q30b, Q30B),
    Query("q31_pluggable_scorer", q31, Q31),
    Query("q31_joined_scorer", q31b, Q31),
]
