"""Quality checks over events with faults put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.adapter import audit_events, audit_sql
from seqwarden.catalog import Query
from seqwarden.catalog.sequences import ORDER, SESSION
from seqwarden.operators import quality as q
from seqwarden.operators import sessions
from seqwarden.operators.prepare import NoiseSpec, SplitSpec
from seqwarden.plans.skew import profile_keys
from seqwarden.session import materialize

SPLIT = SplitSpec("user_type", "user_name")
NOISE = NoiseSpec((("user_agent", ("CloudMapper", "boto3")), ("invoked_by", ("amazonaws.com",))))
COLS = q.Columns("event_time", "ordinal", "user_id", "seq", "user_agent", "invoked_by", ("user_agent", "resources"))
BLOCK = 700  # small, so that the block seams are exercised


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with positions; some times fall, some positions skip, some cells look nested."""
    df = audit_events(
        spark, sf_dir, "ordinal", "ts", "user_id", "event_name", "user_type", "user_name", "user_agent", "invoked_by"
    )
    df = sessions.with_positions(df, SESSION, ORDER, "seq", profile_keys(df, SESSION))
    return df.select(
        "ordinal",
        "user_id",
        F.when(F.col("ordinal") % 1400 == 700, F.col("ts") - F.expr("INTERVAL 300 DAYS")).otherwise(F.col("ts")).alias("event_time"),
        F.when((F.col("user_id") % 10 == 3) & (F.col("seq") == 7), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"),
        F.when(F.col("ordinal") % 900 == 11, F.concat(F.lit(" {"), "event_name"))
        .when(F.col("ordinal") % 900 == 12, F.lit("[MOCK]"))
        .otherwise(F.col("event_name"))
        .alias("event_name"),
        "user_type",
        "user_name",
        "user_agent",
        "invoked_by",
    )


BAD = f"""b0 AS ({audit_sql('ordinal', 'ts', 'user_id', 'event_name', 'user_type', 'user_name', 'user_agent', 'invoked_by')}),
b AS (SELECT ordinal, user_id, CASE WHEN ordinal % 1400 = 700 THEN ts - INTERVAL 300 DAYS ELSE ts END AS event_time,
  CASE WHEN user_id % 10 = 3 AND rn = 8 THEN rn ELSE rn - 1 END AS seq,
  CASE WHEN ordinal % 900 = 11 THEN ' {{' || event_name WHEN ordinal % 900 = 12 THEN '[MOCK]' ELSE event_name END AS event_name,
  user_type, user_name, user_agent, invoked_by
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, ordinal) AS rn FROM b0))"""


def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the session table is stored before it is checked; each check reads only its columns
    df = materialize(faulty(spark, sf_dir), "sessions")
    checks = q.shared_checks(COLS, NOISE, BLOCK)
    train = q.run_checks(df, [*checks, lambda d: q.check_train_split(d, SPLIT, COLS)], "train")
    test = q.run_checks(df, [lambda d: q.check_test_split(d, SPLIT, COLS)], "test")
    return train.unionByName(test)


Q23 = f"""WITH {BAD},
inv AS (SELECT ordinal, event_time < lag(event_time) OVER (ORDER BY ordinal) AS falls FROM b),
ses AS (SELECT user_id, min(ordinal) AS start, bool_or(seq <> pos) AS bad_seq, coalesce(bool_or(falls), false) AS bad_time FROM (
  SELECT user_id, ordinal, seq, row_number() OVER w - 1 AS pos, event_time < lag(event_time) OVER w AS falls
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ordinal)) GROUP BY user_id),
st AS (SELECT (SELECT count(*) FROM ses WHERE bad_seq) AS ns, (SELECT count(*) FROM ses WHERE bad_time) AS nt,
  (SELECT string_agg(user_id, ', ' ORDER BY start) FROM (SELECT * FROM ses WHERE bad_seq ORDER BY start LIMIT 3)) AS es,
  (SELECT string_agg(user_id, ', ' ORDER BY start) FROM (SELECT * FROM ses WHERE bad_time ORDER BY start LIMIT 3)) AS et),
r AS (
  SELECT 'train' AS split, 'tabular structure' AS "check", 1 AS n_bad, '1 column(s) contain nested-looking values: event_name (e.g. '''
    || (SELECT arg_min(trim(event_name), ordinal) FROM b WHERE event_name LIKE ' {{%') || ''')' AS detail
  UNION ALL SELECT 'train', 'temporal order', count(*) FILTER (WHERE falls), 'first out-of-order row at index ' || min(ordinal) FILTER (WHERE falls) FROM inv
  UNION ALL SELECT 'train', 'null handling', 3, 'columns with NaN: user_name (' || count(*) FILTER (WHERE user_name IS NULL) || ' NaN), user_agent ('
    || count(*) FILTER (WHERE user_agent IS NULL) || ' NaN), invoked_by (' || count(*) FILTER (WHERE invoked_by IS NULL) || ' NaN)' FROM b
  UNION ALL SELECT 'train', 'noise filter', a + c + d, a || ' rows contain ''CloudMapper'' in user_agent; ' || c || ' rows contain ''boto3'' in user_agent; '
    || d || ' rows contain ''amazonaws.com'' in invoked_by' FROM (SELECT count(*) FILTER (WHERE regexp_matches(user_agent, 'cloudmapper', 'i')) AS a,
      count(*) FILTER (WHERE regexp_matches(user_agent, 'boto3', 'i')) AS c, count(*) FILTER (WHERE regexp_matches(invoked_by, 'amazonaws.com', 'i')) AS d FROM b)
  UNION ALL SELECT 'train', 'session integrity', ns + nt, ns || ' session(s) with non-sequential positions (e.g. [' || es || ']); '
    || nt || ' session(s) not sorted by time (e.g. [' || et || '])' FROM st
  UNION ALL SELECT 'train', 'train split', count(*), count(*) || ' non-Root rows; unique types: [' || (SELECT string_agg(user_type, ', ' ORDER BY o)
    FROM (SELECT user_type, min(ordinal) AS o FROM b WHERE user_type <> 'Root' GROUP BY 1 ORDER BY o LIMIT 5)) || ']' FROM b WHERE user_type <> 'Root'
  UNION ALL SELECT 'test', 'test split', count(*), count(*) || ' violating rows; types={{'
    || (SELECT string_agg(v || ': ' || c, ', ' ORDER BY c DESC, v) FROM (SELECT user_type AS v, count(*) AS c FROM b WHERE NOT ok GROUP BY 1 ORDER BY c DESC, v LIMIT 5))
    || '}}, users={{' || (SELECT string_agg(coalesce(v, 'null') || ': ' || c, ', ' ORDER BY c DESC, coalesce(v, 'null')) FROM
      (SELECT user_name AS v, count(*) AS c FROM b WHERE NOT ok GROUP BY 1 ORDER BY c DESC, v LIMIT 5)) || '}}' FROM b WHERE NOT ok)
SELECT split, "check", n_bad = 0 AS passed, CAST(n_bad AS BIGINT) AS n_bad, CASE WHEN n_bad > 0 THEN detail ELSE '' END AS detail FROM r"""
Q23 = Q23.replace("{{", "{").replace("}}", "}").replace(
    "user_agent, invoked_by\n  FROM (SELECT *, row_number()",
    "user_agent, invoked_by, (coalesce(user_name IN ('backup', 'Level6'), false) OR user_type = 'AssumedRole') AS ok\n  FROM (SELECT *, row_number()",
)


def q23b(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = q23(spark, sf_dir)
    clean = audit_events(spark, sf_dir, "ordinal", "ts").select("ordinal", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"))
    order = q.check_text_order(clean, "event_time", ["ordinal"], block_rows=BLOCK)
    return q.summary(results.unionByName(order.select(F.lit("raw").alias("split"), *q.RESULT)))


Q23B = f"""WITH {BAD}, o AS (SELECT count(*) FILTER (WHERE ts < p) AS n FROM (SELECT ts, lag(ts) OVER (ORDER BY ordinal) AS p FROM b0))
SELECT CAST(8 AS BIGINT) AS n_checks, CAST(CASE WHEN n = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_passed,
CAST(CASE WHEN n = 0 THEN 7 ELSE 8 END AS BIGINT) AS n_failed FROM o"""


def q23c(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = q.column_profile(faulty(spark, sf_dir), COLS)
    return profile.select("column", "n_nested", "n_null")


Q23C = f"WITH {BAD} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {'starts_with(trim(event_name), chr(123))' if c == 'event_name' else 'false'}) AS n_nested,
count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM b""".replace("{", "{{").replace("}", "}}")
    for c in ("event_name", "user_type", "user_name", "user_agent", "invoked_by")
)
Q23C = Q23C.replace("{{", "{").replace("}}", "}")

QUERIES = [
    Query("q23_quality_report", q23, Q23),
    Query("q23_quality_summary", q23b, Q23B),
    Query("q23_column_profile", q23c, Q23C),
]
