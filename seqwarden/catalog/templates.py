"""Masks, tokens, routes, mined and frozen templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwarden.adapter import audit_events, table
from seqwarden.catalog import Query
from seqwarden.catalog.sequences import EV, ORDER, SESSION
from seqwarden.fixed_values import MASK_PATTERNS
from seqwarden.functions.text import generalize, log_string, mask, pick, seconds_between, tokens, utc_time
from seqwarden.operators import sessions
from seqwarden.operators import templates as tm
from seqwarden.plans.skew import profile_keys, spread

PARTS = ("event_source", "event_name", "source_ip", "user_arn")

LOG = """coalesce(event_source, '') || ' ' || coalesce(event_name, '') || ' ' || coalesce(source_ip, '') || ' ' || coalesce(user_arn, '')"""
MASKED = LOG
for _pattern in MASK_PATTERNS:
    MASKED = f"regexp_replace({MASKED}, '{_pattern}', '<*>', 'g')"


def split_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda x: x <> '')"


TOK = f"""
log AS (SELECT *, {LOG} AS message FROM ev),
tok AS (SELECT *, {split_sql(MASKED)} AS t FROM log),
lf AS (SELECT *, len(t) AS n, array_to_string(t, ' ') AS msg,
  len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf FROM tok)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "ts", "user_id", "split", *PARTS)
    return spread(df).withColumn("message", log_string(*PARTS)).drop("event_source", "source_ip", "user_arn")


def positioned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = logs(spark, sf_dir)
    return sessions.with_positions(df, SESSION, ORDER, "seq", profile_keys(df, SESSION))


def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).select("ordinal", "message", mask("message").alias("masked"))


Q12 = f"WITH {EV} SELECT ordinal, {LOG} AS message, {MASKED} AS masked FROM ev"


def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = tokens(mask("message"))
    return logs(spark, sf_dir).select(
        "ordinal", F.size(split).alias("n_tokens"), F.array_join(split, "|").alias("tokens")
    )


Q13 = f"""WITH {EV}, {TOK} SELECT ordinal, CAST(n AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens FROM lf"""


def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    # addresses stay unmasked, so most nodes have more children than they may keep
    work = tm.with_message(logs(spark, sf_dir), "message", masked=False).select("_msg", F.col("ordinal").alias("_pos"))
    routed = tm.routed_messages(work, tm.MiningSpec(max_children=3))
    return routed.select(
        F.col("_msg").alias("message"), F.col("_leaf").alias("route"), F.col("_first").alias("first_pos"), F.col("_n").alias("n")
    )


Q14 = f"""WITH {EV}, m AS (SELECT array_to_string({split_sql(LOG)}, ' ') AS message, min(ordinal) AS f, count(*) AS n FROM ev GROUP BY 1),
s AS (SELECT *, string_split(message, ' ') AS t FROM m),
l0 AS (SELECT *, CAST(len(t) AS VARCHAR) AS r0 FROM s),
f1 AS (SELECT r0, t[1] AS k, row_number() OVER (PARTITION BY r0 ORDER BY min(f)) AS r FROM l0 GROUP BY 1, 2),
l1 AS (SELECT l0.*, r0 || ' ' || CASE WHEN r <= 3 THEN k ELSE '<*>' END AS r1 FROM l0 JOIN f1 USING (r0) WHERE f1.k = t[1]),
f2 AS (SELECT r1, t[2] AS k, row_number() OVER (PARTITION BY r1 ORDER BY min(f)) AS r FROM l1 GROUP BY 1, 2),
l2 AS (SELECT l1.*, r1 || ' ' || CASE WHEN r <= 3 THEN k ELSE '<*>' END AS r2 FROM l1 JOIN f2 USING (r1) WHERE f2.k = t[2]),
f3 AS (SELECT r2, t[3] AS k, row_number() OVER (PARTITION BY r2 ORDER BY min(f)) AS r FROM l2 WHERE len(t) >= 3 GROUP BY 1, 2)
SELECT message, CASE WHEN len(t) < 3 THEN l2.r2 ELSE l2.r2 || ' ' || CASE WHEN r <= 3 THEN k ELSE '<*>' END END AS route,
  f AS first_pos, n FROM l2 LEFT JOIN f3 ON f3.r2 = l2.r2 AND f3.k = t[3]"""


def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = tm.mine_templates(positioned_logs(spark, sf_dir), "message", ["user_id", "seq"])
    return mined.keys.select("ordinal", "key")


# every route holds messages that share at least half of their tokens: one cluster per route
VOCAB = """
r AS (SELECT leaf, min((user_id, seq)) AS f, count(*) AS size, count(DISTINCT msg) AS d, min(msg) AS a, any_value(t[1:3]) AS p
  FROM lf GROUP BY leaf),
v AS (SELECT *, row_number() OVER (ORDER BY f) - 1 AS key,
  CASE WHEN d = 1 THEN a ELSE array_to_string(p, ' ') || ' <*>' END AS template FROM r)"""
Q15 = f"WITH {EV}, {TOK}, {VOCAB} SELECT ordinal, CAST(v.key AS BIGINT) AS key FROM lf JOIN v USING (leaf)"


def q15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = tm.mine_templates(positioned_logs(spark, sf_dir), "message", ["user_id", "seq"])
    return mined.templates.select("key", "template", "size", "route")


Q15B = f"WITH {EV}, {TOK}, {VOCAB} SELECT CAST(key AS BIGINT) AS key, template, size, leaf AS route FROM v"


def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    mined = tm.mine_templates(lines, "text", ["doc_id", "line"], mint_empty=False)
    return mined.templates.select("key", "template", "size", "route")


def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = positioned_logs(spark, sf_dir)
    train = df.filter((F.col("split") == "train") & (F.col("event_name") != "CreateUser"))
    mined = tm.mine_templates(train, "message", ["user_id", "seq"])
    test = df.filter(F.col("split") == "test")
    return tm.apply_templates(test, "message", mined.templates).select("ordinal", "key")


Q17 = f"""WITH {EV}, {TOK.replace('lf AS', 'lf0 AS')},
lf AS (SELECT * FROM lf0 WHERE split = 'train' AND event_name <> 'CreateUser'), {VOCAB},
x AS (SELECT lf0.ordinal, v.key, list_sum(list_transform(list_zip(string_split(v.template, ' '), t),
   lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / n AS sim
  FROM lf0 LEFT JOIN v USING (leaf) WHERE lf0.split = 'test')
SELECT ordinal, CAST(CASE WHEN sim >= 0.4 THEN key ELSE -1 END AS BIGINT) AS key FROM x"""

def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against the one before it in its session: what both share, the third token or N/A, seconds between, and times that may not parse."""
    df = positioned_logs(spark, sf_dir)
    window = Window.partitionBy(*SESSION).orderBy("seq")
    own = tokens("message")
    before = F.lag(own).over(window)
    text = F.when(F.col("ordinal") % 5 == 0, F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = df.select("ordinal", own.alias("t"), before.alias("b"), F.col("ts").cast("timestamp").alias("ts"), F.lag(F.col("ts").cast("timestamp")).over(window).alias("p"), utc_time(text, strict=False).alias("read"))
    shared = F.when(F.size("t") == F.size("b"), F.array_join(generalize("b", "t"), " "))
    return rows.select(
        "ordinal", shared.alias("shared"), pick("t", 3, "N/A").alias("fourth"), F.round(seconds_between("ts", "p"), 6).alias("seconds"),
        F.col("read").isNotNull().alias("parsed"),
    )


Q43 = f"""WITH {EV}, t AS (SELECT ordinal, user_id, ts, seq, {split_sql(LOG)} AS t FROM ev),
w AS (SELECT *, lag(t) OVER s AS b, lag(ts) OVER s AS p FROM t WINDOW s AS (PARTITION BY user_id ORDER BY seq))
SELECT ordinal, CASE WHEN len(t) = len(b) THEN array_to_string(list_transform(b, lambda x, i: CASE WHEN x = t[i] THEN x ELSE '<*>' END), ' ') END AS shared,
  coalesce(t[4], 'N/A') AS fourth, round((epoch_us(ts) - epoch_us(p)) / 1e6, 6) AS seconds, ordinal % 5 <> 0 AS parsed FROM w"""


CLUSTERED = tm.MiningSpec(depth=2, threshold=0.6, max_children=2)


def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmasked logs: many clusters in a route, the third source in the wildcard route, templates that lose tokens."""
    mined = tm.mine_templates(logs(spark, sf_dir), "message", ["ordinal"], CLUSTERED, masked=False)
    return mined.keys.join(mined.templates, "key").select("ordinal", "key", "template", "size")


# one step of the recursion takes the next row of every route into that route's list of templates
Q40 = f"""WITH RECURSIVE {EV},
m AS (SELECT ordinal, {split_sql(LOG)} AS t FROM ev),
f AS (SELECT len(t) AS n, t[1] AS k, row_number() OVER (PARTITION BY len(t) ORDER BY min(ordinal)) AS r FROM m GROUP BY 1, 2),
r AS (SELECT ordinal, t, len(t) || ' ' || CASE WHEN r <= {CLUSTERED.max_children} THEN k ELSE '<*>' END AS leaf
  FROM m JOIN f ON f.n = len(t) AND f.k = t[1]),
x AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY ordinal) AS i FROM r),
fold AS (
  SELECT leaf, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[][]) AS c, CAST(0 AS BIGINT) AS chosen, CAST(0 AS BIGINT) AS ordinal FROM (SELECT DISTINCT leaf FROM x)
  UNION ALL
  SELECT leaf, i, CASE WHEN b IS NULL THEN list_append(c, t)
      ELSE list_transform(c, lambda v, j: CASE WHEN j = b THEN list_transform(v, lambda w, p: CASE WHEN w = t[p] THEN w ELSE '<*>' END) ELSE v END) END,
    CAST(coalesce(b, len(c) + 1) AS BIGINT), ordinal
  FROM (SELECT *, CASE WHEN list_max(e) / len(t) >= {CLUSTERED.threshold} THEN list_position(e, list_max(e)) END AS b
    FROM (SELECT fold.leaf, x.i, c, x.t, x.ordinal, list_transform(c, lambda v: list_sum(list_transform(v, lambda w, p: CASE WHEN w = x.t[p] THEN 1 ELSE 0 END))) AS e
      FROM fold JOIN x ON x.leaf = fold.leaf AND x.i = fold.i + 1))),
a AS (SELECT leaf, chosen, ordinal FROM fold WHERE i > 0),
k AS (SELECT leaf, chosen, row_number() OVER (ORDER BY min(ordinal)) - 1 AS key, count(*) AS size FROM a GROUP BY 1, 2),
z AS (SELECT leaf, max_by(c, i) AS c FROM fold GROUP BY leaf)
SELECT ordinal, CAST(key AS BIGINT) AS key, array_to_string(z.c[chosen], ' ') AS template, size FROM a JOIN k USING (leaf, chosen) JOIN z USING (leaf)"""

QUERIES = [
    Query("q12_mask_log", q12, Q12),
    Query("q13_tokens", q13, Q13),
    Query("q14_routes", q14, Q14),
    Query("q15_template_keys", q15, Q15),
    Query("q15_template_vocabulary", q15b, Q15B),
    Query("q16_templates_general", q16),
    Query("q17_apply_frozen", q17, Q17),
    Query("q40_template_clusters", q40, Q40),
    Query("q43_message_changes", q43, Q43),
]
