"""Context by position from bucketed tables, times and gaps, templates of neighbours, checks of tables that lack columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwarden.adapter import audit_events, audit_sql
from seqwarden.catalog import Query
from seqwarden.catalog.sequences import EV, FLAGS, SESSION, TOP, WIN, flagged, positioned
from seqwarden.functions.text import generalize, pick, seconds_between, similarity, utc_time
from seqwarden.operators import incidents, quality
from seqwarden.session import scratch_dir
from seqwarden.sources import position_tables

LAYOUT = position_tables.Layout(tuple(SESSION), "seq", buckets=8, block_rows=50)
BLOCKS = position_tables.Layout(tuple(SESSION), "seq", buckets=8, block_rows=50, whole_blocks=True)
BROWSER = "user_agent"


def _stored(spark: SparkSession, df: DataFrame, label: str, layout: position_tables.Layout = LAYOUT) -> DataFrame:
    name = f"{label}_{uuid.uuid4().hex}"
    return position_tables.save(df, name, f"{scratch_dir(spark)}/{name}", layout)


def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags with the context of their position; both sides are stored once, in buckets. Events without an agent have no context."""
    flags = _stored(spark, flagged(spark, sf_dir).select("user_id", "seq", "key", "flag"), "flags")
    context = positioned(spark, sf_dir, "event_name", "source_ip", BROWSER)[0].filter(F.col(BROWSER).isNotNull())
    context = _stored(spark, context.select("user_id", "seq", "event_name", "source_ip"), "context")
    joined = position_tables.join(flags, context, LAYOUT)
    return position_tables.with_missing(joined, ["event_name", "source_ip"], "N/A").drop(position_tables.BLOCK)


Q44 = f"""WITH {EV}, {WIN}, {TOP}, {FLAGS}
SELECT f.user_id, CAST(f.seq AS BIGINT) AS seq, f.key, f.flag,
  CASE WHEN f2.user_agent IS NULL THEN 'N/A' ELSE coalesce(f2.event_name, 'N/A') END AS event_name,
  CASE WHEN f2.user_agent IS NULL THEN 'N/A' ELSE coalesce(f2.source_ip, 'N/A') END AS source_ip
FROM flags f JOIN (SELECT e.*, p.user_agent FROM ev e JOIN ({audit_sql('ordinal', 'user_agent')}) p USING (ordinal)) f2 ON f2.ordinal = f.ordinal"""


def q44b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key sequences in blocks of positions."""
    stored = _stored(spark, positioned(spark, sf_dir)[0].select("user_id", "seq", "key"), "keys", BLOCKS)
    out = position_tables.sequences(stored, "key", BLOCKS)
    return out.select("user_id", "block", F.concat_ws(",", F.col("keys").cast("array<string>")).alias("keys"))


Q44B = f"""WITH {EV} SELECT user_id, CAST(seq // {LAYOUT.block_rows} AS BIGINT) AS block, string_agg(CAST(key AS VARCHAR), ',' ORDER BY seq) AS keys
FROM ev GROUP BY 1, 2"""


def q18d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same context by the plain join, for tables that are not stored in buckets."""
    context = positioned(spark, sf_dir, "event_name", "source_ip", BROWSER)[0].filter(F.col(BROWSER).isNotNull())
    flags = flagged(spark, sf_dir).select("user_id", "seq", "key", "flag")
    return incidents.with_context(flags, context, SESSION, "seq")


def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest gap between events of a session from time texts, some of which are no times; those are counted and skipped."""
    events = audit_events(spark, sf_dir, "user_id", "ordinal", "ts", BROWSER)
    text = F.when(F.col(BROWSER).isNull(), F.concat(F.lit("day "), F.col("ordinal"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    read = events.withColumn("time", utc_time(text, strict=False))
    order = Window.partitionBy("user_id").orderBy("time", "ordinal")
    gaps = read.withColumn("gap", seconds_between("time", F.lag("time").over(order)))
    return gaps.groupBy("user_id").agg(F.count_if(F.col("time").isNull()).alias("n_unread"), F.round(F.max("gap") * 1000).cast("long").alias("longest_ms"))


Q45 = f"""WITH e AS ({audit_sql('user_id', 'ordinal', 'ts', 'user_agent')}),
r AS (SELECT user_id, ordinal, CASE WHEN user_agent IS NOT NULL THEN ts END AS t FROM e),
g AS (SELECT user_id, t, epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY user_id ORDER BY t NULLS FIRST, ordinal)) AS gap FROM r)
SELECT user_id, count(*) FILTER (WHERE t IS NULL) AS n_unread, CAST(round(max(gap) / 1000.0) AS BIGINT) AS longest_ms FROM g GROUP BY user_id"""


def q45b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the identity by the event's key as index, ``N/A`` beyond the last part or without identity."""
    events = audit_events(spark, sf_dir, "user_arn", "key")
    part = pick(F.split("user_arn", "[:/]"), F.col("key") + 3, "N/A")
    return events.groupBy("key", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


Q45B = f"""WITH e AS ({audit_sql('user_arn', 'key')})
SELECT key, coalesce(regexp_split_to_array(user_arn, '[:/]')[key + 4], 'N/A') AS part, count(*) AS n FROM e GROUP BY 1, 2"""


def q45c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of neighbouring events: wildcards where they differ, and how alike they are, in thousandths."""
    events, _ = positioned(spark, sf_dir, "event_name", "event_source", BROWSER)
    words = events.withColumn("words", F.concat(F.array("event_name", "event_source"), F.split(F.coalesce(BROWSER, F.lit("no agent")), " ")))
    pairs = words.withColumn("before", F.lag("words").over(Window.partitionBy("user_id").orderBy("seq"))).filter("before IS NOT NULL")
    same = F.size("before") == F.size("words")
    shown = F.when(same, F.array_join(generalize("before", "words"), " "))
    alike = F.floor(similarity("before", "words") * 1000).cast("long")
    return pairs.groupBy(shown.alias("template"), alike.alias("alike")).agg(F.count(F.lit(1)).alias("n"))


Q45C = f"""WITH {EV}, agents AS ({audit_sql('ordinal', 'user_agent')}),
w AS (SELECT user_id, seq, event_name AS a, event_source AS b, coalesce(user_agent, 'no') AS c, CASE WHEN user_agent IS NULL THEN 'agent' END AS d FROM ev JOIN agents USING (ordinal)),
p AS (SELECT *, lag(a) OVER s AS a0, lag(b) OVER s AS b0, lag(c) OVER s AS c0, lag(d) OVER s AS d0 FROM w WINDOW s AS (PARTITION BY user_id ORDER BY seq)),
t AS (SELECT (d IS NULL) = (d0 IS NULL) AS same, d IS NOT NULL AS four, CASE WHEN a = a0 THEN a ELSE '<*>' END AS x, CASE WHEN b = b0 THEN b ELSE '<*>' END AS y,
  CASE WHEN c = c0 THEN c ELSE '<*>' END AS z, CAST(a = a0 AS INT) + CAST(b = b0 AS INT) + CAST(c = c0 AS INT) AS k FROM p WHERE a0 IS NOT NULL)
SELECT CASE WHEN same THEN x || ' ' || y || ' ' || z || CASE WHEN four THEN ' agent' ELSE '' END END AS template,
  CAST(CASE WHEN NOT same THEN 0 WHEN four THEN (k + 1) * 1000 // 4 ELSE k * 1000 // 3 END AS BIGINT) AS alike, count(*) AS n FROM t GROUP BY 1, 2"""


def q23d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a table without the columns that they need name what is missing; the rows that could not be checked are counted."""
    events = audit_events(spark, sf_dir, "ordinal", "ts", "source_ip")
    checks = [quality.check_time_order, quality.check_sessions]
    cols = quality.Columns(time="event_time", session="session_id", seq="seq")
    failed = quality.run_checks(events, [lambda df, check=check: check(df, cols) for check in checks], "events")
    rows = events.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("split", F.lit("events"))
    return failed.join(rows, "split").select("check", "passed", "n_bad", "detail", "n_rows")


Q23D = """SELECT * FROM (VALUES ('temporal order', false, CAST(1 AS BIGINT), 'missing columns: [''event_time'']'),
  ('session integrity', false, 3, 'missing columns: [''event_time'', ''seq'', ''session_id'']')) t("check", passed, n_bad, detail),
  (SELECT count(*) AS n_rows FROM events)"""

QUERIES = [
    Query("q44_position_context", q44, Q44),
    Query("q44_block_sequences", q44b, Q44B),
    Query("q18_position_context", q18d, Q44),
    Query("q45_session_gaps", q45, Q45),
    Query("q45_picked_parts", q45b, Q45B),
    Query("q45_neighbour_templates", q45c, Q45C),
    Query("q23_missing_columns", q23d, Q23D),
]
