"""The stages put together on JSON events, from raw texts to flags."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.catalog import Query
from seqwarden.catalog.records import EV, IS_NOISE, raw_events
from seqwarden.catalog.templates import TOK, VOCAB
from seqwarden.fixed_values import UNKNOWN_SESSION
from seqwarden.functions.variant import field
from seqwarden.operators import prepare
from seqwarden.plans import flow
from seqwarden.session import materialize, scratch_dir
from seqwarden.sources import json_events

WIDTH = 2
# test users are named by type alone, so that no event is in both splits
SPLIT = prepare.SplitSpec(test_names=())


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = raw_events(spark, sf_dir).withColumn("source_file", F.lit("events"))
    return flow.session_tables(flow.flat_events(events), SPLIT)


def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _sessions(spark, sf_dir)
    own = [p.select("eventID", F.lit(name).alias("role"), "session_id", "seq") for name, p in (("train", train), ("test", test))]
    return own[0].unionByName(own[1])


SESSIONS = f"""
part AS (SELECT *, CASE WHEN user_type = 'Root' THEN 'train' ELSE 'test' END AS role,
  coalesce(source_ip, '{UNKNOWN_SESSION}') AS k1, coalesce(user_arn, '{UNKNOWN_SESSION}') AS k2
  FROM ev WHERE user_type IN ('Root', 'AssumedRole') AND NOT {IS_NOISE}),
firsts AS (SELECT role, k1, k2, row_number() OVER (PARTITION BY role ORDER BY min((ts, ordinal))) - 1 AS session_id FROM part GROUP BY 1, 2, 3),
pos AS (SELECT part.*, session_id, row_number() OVER (PARTITION BY role, k1, k2 ORDER BY ts, ordinal) - 1 AS seq
  FROM part JOIN firsts USING (role, k1, k2))"""
Q39 = f"""WITH {EV}, {SESSIONS}
SELECT ordinal AS "eventID", role, CAST(session_id AS BIGINT) AS session_id, CAST(seq AS BIGINT) AS seq FROM pos"""


def q39b(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _sessions(spark, sf_dir)
    fitted = flow.fit(train, WIDTH, test=test)
    return flow.flag_sessions(test, fitted, k=1).select("session_id", "seq", "key", "flag")


Q39B = f"""WITH {EV}, {SESSIONS}, {TOK.replace('FROM ev', 'FROM pos').replace('lf AS', 'lf0 AS')},
lf AS (SELECT * FROM lf0 WHERE role = 'train'), {VOCAB.replace('user_id', 'session_id')},
x AS (SELECT lf0.role, lf0.session_id, lf0.seq, v.key, n, list_sum(list_transform(list_zip(string_split(v.template, ' '), t),
   lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END)) / n AS sim FROM lf0 LEFT JOIN v USING (leaf)),
keyed AS (SELECT role, session_id, seq, CASE WHEN role = 'train' OR sim >= 0.4 THEN key ELSE -1 END AS key FROM x),
win AS (SELECT *, lag(key, 2) OVER w AS c1, lag(key) OVER w AS c2 FROM keyed WINDOW w AS (PARTITION BY role, session_id ORDER BY seq)),
seen AS (SELECT * FROM win WHERE role = 'train' AND seq >= {WIDTH}),
suffix AS (SELECT 2 AS len, c1 || ',' || c2 AS ctx, key FROM seen UNION ALL SELECT 1, CAST(c2 AS VARCHAR), key FROM seen UNION ALL SELECT 0, '', key FROM seen),
ranked AS (SELECT len, ctx, key, row_number() OVER (PARTITION BY len, ctx ORDER BY count(*) DESC, key) AS rank FROM suffix GROUP BY 1, 2, 3),
best AS (SELECT * FROM ranked WHERE rank = 1)
SELECT CAST(w.session_id AS BIGINT) AS session_id, CAST(w.seq AS BIGINT) AS seq, CAST(w.key AS BIGINT) AS key,
  w.seq >= {WIDTH} AND (w.key = -1 OR w.key IS DISTINCT FROM coalesce(b2.key, b1.key, b0.key)) AS flag
FROM win w LEFT JOIN best b2 ON b2.len = 2 AND b2.ctx = c1 || ',' || c2
LEFT JOIN best b1 ON b1.len = 1 AND b1.ctx = CAST(c2 AS VARCHAR) LEFT JOIN best b0 ON b0.len = 0
WHERE w.role = 'test'"""

def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on the flow's own tables in input order: sessions are whole, but times fall between sessions, and noise was kept."""
    events = raw_events(spark, sf_dir).withColumn("source_file", F.lit("events"))
    train, test = flow.session_tables(flow.flat_events(events), SPLIT, noise=None, by_time=False)
    return flow.validate(train, test, SPLIT, block_rows=500, by_time=False).select("split", "check", "passed", "n_bad")


PARTS = SESSIONS.replace(f" AND NOT {IS_NOISE}", "").replace("min((ts, ordinal))", "min(ordinal)").replace("ORDER BY ts, ordinal", "ORDER BY ordinal")
Q41 = f"""WITH {EV}, {PARTS},
falls AS (SELECT role, session_id, ts < lag(ts) OVER (PARTITION BY role ORDER BY session_id, seq) AS f,
  ts < lag(ts) OVER (PARTITION BY role, session_id ORDER BY seq) AS own FROM pos),
bad AS (SELECT role, session_id, bool_or(own) AS b FROM falls GROUP BY 1, 2),
noise AS (SELECT role, count(*) FILTER (WHERE regexp_matches(user_agent, 'CloudMapper', 'i')) + count(*) FILTER (WHERE regexp_matches(user_agent, 'boto3', 'i'))
  + count(*) FILTER (WHERE regexp_matches(invoked_by, 'amazonaws.com', 'i')) AS n FROM pos GROUP BY 1),
r AS (SELECT role AS split, 'temporal order' AS "check", count(*) FILTER (WHERE f) AS n_bad FROM falls GROUP BY 1
  UNION ALL SELECT role, 'session integrity', count(*) FILTER (WHERE b) FROM bad GROUP BY 1
  UNION ALL SELECT role, 'noise filter', n FROM noise
  UNION ALL SELECT role, c, 0 FROM (SELECT DISTINCT role FROM pos), (VALUES ('tabular structure'), ('null handling')) t(c)
  UNION ALL SELECT role, role || ' split', 0 FROM (SELECT DISTINCT role FROM pos))
SELECT split, "check", n_bad = 0 AS passed, CAST(n_bad AS BIGINT) AS n_bad FROM r"""


def q41b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on the flow's tables by time, all of which pass; rows that are numbered by their place in the output."""
    results = flow.validate(*_sessions(spark, sf_dir), SPLIT, block_rows=500)
    return results.select("split", "check", "passed", "n_bad")


Q41B = f"""WITH {EV}, {SESSIONS},
falls AS (SELECT role, ts < lag(ts) OVER (PARTITION BY role ORDER BY ts, session_id, seq) AS f FROM pos),
r AS (SELECT role AS split, 'temporal order' AS "check", count(*) FILTER (WHERE f) AS n_bad FROM falls GROUP BY 1
  UNION ALL SELECT role, 'noise filter', count(*) FILTER (WHERE {IS_NOISE}) FROM pos GROUP BY 1
  UNION ALL SELECT role, c, 0 FROM (SELECT DISTINCT role FROM pos), (VALUES ('tabular structure'), ('null handling'), ('session integrity')) t(c)
  UNION ALL SELECT role, role || ' split', 0 FROM (SELECT DISTINCT role FROM pos))
SELECT split, "check", n_bad = 0 AS passed, CAST(n_bad AS BIGINT) AS n_bad FROM r"""


def q41c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stages, observed by the jobs that store the sessions."""
    counts = flow.StageCounts()
    events = raw_events(spark, sf_dir).withColumn("source_file", F.lit("events"))
    for table in flow.session_tables(counts.watch(flow.flat_events(events), "flat"), SPLIT, counts=counts):
        materialize(table.select("session_id", "seq"), "sessions")
    return counts.table(spark)


Q41C = f"""WITH {EV}, p AS (SELECT *, CASE WHEN user_type = 'Root' THEN 'train' WHEN user_type = 'AssumedRole' THEN 'test' END AS role FROM ev)
SELECT 'flat' AS stage, count(*) AS n FROM ev UNION ALL SELECT role, count(*) FROM p WHERE role IS NOT NULL GROUP BY 1
UNION ALL SELECT role || ' without noise', count(*) FROM p WHERE role IS NOT NULL AND NOT {IS_NOISE} GROUP BY role"""


def q41d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output order of the training sessions: written in order, read back and numbered by place in the files."""
    path = f"{scratch_dir(spark)}/ordered-{uuid.uuid4().hex}"
    ordered = flow.for_export(_sessions(spark, sf_dir)[0]).select("eventID", "session_id", "seq")
    ordered.select(F.to_json(F.struct("eventID", "session_id", "seq")).alias("value")).write.text(path)
    read = json_events.with_row_numbers(json_events.read_jsonl(spark, path))
    names = {"eventID": "bigint", "session_id": "bigint", "seq": "bigint"}
    return read.select(*[field("raw", [n], kind=t).alias(n) for n, t in names.items()], "row")


Q41D = f"""WITH {EV}, {SESSIONS} SELECT ordinal AS "eventID", CAST(session_id AS BIGINT) AS session_id, CAST(seq AS BIGINT) AS seq,
row_number() OVER (ORDER BY ts, session_id, seq) - 1 AS row FROM pos WHERE role = 'train'"""

QUERIES = [
    Query("q41_flow_checks", q41b, Q41B),
    Query("q41_flow_checks_input_order", q41, Q41),
    Query("q41_observed_counts", q41c, Q41C),
    Query("q41_output_order", q41d, Q41D),
    Query("q39_flow_sessions", q39, Q39),
    Query("q39_flow_flags", q39b, Q39B),
]
