"""Flags to incidents: ratios, severity, context, attack rules, texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden import fixed_values as fv
from seqwarden.catalog import Query
from seqwarden.catalog.sequences import EV, FLAGS, K, SESSION, TOP, WIDTH, WIN, positioned, split_positions
from seqwarden.operators import incidents as inc
from seqwarden.operators import model, windows
from seqwarden.session import materialize, scratch_dir

# all test events with their flag; key 3 has no template on purpose
ALL = """
allf AS (SELECT e.*, coalesce(f.flag, false) AS flag FROM ev e LEFT JOIN flags f ON f.ordinal = e.ordinal WHERE e.split = 'test'),
tpl AS (SELECT DISTINCT key, event_name || ' <*>' AS template FROM ev WHERE key <> 3),
head AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE flag) AS n,
  min(CASE WHEN flag THEN CASE WHEN lower(event_name) IN ('createuser', 'attachuserpolicy') THEN 1
    WHEN lower(event_name) IN ('putbucketpolicy', 'putobject') THEN 2
    WHEN lower(event_name) IN ('assumerole', 'getcalleridentity') THEN 3 ELSE 4 END END) AS rule
  FROM allf GROUP BY user_id HAVING count(*) FILTER (WHERE flag) > 0),
evs AS (SELECT a.user_id, a.seq, a.key, a.event_name, coalesce(a.source_ip, 'N/A') AS ip, coalesce(a.user_arn, 'N/A') AS arn,
  strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS tm, coalesce(t.template, '<unknown key ' || a.key || '>') AS template,
  row_number() OVER (PARTITION BY a.user_id ORDER BY a.seq) AS line
  FROM allf a LEFT JOIN tpl t ON t.key = a.key WHERE a.flag)"""
BASE = f"WITH {EV}, {WIN}, {TOP}, {FLAGS}, {ALL}"


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test events with flag and context."""
    train, test, profile = split_positions(spark, sf_dir, "event_name", "source_ip", "user_arn")
    samples = windows.context_windows(train.select("user_id", "seq", "key"), SESSION, "seq", "key", WIDTH, profile)
    test = test.withColumn("event_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    counts = model.count_model(samples, "key")
    flags = model.detect(test, counts, SESSION, "seq", "key", WIDTH, K, profile=profile, all_rows=True)
    # the flags are a product of their own; incidents read the written table several times
    return materialize(flags.drop("ctx"), "flags")


def inline_templates(rows: DataFrame) -> DataFrame:
    text = F.concat("event_name", F.lit(" <*>"))
    return rows.filter(F.col("key") != 3).select("key", text.alias("template")).distinct()


def incident_table(spark: SparkSession, sf_dir: str, page_events: int = inc.PAGE_EVENTS) -> DataFrame:
    rows = flagged_rows(spark, sf_dir)
    return inc.incidents(rows, inline_templates(rows), SESSION, page_events=page_events)


def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.incident_headers(flagged_rows(spark, sf_dir), SESSION).select(
        "user_id", "total_events", "n_flagged", F.round("anomaly_ratio", 6).alias("anomaly_ratio"), "severity"
    )


SEVERITY = "CASE WHEN n * 100 > total * 30 THEN 'High' WHEN n * 100 > total * 15 THEN 'Medium' ELSE 'Low' END"
Q10 = f"""{BASE} SELECT user_id, total AS total_events, n AS n_flagged, round(n / total, 6) AS anomaly_ratio,
{SEVERITY} AS severity FROM head"""


def q10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.session_ratios(flagged_rows(spark, sf_dir), SESSION)
    return out.withColumn("ratio", F.round("ratio", 6))


Q10B = f"""{BASE} SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE flag) AS n_flagged,
round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM allf GROUP BY user_id"""


def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged_rows(spark, sf_dir)
    return inc.flagged_events(rows, inline_templates(rows), SESSION).select("user_id", "seq", "key", "template", "line")


Q18 = f"""{BASE} SELECT user_id, CAST(seq AS BIGINT) AS seq, key, template, CAST(line - 1 AS BIGINT) AS line FROM evs"""


def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inc.incident_headers(flagged_rows(spark, sf_dir), SESSION).select("user_id", "attack_pattern")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ATTACK = (
    "CASE rule "
    + " ".join(f"WHEN {i + 1} THEN {quoted(text)}" for i, (_, text) in enumerate(fv.ATTACK_RULES))
    + f" ELSE {quoted(fv.ATTACK_DEFAULT)} END"
)
Q26 = f"{BASE} SELECT user_id, {ATTACK} AS attack_pattern FROM head"


def q26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the same rules on the distinct event names of the whole session, however many pages it has
    rows = flagged_rows(spark, sf_dir).filter("flag")
    names = rows.groupBy(*SESSION).agg(F.collect_set("event_name").alias("names"))
    return names.select("user_id", inc.attack_pattern(F.col("names")).alias("attack_pattern"))


def q27(spark: SparkSession, sf_dir: str, page_events: int = inc.PAGE_EVENTS) -> DataFrame:
    pages = inc.with_texts(incident_table(spark, sf_dir, page_events), SESSION)
    return inc.whole_sessions(pages, SESSION, ["report"])


def percent_sql(digits: int) -> str:
    scale = 100 * 10**digits
    q, r = f"(n * {scale}) // total", f"(n * {scale}) % total"
    units = f"({q} + CASE WHEN 2 * ({r}) > total OR (2 * ({r}) = total AND ({q}) % 2 = 1) THEN 1 ELSE 0 END)"
    if not digits:
        return f"CAST({units} AS VARCHAR) || '%'"
    return f"CAST({units} // 10 AS VARCHAR) || '.' || CAST({units} % 10 AS VARCHAR) || '%'"


_summary = fv.SUMMARY_TEXT.replace("{n}", "\0").replace("{session}", "\0").split("\0")
REASON = (
    "CASE "
    + " ".join(
        f"WHEN n * 100 > total * {limit} THEN {quoted(text.split('{ratio}')[0])} || {percent_sql(0)} || {quoted(text.split('{ratio}')[1])}"
        for _, limit, text in fv.SEVERITY_RULES
    )
    + f" ELSE {quoted(fv.SEVERITY_DEFAULT[1].split('{ratio}')[0])} || {percent_sql(0)} || {quoted(fv.SEVERITY_DEFAULT[1].split('{ratio}')[1])} END"
)
Q27 = f"""{BASE}, body AS (SELECT user_id, string_agg('  - [' || tm || '] **' || event_name || '** from ' || ip || ' (identity: ' || arn
  || ')' || chr(10) || '    Template: `' || template || '`' || chr(10) || '    ' || {quoted(fv.EVENT_NOTE)}, chr(10) ORDER BY line) AS lines
  FROM evs GROUP BY user_id)
SELECT user_id, {quoted(fv.SECTION_TITLES[0])} || chr(10) || chr(10) || {quoted(_summary[0])} || n || {quoted(_summary[1])} || user_id
 || {quoted(_summary[2])} || chr(10) || chr(10) || {quoted(fv.SECTION_TITLES[1])} || chr(10) || chr(10) || lines
 || chr(10) || chr(10) || {quoted(fv.SECTION_TITLES[2])} || chr(10) || chr(10) || '**' || {SEVERITY} || '** — ' || {REASON}
 || chr(10) || chr(10) || {quoted(fv.SECTION_TITLES[3])} || chr(10) || chr(10) || {ATTACK}
 || chr(10) || chr(10) || {quoted(fv.SECTION_TITLES[4])} || chr(10) || chr(10) || {quoted(fv.MITIGATION_TEXT)}
 || chr(10) || chr(10) || {quoted(fv.CLOSING_TEXT)} AS report FROM head JOIN body USING (user_id)"""


def q37(spark: SparkSession, sf_dir: str, page_events: int = inc.PAGE_EVENTS) -> DataFrame:
    def joined(name: str):
        return F.array_join(F.transform("events", lambda e: e[name].cast("string")), ";").alias(name)

    columns = ("pos", "event_time", "source_ip", "user_arn", "event_name")
    pages = incident_table(spark, sf_dir, page_events).select("user_id", "page", *[joined(c) for c in columns])
    return inc.whole_sessions(pages, SESSION, columns, ";")


Q37 = f"""{BASE} SELECT user_id, string_agg(CAST(seq AS VARCHAR), ';' ORDER BY line) AS pos, string_agg(tm, ';' ORDER BY line) AS event_time,
string_agg(ip, ';' ORDER BY line) AS source_ip, string_agg(arn, ';' ORDER BY line) AS user_arn,
string_agg(event_name, ';' ORDER BY line) AS event_name FROM evs GROUP BY user_id"""


def q37b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = positioned(spark, sf_dir, "event_name", "source_ip", "user_arn")
    df = df.withColumn("event_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    pages = inc.session_metadata(df, SESSION, page_events=20)
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws("/", e["event_time"], e["source_ip"], e["event_name"])), ";")
    return pages.select("user_id", "page", text.alias("entries"))


Q37B = f"""WITH {EV} SELECT user_id, CAST(seq // 20 AS BIGINT) AS page,
string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || '/' || coalesce(source_ip, 'N/A') || '/' || event_name, ';' ORDER BY seq) AS entries
FROM ev GROUP BY 1, 2"""


def q38(spark: SparkSession, sf_dir: str, page_events: int = inc.PAGE_EVENTS) -> DataFrame:
    pages = inc.with_texts(incident_table(spark, sf_dir, page_events), SESSION)
    return inc.whole_sessions(pages, SESSION, ["prompt"])


Q38 = f"""{BASE}, body AS (SELECT user_id, string_agg('  ' || line || '. [' || tm || '] ' || event_name || chr(10) || '     Template: '
  || template || chr(10) || '     Source IP: ' || ip || ' | Identity: ' || arn, chr(10) ORDER BY line) AS lines FROM evs GROUP BY user_id)
SELECT user_id, {quoted(fv.PROMPT_OPEN + fv.SYSTEM_TEXT + fv.PROMPT_USER)} || 'Session ID: ' || user_id || chr(10)
 || 'Total events in session: ' || total || ' | Anomalous: ' || n || ' (' || {percent_sql(1)} || ')' || chr(10) || chr(10)
 || 'Flagged events:' || chr(10) || lines || {quoted(fv.PROMPT_CLOSE)} AS prompt FROM head JOIN body USING (user_id)"""


def q38b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined report text written in session order, then split at the rule line again."""
    from seqwarden.sources.tables import REPORT_RULE, save_reports

    path = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    save_reports(inc.with_texts(incident_table(spark, sf_dir), SESSION), path, SESSION)
    texts = spark.read.option("lineSep", REPORT_RULE).text(path)
    return texts.select(F.regexp_replace("value", "\n$", "").alias("report"))


Q38B = Q27.replace("SELECT user_id, '## 1", "SELECT '## 1")

QUERIES = [
    Query("q10_ratio_severity", q10, Q10),
    Query("q10_session_ratios", q10b, Q10B),
    Query("q18_reverse_map", q18, Q18),
    Query("q26_attack_rules", q26, Q26),
    Query("q26_attack_rules_by_names", q26b, Q26),
    Query("q27_report_text", q27, Q27),
    Query("q37_incident_context", q37, Q37),
    Query("q37_session_metadata", q37b, Q37B),
    Query("q38_prompts", q38, Q38),
    Query("q38_combined_report", q38b, Q38B),
]
