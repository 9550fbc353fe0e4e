"""From flags to incidents: texts, context, severity, attack pattern, prompt and report.

An incident is one flagged session. Its events stay in long form; texts are built per
page of events, so a session with any number of flags never becomes one huge row. A
session with at most ``page_events`` flags has exactly one page, its whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwarden import fixed_values as fv
from seqwarden.functions.text import percent
from seqwarden.operators.evaluate import guarded_ratio
from seqwarden.plans.skew import join_on, positions_within

PAGE_EVENTS = 10_000
CONTEXT = ("event_time", "source_ip", "user_arn", "event_name")


def template_text(flags: DataFrame, templates: DataFrame, key: str = "key") -> DataFrame:
    """Add the template text of the key; a key without one gets a text that names it."""
    names = templates.select(F.col("key").alias("_k"), F.col("template").alias("_t"))
    unknown = F.concat(F.lit("<unknown key "), F.col(key).cast("string"), F.lit(">"))
    return flags.join(names, F.col(key) == F.col("_k"), "left").select(
        *flags.columns, F.coalesce("_t", unknown).alias("template")
    )


def with_context(flags: DataFrame, metadata: DataFrame, session: Sequence[str], seq: str) -> DataFrame:
    """Add time, address, identity and event name by position; what is missing becomes ``N/A``."""
    on = [*session, seq]
    extra = [c for c in CONTEXT if c in metadata.columns]
    joined = join_on(flags.drop(*CONTEXT), metadata.select(*on, *extra), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING_CONTEXT)) for c in extra})


def flagged_events(rows: DataFrame, templates: DataFrame, session: Sequence[str], seq: str = "seq") -> DataFrame:
    """Long form: one row per flagged event with its template, context and 0-based line in the incident."""
    context = [F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING_CONTEXT)).alias(c) for c in CONTEXT]
    flagged = rows.filter("flag").select(*session, seq, "key", *context)
    return positions_within(template_text(flagged, templates), list(session), [seq], "line")


def severity(flagged: Column, total: Column) -> Column:
    """Rating by the flagged share, strictly above each limit; compared in whole numbers."""
    out = F.lit(fv.SEVERITY_DEFAULT[0])
    for name, limit, _ in reversed(fv.SEVERITY_RULES):
        out = F.when(flagged * 100 > total * limit, F.lit(name)).otherwise(out)
    return out


def severity_reason(flagged: Column, total: Column) -> Column:
    share = percent(flagged, total)

    def text(pattern: str) -> Column:
        before, after = pattern.split("{ratio}")
        return F.concat(F.lit(before), share, F.lit(after))

    out = text(fv.SEVERITY_DEFAULT[1])
    for _, limit, pattern in reversed(fv.SEVERITY_RULES):
        out = F.when(flagged * 100 > total * limit, text(pattern)).otherwise(out)
    return out


def attack_pattern(names: Column) -> Column:
    """First rule whose event names meet the lower-cased names of the array."""
    lowered = F.transform(names, F.lower)
    out = F.lit(fv.ATTACK_DEFAULT)
    for wanted, text in reversed(fv.ATTACK_RULES):
        hit = F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in wanted]))
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(text)).otherwise(out)
    return out


def attack_rule_of(name: Column) -> Column:
    """Number of the first rule that names this event; the smallest over a session decides."""
    out = F.lit(len(fv.ATTACK_RULES))
    for number in reversed(range(len(fv.ATTACK_RULES))):
        wanted = fv.ATTACK_RULES[number][0]
        out = F.when(F.coalesce(F.lower(name).isin(*wanted), F.lit(False)), F.lit(number)).otherwise(out)
    return out


def attack_text(rule: Column) -> Column:
    texts = [text for _, text in fv.ATTACK_RULES] + [fv.ATTACK_DEFAULT]
    return F.element_at(F.array(*[F.lit(t) for t in texts]), rule + 1)


def incident_headers(rows: DataFrame, session: Sequence[str]) -> DataFrame:
    """One row per flagged session; only fixed-size aggregates, so its length does not matter."""
    named = F.when(F.col("flag"), attack_rule_of(F.col("event_name")))
    flagged, total = F.col("n_flagged"), F.col("total_events")
    return (
        rows.groupBy(*session)
        .agg(F.count(F.lit(1)).alias("total_events"), F.count_if("flag").alias("n_flagged"), F.min(named).alias("_rule"))
        .filter(flagged > 0)
        .withColumn("anomaly_ratio", guarded_ratio(flagged, total))
        .withColumn("severity", severity(flagged, total))
        .withColumn("attack_pattern", attack_text(F.col("_rule")))
        .drop("_rule")
    )


def incidents(
    rows: DataFrame, templates: DataFrame, session: Sequence[str], seq: str = "seq", page_events: int = PAGE_EVENTS
) -> DataFrame:
    """Incident table: header columns and one page of ordered events per row."""
    event = F.struct(F.col("line"), F.col(seq).alias("pos"), "template", *CONTEXT)
    pages = (
        flagged_events(rows, templates, session, seq)
        .withColumn("page", F.floor(F.col("line") / page_events).cast("long"))
        .groupBy(*session, "page")
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
    )
    heads = incident_headers(rows, session)
    last = F.floor((F.col("n_flagged") - 1) / page_events).cast("long") == F.col("page")
    return join_on(pages, heads, session).withColumn("is_last_page", last)


def _session_text(session: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(s).cast("string"), F.lit(fv.UNKNOWN_SESSION)) for s in session])


def _on_first(text: Column) -> Column:
    return F.when(F.col("page") == 0, text).otherwise(F.lit(""))


def _on_last(text: Column) -> Column:
    return F.when(F.col("is_last_page"), text).otherwise(F.lit("\n"))


def user_message_lines() -> Column:
    return F.array_join(
        F.transform(
            "events",
            lambda e: F.concat(
                F.lit("  "), (e["line"] + 1).cast("string"), F.lit(". ["), e["event_time"], F.lit("] "), e["event_name"],
                F.lit("\n     Template: "), e["template"],
                F.lit("\n     Source IP: "), e["source_ip"], F.lit(" | Identity: "), e["user_arn"],
            ),
        ),
        "\n",
    )


def user_message(session: Sequence[str]) -> Column:
    """Header with counts and share, then the numbered events."""
    head = F.concat(
        F.lit("Session ID: "), _session_text(session), F.lit("\nTotal events in session: "),
        F.col("total_events").cast("string"), F.lit(" | Anomalous: "), F.col("n_flagged").cast("string"),
        F.lit(" ("), percent(F.col("n_flagged"), F.col("total_events"), 1), F.lit(")\n\nFlagged events:\n"),
    )
    return F.concat(_on_first(head), user_message_lines(), _on_last(F.lit("")))


def prompt(session: Sequence[str]) -> Column:
    """The user message between the chat markers, after the system text."""
    opening = F.lit(fv.PROMPT_OPEN + fv.SYSTEM_TEXT + fv.PROMPT_USER)
    return F.concat(_on_first(opening), user_message(session), F.when(F.col("is_last_page"), F.lit(fv.PROMPT_CLOSE)).otherwise(F.lit("")))


def report_lines() -> Column:
    lines = F.transform(
        "events",
        lambda e: F.concat(
            F.lit("  - ["), e["event_time"], F.lit("] **"), e["event_name"], F.lit("** from "), e["source_ip"],
            F.lit(" (identity: "), e["user_arn"], F.lit(")\n    Template: `"), e["template"],
            F.lit("`\n    " + fv.EVENT_NOTE),
        ),
    )
    return F.when(F.size("events") > 0, F.array_join(lines, "\n")).otherwise(F.lit(fv.NO_EVENTS_TEXT))


def report(session: Sequence[str]) -> Column:
    """Five sections: summary, events, severity, attack pattern, mitigation."""
    titles = [F.lit(t + "\n\n") for t in fv.SECTION_TITLES]
    gap = F.lit("\n\n")
    start, rest = fv.SUMMARY_TEXT.split("{n}")
    middle, end = rest.split("{session}")
    summary = F.concat(
        F.lit(start), F.col("n_flagged").cast("string"), F.lit(middle), _session_text(session), F.lit(end)
    )
    flagged, total = F.col("n_flagged"), F.col("total_events")
    rated = F.concat(F.lit("**"), F.col("severity"), F.lit("** — "), severity_reason(flagged, total))
    head = F.concat(titles[0], summary, gap, titles[1])
    tail = F.concat(
        gap, titles[2], rated, gap, titles[3], F.col("attack_pattern"), gap,
        titles[4], F.lit(fv.MITIGATION_TEXT), gap, F.lit(fv.CLOSING_TEXT),
    )
    return F.concat(_on_first(head), report_lines(), _on_last(tail))


def with_texts(table: DataFrame, session: Sequence[str]) -> DataFrame:
    """Prompt and report per incident page."""
    return table.select(
        *session, "page", "is_last_page", prompt(session).alias("prompt"), report(session).alias("report")
    )


def whole_sessions(pages: DataFrame, session: Sequence[str], columns: Sequence[str], separator: str = "") -> DataFrame:
    """One row per session however many pages it has: each column's texts joined in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", *columns)))
    joined = [F.array_join(F.col(f"_pages.{c}"), separator).alias(c) for c in columns]
    return pages.groupBy(*session).agg(ordered.alias("_pages")).select(*session, *joined)


def session_metadata(rows: DataFrame, session: Sequence[str], seq: str = "seq", page_events: int = PAGE_EVENTS) -> DataFrame:
    """Ordered context arrays per session, in pages of positions."""
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit(fv.MISSING_CONTEXT)) for c in CONTEXT}
    entry = F.struct(F.col(seq).alias("pos"), *[v.alias(c) for c, v in cell.items()])
    return (
        rows.withColumn("page", F.floor(F.col(seq) / page_events).cast("long"))
        .groupBy(*session, "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
