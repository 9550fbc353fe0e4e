from pyspark.sql import functions as F

from seqwarden.fixed_values import ATTACK_DEFAULT, ATTACK_RULES
from seqwarden.functions.text import percent
from seqwarden.operators import incidents as inc

TEMPLATES = [(0, "ListBuckets <*>"), (1, "GetObject <*>"), (2, "CreateUser <*>")]
COLUMNS = "session int, seq long, key int, flag boolean, event_time string, source_ip string, user_arn string, event_name string"


def rows(spark, keys, flags, names=None):
    names = names or ["n"] * len(keys)
    data = [(42, i, k, f == "T", f"t{i}", f"ip{i}", None, n) for i, (k, f, n) in enumerate(zip(keys, flags, names))]
    return spark.createDataFrame(data, COLUMNS)


def table(spark, *args, **kw):
    templates = spark.createDataFrame(TEMPLATES, "key int, template string")
    return inc.incidents(rows(spark, *args), templates, ["session"], **kw)


def test_reverse_map(spark):
    row = table(spark, [0, 1, 99, 0], "FTTF").first()
    assert [e.pos for e in row.events] == [1, 2]
    assert [e.template for e in row.events] == ["GetObject <*>", "<unknown key 99>"]
    assert [e.source_ip for e in row.events] == ["ip1", "ip2"]
    assert [e.user_arn for e in row.events] == ["N/A", "N/A"]
    assert (row.total_events, row.n_flagged, row.anomaly_ratio, row.severity) == (4, 2, 0.5, "High")
    assert (row.page, row.is_last_page) == (0, True)
    assert table(spark, [0, 1], "FF").count() == 0


def test_context_by_position(spark):
    flags = rows(spark, [0, 1], "TT").select("session", "seq", "key", "flag")
    meta = rows(spark, [0, 1], "TT").filter("seq = 0").select("session", "seq", "source_ip", "event_name")
    got = inc.with_context(flags, meta, ["session"], "seq").orderBy("seq").collect()
    assert [(r.source_ip, r.event_name) for r in got] == [("ip0", "n"), ("N/A", "N/A")]


def test_severity_limits_are_strict(spark):
    data = [(3, 10, "Medium"), (31, 100, "High"), (5, 10, "High"), (2, 10, "Medium"), (15, 100, "Low"), (1, 20, "Low")]
    df = spark.createDataFrame(data, "n long, total long, want string")
    assert df.filter(inc.severity(F.col("n"), F.col("total")) != F.col("want")).count() == 0


def test_percent_rounds_half_to_even(spark):
    data = [(1, 8, 0, "12%"), (3, 8, 0, "38%"), (1, 5, 1, "20.0%"), (1, 3, 1, "33.3%"), (2, 3, 0, "67%"), (1, 1, 1, "100.0%"), (1, 2000, 1, "0.0%"), (3, 2000, 1, "0.2%")]
    for a, b, digits, want in data:
        df = spark.createDataFrame([(a, b)], "a long, b long")
        assert df.select(percent(F.col("a"), F.col("b"), digits)).first()[0] == want


def test_attack_rules(spark):
    cases = [
        (["x", "ATTACHUSERPOLICY", "PutObject"], ATTACK_RULES[0][1]),
        (["PutBucketPolicy"], ATTACK_RULES[1][1]),
        (["GetCallerIdentity"], ATTACK_RULES[2][1]),
        (["ListBuckets"], ATTACK_DEFAULT),
        ([], ATTACK_DEFAULT),
    ]
    df = spark.createDataFrame(cases, "names array<string>, want string")
    assert df.filter(inc.attack_pattern(F.col("names")) != F.col("want")).count() == 0
    for names, want in cases[:4]:
        row = table(spark, [0] * len(names), "T" * len(names), names).first()
        assert row.attack_pattern == want


def test_texts(spark):
    names = ["CreateUser", "AttachUserPolicy", "PutBucketPolicy"] + ["x"] * 12
    texts = inc.with_texts(table(spark, [2, 1, 0] + [0] * 12, "TTT" + "F" * 12, names), ["session"]).first()
    assert texts.prompt.startswith("<|begin_of_text|>") and texts.prompt.endswith("assistant<|end_header_id|>\n\n")
    assert "Session ID: 42\nTotal events in session: 15 | Anomalous: 3 (20.0%)\n\nFlagged events:\n  1. [t0] CreateUser\n" in texts.prompt
    assert "     Template: CreateUser <*>\n     Source IP: ip0 | Identity: N/A\n  2. [t1]" in texts.prompt
    for n, title in enumerate(["Incident Summary", "Anomaly Analysis", "Severity Assessment", "Attack Pattern Classification", "Recommended Mitigation"], 1):
        assert f"## {n}. {title}\n\n" in texts.report
    assert "flagged 3 anomalous event(s) in session 42.  The" in texts.report
    assert "**Medium** — 20% anomaly ratio" in texts.report and "T1136" in texts.report


def test_pages_join_to_the_whole_text(spark):
    args = ([0, 1, 2, 0, 1, 2, 0], "TTFTTTT")
    whole = inc.with_texts(table(spark, *args), ["session"]).first()
    pages = inc.with_texts(table(spark, *args, page_events=2), ["session"]).orderBy("page").collect()
    assert len(pages) == 3
    assert "".join(p.report for p in pages) == whole.report
    assert "".join(p.prompt for p in pages) == whole.prompt
