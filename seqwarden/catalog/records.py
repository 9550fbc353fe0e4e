"""Raw events, flattening, cleaning, splits, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.adapter import AUDIT_COLUMNS, audit_events, audit_sql, table
from seqwarden.catalog import Query
from seqwarden.fixed_values import KEEP_LIST_COLUMNS
from seqwarden.functions.variant import field
from seqwarden.operators import flatten as fl
from seqwarden.operators import prepare
from seqwarden.plans.skew import spread
from seqwarden.session import scratch_dir
from seqwarden.sources import json_events, tables

SPLIT = prepare.SplitSpec("user_type", "user_name")
NOISE = prepare.NoiseSpec((("user_agent", ("CloudMapper", "boto3")), ("invoked_by", ("amazonaws.com",))))
EV = f"ev AS ({audit_sql()})"
IS_TRAIN = "coalesce(user_type = 'Root', false)"
IS_TEST = "(coalesce(user_name IN ('backup', 'Level6'), false) OR coalesce(user_type = 'AssumedRole', false))"
IS_NOISE = (
    "(coalesce(regexp_matches(user_agent, 'CloudMapper|boto3', 'i'), false) "
    "OR coalesce(regexp_matches(invoked_by, 'amazonaws.com', 'i'), false))"
)
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def nested_json(df: DataFrame) -> DataFrame:
    """Audit events as JSON texts; null fields are absent from the text."""
    tags = F.when(F.col("ordinal") % 3 == 0, F.array()).when(
        F.col("ordinal") % 3 == 1, F.array("event_name")
    ).otherwise(F.array("event_name", F.lit(None).cast("string"), "split"))
    event = F.struct(
        F.col("ordinal").alias("eventID"),
        F.date_format("ts", ISO).alias("eventTime"),
        F.col("event_name").alias("eventName"),
        F.col("event_source").alias("eventSource"),
        F.col("source_ip").alias("sourceIPAddress"),
        F.col("user_agent").alias("userAgent"),
        F.struct(
            F.col("user_type").alias("type"),
            F.col("user_arn").alias("arn"),
            F.col("user_name").alias("userName"),
            F.col("invoked_by").alias("invokedBy"),
        ).alias("userIdentity"),
        F.from_json("props", "k BIGINT").alias("requestParameters"),
        F.when(F.col("ordinal") % 40 == 0, F.lit("rare")).alias("errorMessage"),
        F.when(F.col("ordinal") % 50 == 0, F.lit("rare")).alias("rareField"),
        (F.col("ordinal") % 2 == 0).alias("readOnly"),
        tags.alias("tags"),
    )
    return df.select("ordinal", F.to_json(event).alias("value"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_json(spread(audit_events(spark, sf_dir))).select("ordinal", F.parse_json("value").alias("raw"))


FLAT = f"""{EV}, flat AS (SELECT ordinal AS "eventID", strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "eventTime",
  event_name AS "eventName", event_source AS "eventSource", source_ip AS "sourceIPAddress", user_agent AS "userAgent",
  user_type AS "userIdentity_type", user_arn AS "userIdentity_arn", user_name AS "userIdentity_userName",
  invoked_by AS "userIdentity_invokedBy", CAST(json_extract_string(props, '$.k') AS BIGINT) AS "requestParameters_k",
  CASE WHEN ordinal % 40 = 0 THEN 'rare' END AS "errorMessage", CASE WHEN ordinal % 50 = 0 THEN 'rare' END AS "rareField",
  ordinal % 2 = 0 AS "readOnly",
  CASE ordinal % 3 WHEN 0 THEN '' WHEN 1 THEN event_name ELSE event_name || ',None,' || split END AS tags FROM ev)"""


def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "user_type", "user_name")
    return prepare.with_splits(df, SPLIT).select("ordinal", "split")


Q03 = f"""WITH {EV} SELECT ordinal, 'train' AS split FROM ev WHERE {IS_TRAIN}
UNION ALL SELECT ordinal, 'test' FROM ev WHERE {IS_TEST}"""


def q03b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "user_type", "user_name", "user_agent", "invoked_by")
    return prepare.stage_counts(df, SPLIT, NOISE)


Q03B = f"""WITH {EV} SELECT count(*) AS n_rows, count(*) FILTER (WHERE {IS_TRAIN}) AS n_train,
count(*) FILTER (WHERE {IS_TEST}) AS n_test, count(*) FILTER (WHERE {IS_TRAIN} AND NOT {IS_NOISE}) AS n_train_kept,
count(*) FILTER (WHERE {IS_TEST} AND NOT {IS_NOISE}) AS n_test_kept FROM ev"""


def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "user_agent", "invoked_by")
    return prepare.drop_noise(df, NOISE)


Q04 = f"WITH {EV} SELECT ordinal, user_agent, invoked_by FROM ev WHERE NOT {IS_NOISE}"


def q04b(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = prepare.NoiseSpec(NOISE.rules, literal=True)
    return prepare.drop_noise(audit_events(spark, sf_dir, "ordinal", "user_agent", "invoked_by"), literal)


Q04B = f"""WITH {EV} SELECT ordinal, user_agent, invoked_by FROM ev
WHERE NOT coalesce(contains(lower(user_agent), 'cloudmapper') OR contains(lower(user_agent), 'boto3'), false)
AND NOT coalesce(contains(lower(invoked_by), 'amazonaws.com'), false)"""


def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = raw_events(spark, sf_dir)
    flat = fl.flatten(events, fl.event_schema(events)).drop("ordinal")
    return fl.unnest_lists(flat, KEEP_LIST_COLUMNS)


Q19 = f"WITH {FLAT} SELECT * FROM flat"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = raw_events(spark, sf_dir)
    return fl.flatten(events, fl.event_schema(events)).drop("ordinal")


def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = fl.fill_rates(_flat(spark, sf_dir))
    return rates.select("column", F.round("fill_rate", 9).alias("fill_rate"))


_FLAT_COLUMNS = (
    "eventID eventTime eventName eventSource sourceIPAddress userAgent userIdentity_type userIdentity_arn "
    "userIdentity_userName userIdentity_invokedBy requestParameters_k errorMessage rareField readOnly tags"
).split()
Q20 = f"WITH {FLAT} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(CASE WHEN "{c}" IS NULL THEN 0.0 ELSE 1.0 END), 9) AS fill_rate FROM flat"""
    for c in _FLAT_COLUMNS
)


def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    kept = flat.select(*fl.kept_columns(flat))
    full = fl.with_required(fl.unnest_lists(kept), ["errorMessage", "requestParameters.roleName"])
    return prepare.fill_missing(prepare.with_time(full)).withColumn(
        "eventTime", F.unix_micros("eventTime")
    )


Q21 = f"""WITH {FLAT} SELECT CAST("eventID" AS VARCHAR) AS "eventID", epoch_us(strptime("eventTime", '%Y-%m-%dT%H:%M:%S.%fZ')) AS "eventTime", coalesce("eventName", 'None') AS "eventName",
coalesce("eventSource", 'None') AS "eventSource", coalesce("sourceIPAddress", 'None') AS "sourceIPAddress",
coalesce("userAgent", 'None') AS "userAgent", coalesce("userIdentity_type", 'None') AS "userIdentity_type",
coalesce("userIdentity_arn", 'None') AS "userIdentity_arn", coalesce("userIdentity_userName", 'None') AS "userIdentity_userName",
coalesce("userIdentity_invokedBy", 'None') AS "userIdentity_invokedBy",
CAST("requestParameters_k" AS VARCHAR) AS "requestParameters_k", coalesce("errorMessage", 'None') AS "errorMessage",
CASE WHEN "readOnly" THEN 'True' ELSE 'False' END AS "readOnly", tags, 'None' AS "requestParameters_roleName" FROM flat"""


def q21b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "source_ip", "user_arn", "user_name")
    kept = prepare.drop_without_session(df, ["source_ip", "user_arn"])
    return prepare.as_text(kept, ["source_ip", "user_arn", "user_name", "absent"])


Q21B = f"""WITH {EV} SELECT ordinal, source_ip, user_arn, coalesce(user_name, '') AS user_name FROM ev
WHERE source_ip IS NOT NULL AND user_arn IS NOT NULL"""


def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole vectors as integer lists; lists of one and of no element are columns of their own
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("long"))
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", ints.alias("cells"), F.slice(ints, 1, 1).alias("one_cell"), F.slice(ints, 1, 0).alias("no_cells")
    )
    return fl.unnest_lists(df)


_CELL = "lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 100.0) AS BIGINT) AS VARCHAR)"
Q22 = "SELECT vec_id, " + ", ".join(
    f"array_to_string(list_transform({cells}, {_CELL}), ',') AS {name}"
    for name, cells in (("cells", "embedding"), ("one_cell", "embedding[1:1]"), ("no_cells", "embedding[1:0]"))
) + " FROM embeddings"


def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "user_type", "user_name")
    train, test = prepare.split_train_test(df, SPLIT)
    return prepare.leaked_rows(train, test, ["ordinal"]).select("ordinal", "user_name")


Q24 = f"WITH {EV} SELECT ordinal, user_name FROM ev WHERE {IS_TRAIN} AND {IS_TEST}"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _fields(events: DataFrame) -> DataFrame:
    return events.select(
        field("raw", ["eventID"], kind="bigint").alias("ordinal"),
        field("raw", ["eventName"]).alias("event_name"),
        field("raw", ["userIdentity", "arn"], "unknown").alias("user_arn"),
        field("raw", ["requestParameters", "k"], kind="bigint").alias("k"),
    )


FIELDS = """SELECT ordinal, event_name, coalesce(user_arn, 'unknown') AS user_arn,
CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev"""


def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "jsonl")
    json_events.write_jsonl(json_events.merged_by_time(
        raw_events(spark, sf_dir).withColumn("source_file", F.lit("events"))
    ), path)
    return _fields(json_events.read_jsonl(spark, path))


Q32 = f"WITH {EV} {FIELDS}"


def q32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged by the text of the time, missing first: the order of the written lines is the result."""
    path = _folder(spark, "merged")
    timed = nested_json(spread(audit_events(spark, sf_dir).withColumn("ts", F.when(F.col("ordinal") % 13 != 0, F.col("ts")))))
    raw = timed.select(F.lit("events").alias("source_file"), "ordinal", F.parse_json("value").alias("raw"))
    json_events.write_jsonl(json_events.merged_by_time(raw), path)
    return json_events.with_row_numbers(json_events.read_jsonl(spark, path)).select(field("raw", ["eventID"], kind="bigint").alias("ordinal"), "row")


Q32C = f"""WITH {EV} SELECT ordinal, row_number() OVER (ORDER BY CASE WHEN ordinal % 13 <> 0 THEN ts END NULLS FIRST, ordinal) - 1 AS row FROM ev"""


def q32b(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every event line is followed by a blank one; both are written, only events are counted
    path = _folder(spark, "lines")
    lines = nested_json(audit_events(spark, sf_dir))
    lines.select(F.explode(F.array("value", F.lit(" \t"))).alias("value")).write.text(path)
    return spark.range(1).select(F.lit(json_events.count_lines(spark, path)).cast("long").alias("n_lines"))


Q32B = "SELECT count(*) AS n_lines FROM events"


def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events per form, each written and read back through ``auto``."""
    lines = nested_json(audit_events(spark, sf_dir))
    # files of some hundred events each, as log services write them
    files = lines.withColumn("_file", F.floor(F.col("ordinal") / 300))
    third = F.col("_file") % 3
    body = F.array_join(F.array_sort(F.collect_list("value")), ",")
    whole = files.filter(third != 0).groupBy("_file").agg(body.alias("body")).select(
        F.when(third == 1, F.concat(F.lit('{"Records":['), "body", F.lit("]}")))
        .otherwise(F.concat(F.lit("["), "body", F.lit("]")))
        .alias("value")
    )
    # one file per text: an envelope or array must be alone in its file
    envelope_path, line_path = _folder(spark, "whole"), _folder(spark, "lines")
    whole.repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(envelope_path)
    files.filter(third == 0).select("value").write.text(line_path)
    parts = [json_events.read_events(spark, p, "auto", glob="*.txt") for p in (envelope_path, line_path)]
    return _fields(parts[0].unionByName(parts[1]))


Q33 = Q32


def q33b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes and arrays of some thousand events each over many lines, read in pieces."""
    files = nested_json(audit_events(spark, sf_dir)).withColumn("_file", F.floor(F.col("ordinal") / 2500))
    body = F.array_join(F.array_sort(F.collect_list("value")), ",\n  ")
    whole = files.groupBy("_file").agg(body.alias("body")).select(
        F.when(F.col("_file") % 2 == 0, F.concat(F.lit('{"Records": [\n'), "body", F.lit("\n]}"))).otherwise(F.concat(F.lit("[\n"), "body", F.lit("\n]"))).alias("value")
    )
    path = _folder(spark, "pieces")
    whole.repartition(F.col("value")).write.option("maxRecordsPerFile", 1).text(path)
    return _fields(json_events.read_events(spark, path, "auto", glob="*.txt"))


def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = audit_events(spark, sf_dir, "ordinal", "ts", "event_name", "user_name", "value")
    first = fl.prefix_rows(df, ["ts", "ordinal"], 500).select("ordinal", "event_name")
    schema = {"ordinal": "bigint", "event_name": "string", "user_name": "string", "missing": "double"}
    rest = df.join(first.select("ordinal"), "ordinal", "left_anti").drop("event_name")
    return fl.align(first, schema).unionByName(fl.align(rest, schema))


Q34 = f"""WITH {EV}, r AS (SELECT *, row_number() OVER (ORDER BY ts, ordinal) AS rn FROM ev)
SELECT ordinal, CASE WHEN rn <= 500 THEN event_name END AS event_name,
CASE WHEN rn > 500 THEN user_name END AS user_name, CAST(NULL AS DOUBLE) AS missing FROM r"""


def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV out and in with both null rules, and Parquet partitioned by split."""
    df = audit_events(spark, sf_dir, "ordinal", "user_name", "event_name", "split")
    csv_path, table_path = _folder(spark, "csv"), _folder(spark, "table")
    tables.export_csv(prepare.as_text(prepare.fill_missing(df, time="ordinal"), ["ordinal"]), csv_path)
    tables.save_table(df, table_path, partition_by=["split"])
    none_is_null = tables.import_csv(spark, csv_path, null_text="None")
    kept_text = tables.import_csv(spark, csv_path, null_text="")
    stored = tables.load_table(spark, table_path).select("ordinal", "event_name", F.col("split").alias("stored_split"))
    return (
        none_is_null.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("user_name").alias("name_or_null"))
        .join(kept_text.select(F.col("ordinal").cast("long").alias("ordinal"), "user_name"), "ordinal")
        .join(stored, "ordinal")
    )


Q35 = f"""WITH {EV} SELECT ordinal, nullif(coalesce(user_name, 'None'), 'None') AS name_or_null,
coalesce(user_name, 'None') AS user_name, event_name, split AS stored_split FROM ev"""

QUERIES = [
    Query("q03_split", q03, Q03),
    Query("q03_stage_counts", q03b, Q03B),
    Query("q04_noise_filter", q04, Q04),
    Query("q04_noise_literal", q04b, Q04B),
    Query("q19_json_flatten", q19, Q19),
    Query("q20_fill_rate", q20, Q20),
    Query("q21_null_fill", q21, Q21),
    Query("q21_session_text", q21b, Q21B),
    Query("q22_list_unnest", q22, Q22),
    Query("q24_leakage", q24, Q24),
    Query("q32_jsonl_roundtrip", q32, Q32),
    Query("q32_count_lines", q32b, Q32B),
    Query("q32_merged_order", q32c, Q32C),
    Query("q33_source_formats", q33, Q33),
    Query("q33_pieces", q33b, Q32),
    Query("q34_schema_align", q34, Q34),
    Query("q35_table_roundtrip", q35, Q35),
]
