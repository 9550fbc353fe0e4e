"""Views of the sample tables in the shape of audit events.

Each column is one expression that Spark SQL and ANSI engines read alike, so a
check query can build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# column name -> expression over the ``events`` table
AUDIT_COLUMNS: dict[str, str] = {
    "ordinal": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "key": "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END",
    "split": "CASE WHEN user_id % 3 = 0 THEN 'train' ELSE 'test' END",
    "event_name": (
        "CASE event_type WHEN 'click' THEN 'GetObject' WHEN 'error' THEN 'AssumeRole' "
        "WHEN 'purchase' THEN 'CreateUser' WHEN 'signup' THEN 'PutBucketPolicy' ELSE 'ListBuckets' END"
    ),
    "event_source": (
        "CASE event_type WHEN 'click' THEN 's3' WHEN 'error' THEN 'sts' "
        "WHEN 'purchase' THEN 'iam' WHEN 'signup' THEN 's3' ELSE 's3' END || '.amazonaws.com'"
    ),
    "source_ip": (
        "CASE WHEN user_id % 17 = 5 THEN NULL ELSE '10.' || CAST(user_id % 7 AS STRING) || '.' "
        "|| CAST(user_id % 11 AS STRING) || '.' || CAST(user_id % 251 AS STRING) END"
    ),
    "user_arn": (
        "CASE WHEN user_id % 17 = 5 THEN NULL WHEN user_id % 2 = 0 "
        "THEN 'arn:aws:iam::' || CAST(811596193553 + user_id % 5 AS STRING) || ':user/u' || CAST(user_id AS STRING) "
        "ELSE 'arn:aws:sts::' || CAST(811596193553 AS STRING) || ':assumed-role/r' || CAST(user_id AS STRING) || '/s.1' END"
    ),
    "user_type": "CASE user_id % 4 WHEN 0 THEN 'Root' WHEN 1 THEN 'IAMUser' WHEN 2 THEN 'AssumedRole' ELSE 'root' END",
    "user_name": "CASE user_id % 5 WHEN 0 THEN 'backup' WHEN 1 THEN 'Level6' WHEN 2 THEN 'level6' WHEN 3 THEN NULL ELSE 'None' END",
    "user_agent": (
        "CASE event_id % 7 WHEN 0 THEN 'CloudMapper' WHEN 1 THEN 'Boto3/1.26.0' WHEN 2 THEN NULL "
        "WHEN 3 THEN 'aws-cli/1.0' WHEN 4 THEN '[S3Console/0.4]' ELSE 'aws-sdk-java' END"
    ),
    "invoked_by": (
        "CASE event_id % 9 WHEN 0 THEN 'config.amazonaws.com' WHEN 1 THEN 'AMAZONAWSxCOM' "
        "WHEN 2 THEN 'internal' ELSE NULL END"
    ),
    "value": "value",
    "props": "props",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``events`` table as audit events; only the named columns are read."""
    names = columns or tuple(AUDIT_COLUMNS)
    return table(spark, sf_dir, "events").select(*[F.expr(AUDIT_COLUMNS[c]).alias(c) for c in names])


def audit_sql(*columns: str) -> str:
    """The same view as a SELECT for the check queries."""
    names = columns or tuple(AUDIT_COLUMNS)
    return "SELECT " + ", ".join(f"{AUDIT_COLUMNS[c]} AS {c}" for c in names) + " FROM events"
