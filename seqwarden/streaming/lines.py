"""Line files read as they arrive, and keyed against a frozen vocabulary.

Both steps decide each row alone, so no state and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.functions.text import log_string
from seqwarden.functions.variant import field
from seqwarden.operators.templates import MiningSpec, apply_templates
from seqwarden.sources.json_events import not_blank


def stream_jsonl(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of events from a folder of line files."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.filter(not_blank(F.col("value"))).select(F.parse_json("value").alias("raw"))


def stream_keys(events: DataFrame, templates: DataFrame, spec: MiningSpec = MiningSpec()) -> DataFrame:
    """Event id, log text and template key; -1 where the vocabulary has no match."""
    message = log_string(
        field("raw", ["eventSource"]), field("raw", ["eventName"]),
        field("raw", ["sourceIPAddress"]), field("raw", ["userIdentity", "arn"]),
    )
    narrow = events.select(field("raw", ["eventID"]).alias("event_id"), message.alias("message"))
    return apply_templates(narrow, "message", templates, spec)
