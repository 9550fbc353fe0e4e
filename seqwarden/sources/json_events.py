"""Raw JSON events: line files, envelopes and arrays.

Every scan returns ``source_file``, ``ordinal`` and ``raw`` (VARIANT). The pair
``(source_file, ordinal)`` is the total order of the input that breaks ties later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwarden.functions.variant import field
from seqwarden.session import materialize
from seqwarden.sources.json_pieces import scan_elements

BLANK_FREE = r"(?U)[^\s\x1c-\x1f]"


def not_blank(line: Column) -> Column:
    return line.rlike(BLANK_FREE)


def _reader(spark: SparkSession, glob: str | None):
    reader = spark.read
    return reader.option("pathGlobFilter", glob) if glob else reader


def scan_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Non-blank lines with their place in the input. Splittable: a file is read by many tasks."""
    lines = _reader(spark, glob).text(path)
    # rows of one file block are read in order by one task, so the id grows with the line
    ordinal = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"), ordinal.alias("ordinal"), "value"
    ).filter(not_blank(F.col("value")))


def read_jsonl(spark: SparkSession, path: str, bad_lines: str = "fail", glob: str | None = None) -> DataFrame:
    """One event per line. ``bad_lines``: ``fail`` raises, ``null`` keeps the row with ``raw`` null and its text."""
    lines = scan_lines(spark, path, glob)
    if bad_lines == "fail":
        return lines.select("source_file", "ordinal", F.parse_json("value").alias("raw"))
    if bad_lines == "null":
        return lines.withColumn("raw", F.try_parse_json("value"))
    raise ValueError(f"bad_lines must be 'fail' or 'null', got {bad_lines!r}")


def with_row_numbers(events: DataFrame, out: str = "row") -> DataFrame:
    """Adds the 0-based number of each row in input order, over all files in the order of their names.

    Rows are counted for each file block; numbers inside a block are shifted by the rows of the blocks before it. So no window
    spans more than one block of a file, and the table of blocks is small.
    """
    at = {"_file": F.col("source_file"), "_block": F.col("ordinal.block")}
    sizes = events.select(*[c.alias(n) for n, c in at.items()]).groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "blocks")
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("ordinal"))
    numbered = events.withColumns(at).withColumn("_inside", inside).join(starts, [*at])
    return numbered.select(*events.columns, (F.col("_start") + F.col("_inside") - 1).alias(out))


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines of a line file."""
    return spark.read.text(path).filter(not_blank(F.col("value"))).count()


def _parsed(elements: DataFrame) -> DataFrame:
    return elements.select("source_file", "ordinal", F.parse_json("value").alias("raw"))


def read_envelopes(spark: SparkSession, path: str, glob: str | None = "*.json") -> DataFrame:
    """``{"Records": [...]}`` files of any size and in any number of lines, read in pieces; a file without the key has no events."""
    return _parsed(scan_elements(spark, path, glob, "envelope"))


def read_arrays(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files that are one top-level array of objects, read in pieces."""
    return _parsed(scan_elements(spark, path, glob, "array"))


def _items(text: Column) -> Column:
    """The events of one JSON text: the elements of an array, the records of an envelope, or the text itself.

    Elements are cut out as texts, so only a single event has to fit into a VARIANT.
    """
    listed = F.when(F.ltrim(text).startswith("["), text).otherwise(F.get_json_object(text, "$.Records"))
    cut = F.when(listed.startswith("[") | F.ltrim(listed).startswith("["), F.from_json(listed, "array<string>"))
    return F.transform(F.coalesce(cut, F.array(text)), F.parse_json)


def read_events(spark: SparkSession, path: str, form: str = "auto", glob: str | None = None) -> DataFrame:
    """Events of any supported form: ``jsonl``, ``envelope``, ``array`` or ``auto``.

    ``auto`` looks at the first line of each file. If it is a JSON text of its own, the file
    is read by lines, splittably, and each line is an event, an envelope or an array; else the file is one
    JSON text over several lines and is read in pieces. The size of a file decides nothing. A text
    that is no JSON is an error. A very long single line is read by many tasks with ``envelope`` or ``array``.
    """
    if form == "jsonl":
        return read_jsonl(spark, path, glob=glob)
    if form == "envelope":
        return read_envelopes(spark, path, glob)
    if form == "array":
        return read_arrays(spark, path, glob)
    if form != "auto":
        raise ValueError(f"unknown form {form!r}")
    lines = scan_lines(spark, path, glob)
    opening = lines.groupBy("source_file").agg(F.min_by("value", "ordinal").alias("first"))
    spread = materialize(opening.filter(F.get_json_object("first", "$").isNull()).select("source_file"), "spread")
    by_line = lines.join(spread, "source_file", "left_anti").select(
        "source_file", F.col("ordinal.block").alias("block"), F.col("ordinal.line").alias("line"), F.posexplode(_items(F.col("value"))).alias("pos", "raw")
    )
    if spread.isEmpty():
        return by_line.select("source_file", F.struct("block", "line", "pos").alias("ordinal"), "raw")
    whole = _parsed(scan_elements(spark, path, glob, files=spread)).select(
        "source_file", "ordinal.block", "ordinal.line", F.lit(0).alias("pos"), "raw"
    )
    return by_line.unionByName(whole).select("source_file", F.struct("block", "line", "pos").alias("ordinal"), "raw")


def merged_by_time(events: DataFrame, time_field: str = "eventTime") -> DataFrame:
    """All events by the text of their time, missing first, ties in input order."""
    return events.withColumn("_time", field("raw", [time_field], "")).orderBy("_time", "source_file", "ordinal").drop("_time")


def write_jsonl(events: DataFrame, path: str, column: str = "raw", mode: str = "errorifexists") -> None:
    """One compact JSON object per line, in the order of the rows."""
    events.select(F.to_json(column).alias("value")).write.mode(mode).text(path)
