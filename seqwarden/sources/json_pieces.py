"""Large JSON files that are one text, read in pieces by many tasks: arrays, envelopes, and single objects over several lines.

Spark's line reader splits a file at every closing brace. A piece alone does not tell whether it begins inside a string
or how deep it lies, but both follow from sums over the pieces before it: the number of quotes, then of
opened and closed brackets, for either way the piece may begin. Sums are taken inside a file block and over the blocks' totals.
An event ends where the depth is that of the list it stands in; its pieces are joined again. No task holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwarden.session import materialize

OPENING = r'"Records"\s*:\s*\['
AT = ("source_file", "block", "line")


def _without_escapes(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def _outside(text: Column, begins_inside: bool) -> Column:
    """What of a text without escapes lies outside of strings."""
    return F.regexp_replace(F.concat(F.lit('"'), text) if begins_inside else text, r'"[^"]*("|$)', "")


def _times(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _rise(text: Column) -> Column:
    return (_times(text, "{[") - _times(text, "}]")).cast("long")


def _pieces(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    rows = reader.option("lineSep", "}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"),
    )


def _measured(pieces: DataFrame) -> DataFrame:
    """Per piece the quotes, and for a piece that begins outside (0) or inside (1) of a string how much deeper its end lies,
    whether it first closes a bracket, and how deep the key of the records lies, if it is there."""
    bare = pieces.withColumn("bare", _without_escapes(F.col("text"))).withColumn("quotes", _times(F.col("bare"), '"'))
    at = F.regexp_instr("text", F.lit(OPENING))
    bare = bare.withColumn("key_at", F.when(at > 0, at)).withColumn("opened", F.regexp_substr("text", F.lit(OPENING)))
    before = _without_escapes(F.substring(F.col("text"), F.lit(1), F.col("key_at") - 1))
    for n, inside in ((0, False), (1, True)):
        outside = _outside(F.col("bare"), inside)
        bare = bare.withColumn(f"rise{n}", _rise(outside) - ((F.col("quotes") + n) % 2 == 0).cast("long"))
        bare = bare.withColumn(f"closes{n}", F.ltrim(F.regexp_replace(outside, r"^\s+", "")).startswith("]"))
        own = F.when((_times(before, '"') + n) % 2 == 0, _rise(_outside(before, inside)))
        bare = bare.withColumn(f"key_depth{n}", own)
    return bare.withColumn("key_end", F.col("key_at") + F.length("opened")).drop("bare", "opened", "key_at")


def _before(df: DataFrame, **values: Column) -> DataFrame:
    """Adds to each piece the sums of the values over all pieces of its file before it."""
    df = df.withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()})
    totals = df.groupBy("source_file", "block").agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    blocks = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = totals.select("source_file", "block", *[F.coalesce(F.sum(n).over(blocks), F.lit(0)).alias(f"_s_{n}") for n in values])
    inside = Window.partitionBy("source_file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, ["source_file", "block"])
    sums = {n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values}
    return out.withColumns(sums).drop(*[f"_{x}_{n}" for n in values for x in "vs"])


def scan_elements(spark: SparkSession, path: str, glob: str | None = None, form: str = "auto", files: DataFrame | None = None) -> DataFrame:
    """(source_file, ordinal, value): the events of files that are one JSON text each, as texts.

    ``array``: the objects of a top-level list; ``envelope``: those of the list under ``Records``, none without it;
    ``auto``: whichever a file is, and a file that is neither is one event itself. Elements of the lists must be objects.
    ``files`` (source_file) names the files to take; all others are left alone. A file that is no whole JSON text gives a value that is no JSON either, so that it fails when parsed.
    """
    pieces = _pieces(spark, path, glob)
    pieces = pieces if files is None else pieces.join(files, "source_file", "left_semi")
    measured = materialize(_measured(pieces), "pieces")
    found = _before(measured.drop("text"), quotes_before=F.col("quotes"))
    inside = F.col("quotes_before") % 2 == 1
    either = {n: F.when(inside, F.col(f"{n}1")).otherwise(F.col(f"{n}0")) for n in ("rise", "closes", "key_depth")}
    ends_inside = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    found = found.select(*AT, *[c.alias(n) for n, c in either.items()], "key_end", ends_inside.alias("ends_inside"))
    found = materialize(_before(found, depth=F.col("rise")), "depths")
    found = found.withColumn("opens", F.coalesce(F.col("key_depth") + F.col("depth") == 1, F.lit(False)))
    found = found.withColumn("leaves", F.col("closes") & (F.col("depth") == 2))
    kinds = found.groupBy("source_file").agg(F.max("opens").alias("records"), F.sum("rise").alias("rise"))
    heads = measured.groupBy("source_file").agg(F.min_by("text", F.struct("block", "line")).alias("head"))
    listed = F.ltrim(F.regexp_replace("head", r"^\s+", "")).startswith("[")
    level = F.when(listed, 1).when(F.col("records"), 2).otherwise(0)
    wanted = {"auto": F.lit(True), "array": listed, "envelope": ~listed & F.col("records")}[form]
    kinds = materialize(kinds.join(heads, "source_file").filter(wanted).select("source_file", level.alias("level"), "rise", "head"), "kinds")
    # the list of an envelope is open after as many openings as one more than the lists of that depth left since
    found = _before(found.join(kinds.select("source_file", "level"), "source_file"), openings=F.col("opens"), left=F.col("leaves") & (F.col("level") == 2))
    found = found.withColumn("now", F.col("openings") + F.col("opens").cast("long"))
    # of each opening: what was left before it; lists that are left before an opening are other lists
    base = found.filter("opens").groupBy("source_file", F.col("now").alias("now")).agg(F.min(F.col("left") + F.col("leaves").cast("long")).alias("left_then"))
    found = found.join(base, ["source_file", "now"], "left")
    still = F.col("left") + F.when(F.col("opens"), F.lit(0)).otherwise(F.col("leaves").cast("long")) <= F.col("left_then") - F.when(F.col("opens"), F.col("leaves").cast("long")).otherwise(F.lit(0))
    in_list = F.when(F.col("level") == 2, F.coalesce(still, F.lit(False))).otherwise(F.lit(True))
    ends = in_list & ~F.col("ends_inside") & (F.col("depth") + F.col("rise") == F.col("level"))
    found = found.select(*AT, "level", "key_end", "opens", in_list.alias("in_list"), ends.alias("ends"))
    found = _before(found, number=F.col("ends")).filter("in_list")
    own = F.when(F.col("opens"), F.substring(F.col("text"), F.col("key_end"), F.length("text"))).otherwise(F.col("text"))
    parts = found.join(measured.select(*AT, "text"), [*AT]).select(*AT, "level", "number", "ends", own.alias("text"))
    joined = parts.groupBy("source_file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "text"))).alias("p"), F.bool_or("ends").alias("whole"), F.first("level").alias("level")
    ).filter("whole")
    text = F.concat(F.array_join("p.text", "}"), F.lit("}"))
    lead = F.when(F.col("level") == 0, r"^\s+").otherwise(r"^[\s,\[]+")
    ordinal = F.struct(F.get("p.block", F.lit(0)).alias("block"), F.get("p.line", F.lit(0)).alias("line"))
    events = joined.select("source_file", ordinal.alias("ordinal"), F.regexp_replace(text, lead, F.lit("")).alias("value"))
    # a brace is counted after the last piece although a file need not end with one; anything else is no whole JSON text
    broken = kinds.filter(~F.col("rise").isin(0, -1) | ((F.col("level") == 0) & F.col("head").rlike(r"\S")))
    alone = broken.join(events.select("source_file").distinct(), "source_file", "left_anti").unionByName(kinds.filter(~F.col("rise").isin(0, -1)))
    start = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("line"))
    return events.unionByName(alone.select("source_file", start.alias("ordinal"), F.concat("head", F.lit(" }")).alias("value")))
