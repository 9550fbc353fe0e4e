"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = " *[^ \\n]+(?: +[^ \\n]+){0,2} *| +"  # up to three words of a line with the spaces around them; the runs of a line are the whole line
ROWS_PER_BLOCK = 500
MOST_BOUNDS = 300  # of either level, so 90,000 blocks


def leaves(text: Column) -> Column:
    """The leaves by section and paragraph: hashes of the runs of three words of each line. An empty line closes a section."""

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), 0), lambda r: F.md5(r)))

    return F.transform(F.split(text, "\n\n", -1), section)


def _parent(level: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(level), F.array_join(children, "")))


def with_tree(rows: DataFrame, text: str) -> DataFrame:
    """Adds the levels of the tree of a text: leaves, paragraphs (by section), sections, root. Each node above hashes its level and its children."""
    rows = rows.withColumn(f"{text}_leaves", leaves(F.col(text)))
    rows = rows.withColumn(f"{text}_paragraphs", F.transform(f"{text}_leaves", lambda s: F.transform(s, lambda p: _parent("p", p))))
    rows = rows.withColumn(f"{text}_sections", F.transform(f"{text}_paragraphs", lambda s: _parent("s", s)))
    return rows.withColumn(f"{text}_root", _parent("r", F.col(f"{text}_sections")))


def nodes(text: str) -> Column:
    """The distinct nodes of all levels of a tree."""
    below = F.concat(F.flatten(F.flatten(f"{text}_leaves")), F.flatten(f"{text}_paragraphs"))
    return F.array_distinct(F.concat(below, F.col(f"{text}_sections"), F.array(f"{text}_root")))


def likeness(nodes_a: Column, nodes_b: Column) -> Column:
    """Twice the number of common nodes over the sum of both numbers: 1 for equal trees only, as others have different roots."""
    return 2.0 * F.size(F.array_intersect(nodes_a, nodes_b)) / (F.size(nodes_a) + F.size(nodes_b))


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 1) of all branches in which two lists of nodes differ, place by place."""
    marks = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.filter(F.transform(marks, lambda m, i: F.when(m, i + 1).otherwise(0)), lambda i: i > 0)


def _blocks(rows: DataFrame, key: str, per_block: int) -> Column:
    """A number that grows with ``key``, with about ``per_block`` rows each: two levels of bounds, each a short list."""
    n = rows.count()
    side = min(MOST_BOUNDS, max(2, math.ceil(math.sqrt(n / per_block))))
    at = [i / (side * side) for i in range(1, side * side)]
    bounds = rows.agg(F.percentile_approx(key, at, 20 * side * side)).first()[0]
    if not bounds:
        return F.lit(0)
    coarse = bounds[side - 1 :: side]
    fine = [bounds[i : i + side - 1] for i in range(0, len(bounds), side)]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(key)))
    longs = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    upper = below(longs(coarse))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(upper * side + below(F.element_at(F.array(*[longs(x) for x in fine]), upper + 1)))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row by descending id; after the last row the first.

    Rows are cut into blocks of neighbouring ids, shuffled once. Each block also gets the first row of the block that follows, so
    no row looks beyond its block. Null ids come last; rows with equal ids are in order of their texts, the greatest first.
    A null text is empty.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    numbered = rows.withColumn("_block", _blocks(rows.select("_id"), "_id", per_block))
    # one row for each of at most 90,001 blocks
    tops = numbered.groupBy("_block").agg(F.max("_id").alias("_top")).orderBy(F.desc("_block")).collect()
    pairs = [(after["_top"], before["_block"]) for before, after in zip(tops, tops[1:] + tops[:1], strict=True)]
    first = F.broadcast(docs.sparkSession.createDataFrame(pairs, "_top long, _to int"))
    order = Window.partitionBy("_id").orderBy(F.desc("_text"))
    heads = rows.join(first, F.col("_id").eqNullSafe(F.col("_top"))).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    both = numbered.select("_id", "_text", F.col("_block").cast("int").alias("_block"), F.lit(False).alias("_copy")).unionByName(
        heads.select("_id", "_text", F.col("_to").alias("_block"), F.lit(True).alias("_copy"))
    )
    within = Window.partitionBy("_block").orderBy("_copy", F.desc_nulls_last("_id"), F.desc("_text"))
    paired = both.withColumn("_next", F.lead("_text").over(within)).filter(~F.col("_copy"))
    return paired.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_next").alias("next_text"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third is the start of the next text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections,
    n_paragraphs, changed_sections (numbers of the sections in which the two trees differ, joined by commas), n_changed (paragraphs that
    differ) and first_change (the first of them, 0 for equal trees). Texts are equal if their fingerprints are, and lines in another order or repeated
    make another tree: runs that both texts have count, the nodes above them do not. Null texts are empty; a single row is its own next one; repeated rows are answered each.
    """
    third = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring("text", F.lit(1), third.cast("int")), F.substring("next_text", F.lit(1), F.floor(F.col("n_chars") / 3).cast("int")))
    rows = with_next(docs, doc_id, text, per_block).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    for c in ("text", "edited", "next_text"):
        rows = with_tree(rows, c).withColumn(f"{c}_nodes", nodes(c))
    changed = differing(F.flatten("text_paragraphs"), F.flatten("edited_paragraphs"))
    rows = rows.withColumn("changed", changed).withColumn("changed_sections", differing(F.col("text_sections"), F.col("edited_sections")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("text_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("text_nodes"), F.col("edited_nodes")).alias("near_edited"),
        likeness(F.col("text_nodes"), F.col("next_text_nodes")).alias("near_next"),
        F.size("text_sections").alias("n_sections"),
        F.size(F.flatten("text_paragraphs")).alias("n_paragraphs"),
        F.array_join(F.col("changed_sections").cast("array<string>"), ",").alias("changed_sections"),
        F.size("changed").alias("n_changed"),
        F.coalesce(F.get("changed", F.lit(0)), F.lit(0)).alias("first_change"),
    )


def fingerprints_sql() -> str:
    """DuckDB SQL with the rows of ``fingerprints`` over documents."""

    def below(c: str) -> str:
        runs = f"list_transform(regexp_extract_all(p, '{RUN}'), lambda r: md5(r))"
        return f"list_transform(string_split({c}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {runs}))"

    def joined(level: str, children: str) -> str:
        return f"md5('{level}' || array_to_string({children}, ''))"

    def all_nodes(c: str) -> str:
        return f"list_distinct(flatten(flatten(l_{c})) || flatten(p_{c}) || s_{c} || [r_{c}])"

    def near(c: str) -> str:
        return f"2.0::DOUBLE * len(list_intersect(n_text, n_{c})) / (len(n_text) + len(n_{c}))"

    def parts(a: str, b: str) -> str:
        return f"list_filter(range(1, greatest(len({a}), len({b})) + 1), lambda i: {a}[i] IS DISTINCT FROM {b}[i])"

    kinds = {"text": "text", "edited": "edited", "next": "next_text"}
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, length(text) AS n_chars,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text DESC)) AS next_text
  FROM d),
e AS (SELECT *, substring(text, 1, n_chars - n_chars // 3) || substring(next_text, 1, n_chars // 3) AS edited FROM n),
t1 AS (SELECT *, {", ".join(f"{below(c)} AS l_{k}" for k, c in kinds.items())} FROM e),
t2 AS (SELECT *, {", ".join(f"list_transform(l_{k}, lambda s: list_transform(s, lambda p: {joined('p', 'p')})) AS p_{k}" for k in kinds)} FROM t1),
t3 AS (SELECT *, {", ".join(f"list_transform(p_{k}, lambda s: {joined('s', 's')}) AS s_{k}" for k in kinds)} FROM t2),
t4 AS (SELECT *, {", ".join(f"{joined('r', f's_{k}')} AS r_{k}" for k in kinds)} FROM t3),
t AS (SELECT *, {", ".join(f"{all_nodes(k)} AS n_{k}" for k in kinds)}, flatten(p_text) AS f_text, flatten(p_edited) AS f_edited FROM t4),
c AS (SELECT *, {parts("f_text", "f_edited")} AS changed, {parts("s_text", "s_edited")} AS c_sections FROM t)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, r_text AS fingerprint, r_edited AS edited_fingerprint,
  {near('edited')} AS near_edited, {near('next')} AS near_next, len(s_text)::INT AS n_sections, len(f_text)::INT AS n_paragraphs,
  coalesce(array_to_string(c_sections, ','), '') AS changed_sections, len(changed)::INT AS n_changed, coalesce(changed[1], 0)::INT AS first_change
FROM c"""
