"""SimHash near-duplicates, found by a range join over segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwarden.llm.components import connected_components
from seqwarden.session import materialize

WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 16  # of 4 bits each
STRIP = 1 << 16  # shingles whose bits are spread out at once


def fingerprint(text: bytes | None, width: int = WORDS) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    begin, end = starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, last, STRIP):
        part = [digest(joined[i:j], SEED) for i, j in zip(begin[at : at + STRIP], end[at : at + STRIP], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit SimHash, as a signed long, of hashes that each count once; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIP):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + STRIP]).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS) -> DataFrame:
    """(doc_id, fp, text_hash): the SimHash of every whole text as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            signed = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed, batch.column(2)], ["doc_id", "fp", "text_hash"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("h"))
    return narrow.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _cells(fps: DataFrame) -> DataFrame:
    """Each fingerprint in its own grid cell (shift 0) and in all cells one step away.

    A cell is the vector of the numbers of ones in the 16 segments, three bits each.
    """
    width = 64 // SEGMENTS
    ones: list[Column] = [
        F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(SEGMENTS)
    ]
    cell = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(ones)), F.lit(0).cast("long"))
    steps = [F.struct(F.col("cell"), F.lit(0).alias("shift"))]
    for i in range(SEGMENTS):
        n = F.shiftrightunsigned("cell", 3 * i).bitwiseAND(F.lit(7))
        step = 1 << (3 * i)
        steps.append(F.when(n < width, F.struct((F.col("cell") + step).alias("cell"), F.lit(i + 1).alias("shift"))))
        steps.append(F.when(n > 0, F.struct((F.col("cell") - step).alias("cell"), F.lit(-i - 1).alias("shift"))))
    return (
        fps.select("fp", cell.alias("cell"))
        .select("fp", F.explode(F.array(*steps)).alias("s"))
        .filter("s IS NOT NULL")
        .select("fp", "s.cell", "s.shift")
    )


def close_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints that differ in at most 2 bits, each once.

    The Manhattan distance of the segments' numbers of ones is a lower bound of the number of
    differing bits. Two points of the grid at distance 2 or less share a cell when both
    are put into all cells one step away, so an equi-join on the cell finds every pair. Of the
    cells that a pair shares one is kept by the shifts; the bits are compared inside the join.

    Spark takes the cells, 33 rows for each fingerprint, to be as small as the fingerprints, so it is told to sort and never to send them to the driver.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid reaches distance 2: max_bits must be 0, 1 or 2")
    cells = _cells(fps)
    a = cells.select("cell", F.col("fp").alias("a"), F.col("shift").alias("sa"))
    b = cells.select("cell", F.col("fp").alias("b"), F.col("shift").alias("sb"))
    one_meeting = F.expr("(sa = 0) OR (sb <> 0 AND (abs(sa) < abs(sb) OR sa = -sb))")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return a.join(b.hint("merge"), (a.cell == b.cell) & near & one_meeting).select("a", "b")


def _components(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component, component_id) for each distinct fingerprint of ``rows``, a stored table.

    ``component`` is a fingerprint that names the component, and does so even where ids are null or repeated.
    """
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    nodes = connected_components(close_pairs(classes.select("fp"), max_bits), "a", "b")
    linked = materialize(nodes.join(classes.withColumnRenamed("fp", "node"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("smallest"))
    moved = linked.join(least, "component").select(F.col("node").alias("fp"), "component", "smallest")
    named = classes.join(moved, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("smallest", "rep").alias("component_id")
    )
    return materialize(named, "components")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Documents with equal fingerprints form a class before anything is joined, so a text with
    millions of copies is one point of the grid; classes are linked, never copies.
    ``component_id`` is the smallest doc_id of all classes that links reach. A null text is
    empty and has fingerprint zero, as has a text without words. Repeated rows stay repeated. A null
    doc_id is returned and never is the smallest; a component of such rows only has a null id.
    """
    rows = materialize(with_fingerprints(docs, doc_id, text, width), "fingerprints")
    return rows.join(_components(rows, max_bits).hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all columns.

    The row with the component's smallest id stays; of several such rows the first by a hash
    of the text. A component whose ids are all null keeps one row too. Unlinked texts that share an id, or have none, all stay.
    """
    rows = materialize(with_fingerprints(docs, doc_id, text, width), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    best_of = rows.groupBy("fp").agg(first)
    kept = best_of.join(_components(rows, max_bits), "fp").groupBy("component").agg(F.min("first").alias("first"))
    return kept_rows(docs, kept, doc_id, text)


def kept_rows(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each distinct id and text hash in ``kept.first``."""
    kept = materialize(kept.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_of")).distinct(), "kept")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(doc_id).cast("long").alias("_doc"), F.xxhash64(text).alias("_hash"))
    same = named.join(kept.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of")))
    best = same.withColumn("_n", F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy("_hash")))
    return best.filter("_n = 1").select("_row.*")
