"""Language identification with n-gram Bloom filters whose slots hold a bit for each language."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import releasing

GRAM = 4
HASHES = 3
SLOT_BITS = 20
DOCS_PER_LANGUAGE = 4_000  # bound of the labelled sample, by hash of the text
MAX_LANGUAGES = 64
MIN_RATE = 1 / 2_000  # of a language's sampled documents must hold an n-gram
SHARE = 0.3  # of the n-gram's frequency in the language that uses it most
STRIP = 1 << 17
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # odd, for multiplicative hashing


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of all character n-grams of the lower-cased words; a run of other characters is one gap.

    Empty for a text without letters.
    """
    codes = np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 0)[keep].astype(np.uint64)
    codes = np.concatenate(([0], codes, np.zeros(max(1, GRAM - 1 - len(codes)), np.uint64))).astype(np.uint64)
    n = len(codes) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ codes[i : i + n]) * FACTORS[0]
        h ^= h >> np.uint64(29)
    return h


def slots(h: np.ndarray, slot_bits: int = SLOT_BITS) -> list[np.ndarray]:
    """The places of each hash in the filter, one array for each of the hash functions."""
    return [(h * f) >> np.uint64(64 - slot_bits) for f in FACTORS[:HASHES]]


@dataclass(frozen=True)
class LanguageModel:
    """``table[slot]`` is a bit mask of languages; ``false_rate`` the share of foreign n-grams each filter accepts."""

    languages: tuple[str, ...]
    table: np.ndarray
    false_rate: np.ndarray
    slot_bits: int = SLOT_BITS

    def scores(self, text: str | None) -> np.ndarray | None:
        """Share of the text's n-grams in each language, corrected for false positives; None without letters."""
        h = grams(text or "")
        if not len(h):
            return None
        hits = np.zeros(len(self.languages))
        for at in range(0, len(h), STRIP):
            found = ~np.uint64(0)
            for s in slots(h[at : at + STRIP], self.slot_bits):
                found = found & self.table[s]
            hits += [np.count_nonzero(found & np.uint64(1 << i)) for i in range(len(self.languages))]
        return np.clip((hits / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE, slot_bits: int = SLOT_BITS) -> LanguageModel:
    """Learns the filters from labelled rows; rows with a null text or label are left out.

    About ``per_language`` documents of each language are read, chosen by a hash of the text;
    the number of labelled rows is counted over all of them. A language enters an n-gram
    if at least ``MIN_RATE`` of its documents hold it, and ``SHARE`` as often as where it is most
    frequent. Only the filter's slots reach the driver: at most 2 ** ``slot_bits`` rows.
    The ``MAX_LANGUAGES`` labels with most rows are learned.
    """
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).dropna()
    known = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()
    names = tuple(sorted(r["l"] for r in known))
    if not names:
        return LanguageModel((), np.zeros(1 << slot_bits, np.uint64), np.zeros(0), slot_bits)
    number = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    limit = F.create_map(*[F.lit(x) for r in known for x in (r["l"], min(1.0, per_language / r["count"]))])
    drawn = rows.filter(F.col("l").isin(*names)).filter(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) < limit[F.col("l")] * 1_000_003)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, group in batch.groupby("n"):
                docs_of = [np.unique(grams(t)) for t in group["t"]]
                h, df = np.unique(np.concatenate(docs_of), return_counts=True)
                yield pd.DataFrame({"n": np.full(len(h) + 1, i, np.int32), "h": np.append(h.view(np.int64), 0), "df": np.append(df, 0), "docs": np.append(np.zeros(len(h), np.int64), len(group))})

    counted = drawn.select(number[F.col("l")].alias("n"), "t").mapInPandas(count, "n int, h long, df long, docs long")
    counted = counted.groupBy("n", "h").agg(F.sum("df").alias("df"), F.sum("docs").alias("docs")).persist()
    docs_of = {r["n"]: r["d"] for r in counted.groupBy("n").agg(F.sum("docs").alias("d")).collect()}
    size = F.create_map(*[F.lit(x) for n, d in docs_of.items() for x in (n, float(max(1, d)))]) if docs_of else F.create_map(F.lit(0), F.lit(1.0))
    rate = counted.select("h", "n", (F.col("df") / size[F.col("n")]).alias("rate")).filter((F.col("rate") >= MIN_RATE) & (F.col("rate") > 0))
    listed = rate.groupBy("h").agg(F.max("rate").alias("most"), F.collect_list(F.struct("n", "rate")).alias("of"))  # a row for each language at most
    mask = F.aggregate(F.expr(f"filter(of, x -> x.rate >= {SHARE} * most)"), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["n"])))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.concatenate(slots(batch["h"].to_numpy(np.int64).view(np.uint64), slot_bits)).astype(np.int64)
            yield pd.DataFrame({"slot": s, "mask": np.tile(batch["mask"].to_numpy(np.int64), HASHES)})

    placed = listed.select("h", mask.alias("mask")).mapInPandas(place, "slot long, mask long")
    filled = placed.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    counted.unpersist()
    table = np.zeros(1 << slot_bits, np.uint64)
    table[filled["slot"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(table & np.uint64(1 << i)) / len(table) for i in range(len(names))])
    return LanguageModel(names, table, np.minimum(fill**HASHES, 0.99), slot_bits)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, coverage) for every row, from the whole text and nothing else.

    ``coverage`` is the corrected share of the text's n-grams that the predicted language has,
    ``score`` its part of the sum over all languages. Ties go to the first name in the alphabet.
    A text that is null or without letters, or a model of no language, gives ``und``, 0 and 0.
    Repeated rows are answered each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** slot_bits masks

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[tuple[str, float, float]] = []
            for x in batch.column(1):
                s = m.scores(x.as_py()) if m.languages else None
                best = None if s is None else int(s.argmax())
                out.append((UNKNOWN, 0.0, 0.0) if best is None else (m.languages[best], float(s[best] / (s.sum() or 1)), float(s[best])))
            a, b, c = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.float64())],
                ["doc_id", "lang_pred", "score", "coverage"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, coverage double"
    )


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that is kept from learning; null ids belong to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def keep_identified(docs: DataFrame, model: LanguageModel, min_coverage: float, text: str = "text") -> DataFrame:
    """The rows whose text has letters and of whose n-grams a language has ``min_coverage`` at least; all columns stay.

    A model of no language keeps every text with a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text.lower())

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = []
            for x in batch.column(at):
                t = x.as_py()
                s = m.scores(t) if m.languages else np.ones(1) if len(grams(t or "")) else None
                keep.append(s is not None and bool(s.max() >= min_coverage))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
