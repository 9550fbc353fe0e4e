"""Packing of tokenized documents into sequences by bounded-space best fit."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import bounded, releasing
from seqwarden.session import materialize

LENGTH = 2048
END = 0  # the id that closes every document
OPEN_BINS = 1024
PIECES_PER_TASK = 100_000
REMEMBERED_WORDS = 1 << 16  # of a worker
MARK = "\x01"
JOINED = 256
LINES_AT_ONCE = 8  # what the tokenizer tells of a token takes hundreds of bytes
TEXT_AT_ONCE = 2 << 20  # bytes of text whose words are encoded together
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """The ids of distinct words; units that a worker meets first are remembered, up to a fixed number.

    A plain word is Latin letters and then ASCII marks: two units, which this vocabulary always
    splits and whose small letters it takes. The tokenizer without its normalizer and pattern gives the
    same ids for such units, in half the time. All other words go through the tokenizer as it is.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.units = Tokenizer(self.whole.model)  # one vocabulary for both
        split = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.units.pre_tokenizer = pre_tokenizers.Sequence(split)
        self.mark_id = self.units.encode(MARK, add_special_tokens=False).ids
        self.place: dict[str, int] = {"": 0}
        self.seen: dict[str, tuple[int, int]] = {"": (0, 0)}
        self.size, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes many plain units in one text, with a mark of one id between them."""
        between = f" {MARK} "
        found = [np.empty(0, np.uint32)]
        for at in range(0, len(units), JOINED * LINES_AT_ONCE):
            some = units[at : at + JOINED * LINES_AT_ONCE]
            lines = [between.join(some[i : i + JOINED]) + between for i in range(0, len(some), JOINED)]
            found += [np.array(e.ids, np.uint32) for e in self.units.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(found)
        mark = ids == self.mark_id[0]
        return np.diff(np.nonzero(mark)[0], prepend=-1) - 1, ids[~mark]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids)."""
        plain, place, seen = self.PLAIN.fullmatch, self.place, self.seen
        new: dict[str, int] = {}
        odd: list[str] = []
        n = len(self.size)
        at: list[tuple[int, int]] = []
        for w in words:
            if (pair := seen.get(w)) is None:
                if m := plain(w):
                    a, b = m[1].lower(), m[2]
                    i = place.get(a)
                    j = place.get(b)
                    if i is None:
                        i = new.setdefault(a, n + len(new))
                    if j is None:
                        j = new.setdefault(b, n + len(new))
                    pair = (i, j)
                    if len(seen) < REMEMBERED_WORDS and i < REMEMBERED_WORDS and j < REMEMBERED_WORDS:
                        seen[w] = pair
                else:
                    odd.append(w)
                    pair = (-len(odd), 0)
            at.append(pair)
        size, flat = self._encode(list(new))
        size, flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
        if (room := REMEMBERED_WORDS - n) > 0:
            place |= {u: i for u, i in new.items() if i < n + room}
            self.size = size[: n + room]
            self.flat = flat[: int(self.size.sum())]
        each = [self.text(w) for w in odd]
        code = np.array(at, np.int64).reshape(-1)
        code[code < 0] = len(size) - 1 - code[code < 0]
        size = np.concatenate((size, np.fromiter(map(len, each), np.int64, len(each))))
        flat = np.concatenate([flat, *each])
        start, size = (np.cumsum(size) - size)[code], size[code]
        return size.reshape(-1, 2).sum(axis=1), flat[np.repeat(start, size) + _numbers(size)]


@functools.cache
def _tokenizer(path: str) -> WordIds:
    return WordIds(path)


def _numbers(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. n-1 for each n of ``lengths``, joined."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each text, all ids): what the tokenizer gives for each whole text.

    This vocabulary drops white space and never joins characters across it, so each
    distinct word of a batch is encoded once. Texts with the separators U+001C to U+001F, which
    are white space to Arrow but not to the tokenizer, are encoded whole.
    """
    word_ids = _tokenizer(path)
    odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False)
    words = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts))
    in_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    size, flat = word_ids(coded.dictionary.to_pylist())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_word = size[code]
    ids = flat[np.repeat((np.cumsum(size) - size)[code], in_word) + _numbers(in_word)]
    at = np.concatenate(([0], np.cumsum(in_word)))[np.concatenate(([0], np.cumsum(in_text)))]
    counts = np.diff(at)
    if odd.any():
        parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.nonzero(odd)[0]:
            parts[i] = word_ids.text(texts[int(i)].as_py())
        counts, ids = np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
    return counts, ids


def cut(batches: Iterator[pa.RecordBatch], path: str, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The pieces of batches (doc_id, text), a few megabytes of text at once."""
    for batch in bounded(batches, 1, TEXT_AT_ONCE):
        counts, ids = encode(pc.fill_null(batch.column(1).cast(pa.large_string()), ""), path)
        ids = ids.astype("<u4", copy=False)
        ends = np.cumsum(counts)
        n = -(-(counts + 1) // length)
        doc = np.repeat(np.arange(len(counts)), n)
        piece = _numbers(n)
        start = piece * length
        size = np.minimum(counts[doc] + 1 - start, length)
        closing = np.array([END], "<u4").tobytes()
        crc = []
        for d, s, e in zip(doc.tolist(), start.tolist(), (start + size).tolist(), strict=True):
            last, base = int(counts[d]), int(ends[d] - counts[d])
            c = zlib.crc32(ids[base + s : base + min(e, last)].tobytes())
            crc.append(zlib.crc32(closing, c) if e > last else c)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )
        del ids
        pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece of at most ``length`` ids; only longer documents are cut."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, path, length)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, PIECE)


class OpenBins:
    """A fixed number of open bins, found by their free space through the bits of one number."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.by_free, self.n_open, self.made = 0, [[] for _ in range(length + 1)], 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def _put(self, number: int, free: int) -> None:
        if free:
            self.by_free[free].append(number)
            self.bits |= 1 << free
            self.n_open += 1

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) in the open bin that fits best; without one a bin is opened, and the fullest closes."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, free = self.made, self.length
            self.made += 1
        self._put(number, free - size)
        return number, self.length - free


def pack(rows: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length``; ``rows`` must be a stored table.

    Rows are dealt out evenly whatever their keys, ``per_task`` of them to a task, and each task
    packs its own bins in one pass with bounded memory. Every task leaves at most ``open_bins`` bins
    unfilled, which is little against the tens of thousands it fills.
    """
    tasks = max(1, -(-rows.count() // per_task))
    names = rows.columns

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(length, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(names.index("length")).to_pylist()]
            number, offset = (np.array(x, np.int64) for x in zip(*placed, strict=True)) if placed else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number + base), pa.array(offset)], [*names, "sequence_id", "offset"])

    mixed = rows.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece")
    return mixed.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A document is its ids and then id 0, so an empty or null text is one piece of length 1.
    Repeated rows and null ids are packed like others. An empty table gives no rows.
    """
    return pack(materialize(pieces(docs, path, doc_id, text, length), "pieces"), length, open_bins)
