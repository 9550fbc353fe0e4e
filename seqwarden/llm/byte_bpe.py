"""Byte-level BPE as a monoid: texts are encoded by halves, and neighbours are joined up the tree.

Two encodings are joined by encoding a window around their boundary anew. If the window's first id is the
left side's own id there, and its last id the right side's, then every two adjacent ids of the
result stand next to each other in an encoding by the same ranks. A list of ids in which each adjacent pair
is what the pair's own bytes encode to is the encoding of the whole: no merge across one of its
boundaries can come up before the pair's own run would have made it. So the ids outside the window are
final. Otherwise the window doubles; in the end it holds both sides.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import bounded

LEAF_BYTES = 16  # a piece up to this long is merged at once
LEAF_CHARS = 1 << 15  # of a text
LEAF_IDS = 1 << 12  # decoded at once
SCAN = 64  # bytes up to which the lowest rank is found by a scan, beyond by a heap
WINDOW = 2  # ids of either side that are first encoded anew
REMEMBERED = 400_000  # pieces of a worker
CUT = regex.compile(r"(?<=\S) (?=\S)")  # between such characters every match of the pattern ends before the blank


class Memo(dict):
    """The ids of pieces met so far, up to a fixed number; all others are encoded when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encode(piece.encode()))
        if len(self) < REMEMBERED:
            self[piece] = ids
        return ids


class ByteBpe:
    """Encodes and decodes by the ranks of byte strings; ``pattern`` splits texts into pieces encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES, leaf_chars: int = LEAF_CHARS, window: int = WINDOW):
        self.ranks, self.pieces_of = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaf_bytes, self.leaf_chars, self.window = max(1, leaf_bytes), max(1, leaf_chars), max(1, window)
        self.memo = Memo(self.piece)

    @classmethod
    def read(cls, path: str, pattern: str, **sizes: int) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(b): int(i) for b, i in map(bytes.split, lines) if b}, pattern, **sizes)

    def _merge(self, piece: bytes) -> list[int]:
        """The ids of a short piece: of all adjacent parts that form a ranked string the lowest rank merges, leftmost first."""
        if len(piece) > SCAN:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.ranks) + (1 << 31)
        at = list(range(len(piece) + 1))
        cost = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while cost:
            low = min(cost)
            if low == none:
                break
            i = cost.index(low)
            del at[i + 1], cost[i]
            if i < len(cost):
                cost[i] = get(piece[at[i] : at[i + 2]], none)
            if i:
                cost[i - 1] = get(piece[at[i - 1] : at[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(at, at[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for any length: parts in a linked list, candidates in a heap, n log n steps."""
        get, n = self.ranks.get, len(piece)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of its parts has merged since
            alive[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbours' joined bytes."""
        if not left or not right:
            return left or right
        k, bytes_of = self.window, self.bytes_of
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            middle = self._merge(b"".join([bytes_of[i] for i in chain(left[a:], right[:b])]))
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return left[:a] + middle + right[b:]
            k *= 2

    def _halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self._merge(piece)
        half = 1 << ((len(piece) - 1).bit_length() - 1)  # a power of two: runs of one byte merge alike on both sides
        return self.join(self._halves(piece[:half]), self._halves(piece[half:]))

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern; one that has a rank as a whole is that id."""
        whole = self.ranks.get(piece)
        return self._halves(piece) if whole is None else [whole]

    def leaves(self, text: str) -> Iterator[str]:
        """The text from left to right in parts that the pattern never crosses; halved until they are short or cannot be cut."""
        todo = [text]
        while todo:
            part = todo.pop()
            cut = CUT.search(part, len(part) // 2) if len(part) > self.leaf_chars else None
            if cut:
                todo += [part[cut.start() :], part[: cut.start()]]
            else:
                yield part

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text. Between parts that the pattern never crosses, joining is concatenation."""
        of = self.memo.__getitem__
        return np.concatenate([np.fromiter(chain.from_iterable(map(of, self.pieces_of(part))), np.int32) for part in self.leaves(text)])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, concatenated up the tree of halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.cache
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.read(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids), one row per input row: the ids of every whole text by the rank file at ``path``.

    A null or empty text has no ids. Repeated rows, null ids and ties stay as they are; other columns are not
    read. Very long texts are encoded by halves in memory proportional to the text, and few of them are held at once.
    An empty table gives no rows. The rank file must have every single byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in bounded(batches, 1):
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the rows of ``encode_documents`` with the bytes that the ids stand for; null ids are null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                known = part.column(1).is_valid().to_pylist()
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                flat, ends = part.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes).tolist()
                decoded = [coder.decode(flat[b - n : b].tolist()) if there else None for b, n, there in zip(ends, sizes.tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(decoded, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: digests of its ids and of the bytes decoded from them."""
    both = decode_documents(encode_documents(docs, path, pattern, doc_id, text), path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
