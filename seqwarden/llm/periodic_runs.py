"""Runs of words with a short period, from a suffix automaton whose links are accessed as a link-cut tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import bounded

LEAST_LENGTH = 6  # words of a run
EXPONENT = 4  # periods of a run
BLANKS = "[\\x20\\x09-\\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def automaton(words: Sequence[Hashable]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of each prefix) of the suffix automaton; states count from 1, the empty word is state 1 with link 0."""
    follow: list[dict] = [{}, {}]
    link, length, prefix, last = [0, 0], [0, 0], [], 1
    for w in words:
        new = len(link)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p and follow[p].get(w) == q:
                    follow[p][w] = clone
                    p = link[p]
        prefix.append(new)
        last = new
    return link, length, prefix


class LinkPaths:
    """The tree of suffix links as preferred paths, each a splay tree by depth, with one last occurrence for a whole path.

    ``access`` makes the path from a state to the root one preferred path and reports the parts of other paths that it
    takes over. Splay trees keep the last occurrence at their root only.
    """

    def __init__(self, link: list[int], length: list[int]):
        self.up, self.length = link.copy(), length
        self.left, self.right, self.last = ([0] * len(link) for _ in range(3))

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = 0
        while (y := up[x]) and ((on_left := left[y] == x) or right[y] == x):
            z = up[y]
            if z and ((y_left := left[z] == y) or right[z] == y):
                top = z
                turns = (y, x) if on_left == y_left else (x, x)
            else:
                top, turns = y, (x,)
            for v in turns:
                p = up[v]
                g = up[p]
                if left[p] == v:
                    c = left[p] = right[v]
                    right[v] = p
                else:
                    c = right[p] = left[v]
                    left[v] = p
                if c:
                    up[c] = p
                if g:
                    if left[g] == p:
                        left[g] = v
                    elif right[g] == p:
                        right[g] = v
                up[p], up[v] = v, g
        if top:
            self.last[x] = self.last[top]

    def access(self, state: int, now: int) -> list[tuple[int, int]]:
        """(length of the longest word, last occurrence before ``now``) of each part of the path, the deepest part first."""
        up, right, last, taken, lower, x = self.up, self.right, self.last, [], 0, state
        while x:
            self._splay(x)
            taken.append((self.length[x], last[x]))
            if below := right[x]:
                last[below] = last[x]
            right[x] = lower
            lower, x = x, up[x]
        self._splay(state)
        last[state] = now
        return taken


def squares_to_runs(words: Sequence[Hashable]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least two periods, by end of its first square.

    When word i is appended, a part of the link path with last end j and longest word L says that L is all that the texts up
    to i and up to j have in common at their ends. If i - j <= L the distance is the smallest period of a square that
    ends at i, and L tells where the run begins; its end is found by comparing on. A distance whose run reaches beyond i is done.
    """
    link, length, prefix = automaton(words)
    paths, n, reach, found = LinkPaths(link, length), len(words), {}, []
    access, none = paths.access, -1
    for i, state in enumerate(prefix, 1):
        for common, j in access(state, i):
            period = i - j
            if j and period <= common and reach.get(period, none) < i:
                end = i
                while end < n and words[end] == words[end - period]:
                    end += 1
                reach[period] = end
                found.append((j - common, end - j + common, period))
    return found


def _stretches(words: list, begin: int, end: int, least: int, copies: int) -> Iterator[tuple[int, int]]:
    """The parts of words[begin:end] that can hold a run: every word of a run of that exponent occurs ``copies`` times in it."""
    todo = [(begin, end)]
    while todo:
        begin, end = todo.pop()
        if end - begin < least:
            continue
        often = {w for w, n in Counter(words[begin:end]).items() if n >= copies}
        flags = bytes(map(often.__contains__, words[begin:end]))
        if b"\0" not in flags:
            yield begin, end
        else:
            todo += [(begin + m.start(), begin + m.end()) for m in re.finditer(b"\1{%d,}" % least, flags)]


def find_runs(words: list, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with ``length >= max(least, exponent * period)``, by start, then period.

    A run never holds a word that occurs fewer than ``exponent`` times in the stretch around it, so the automaton
    is built between such words only; nothing is lost by that.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    found = []
    for begin, end in _stretches(words, 0, len(words), max(least, exponent), exponent):
        for start, length, period in squares_to_runs(words[begin:end]):
            if length >= max(least, exponent * period):
                found.append((begin + start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that some run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.nonzero(keep)[0].tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per input row, over whole texts.

    Words are separated by ASCII white space. ``runs`` holds all runs as (start, length, period) by start, then period;
    ``collapsed`` joins by one blank the words that no run contains after its first period. A null, empty or blank text
    has no words, no runs and an empty ``collapsed``. A text takes memory in proportion to its words and n log n steps;
    few long texts are held at once. Repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            n_words, runs, kept = [], [], []
            for t in batch.column(1).to_pylist():
                words = (t or b"").split()  # of bytes: splits at ASCII white space only
                found = find_runs(words, least, exponent)
                n_words.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(collapse(words, found)))
            shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, shape), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    return narrow.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def with_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns of ``docs``; of every tenth document by the checksum of its id the words from some place on repeat with a period.

    With h = crc32(decimal id) and g = floor(h / 10), where h % 10 = 0 word i >= a is word a + (i - a) % p, a = g % n,
    p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as not chosen.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), BLANKS), lambda w: w != "")
    n = F.when(F.col("n") > 0, F.col("n"))
    a, rest = (F.col("g") % n).cast("int"), (n - F.col("g") % n).cast("int")
    period = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    rounds = F.ceil(rest / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, period), rounds)), F.lit(1), rest)
    chosen = F.col("h") % 10 == 0
    parts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("h"), g.alias("g"))
    parts = parts.withColumn("w", F.when(chosen, words)).withColumn("n", F.size("w"))
    changed = F.when(chosen & (n > 0), F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")).otherwise(F.col("text"))
    return parts.select("doc_id", changed.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each row (of several the first by start, then period) and digests of all runs and of the collapsed text."""
    best: Column = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("-best.l * 1000 div best.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
