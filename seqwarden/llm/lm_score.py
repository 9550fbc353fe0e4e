"""Masked pseudo-likelihood: each token is predicted from both sides by a window network trained on the corpus.

The network predicts a frequent word itself and of every other word its length in bytes. Which word of that length it is
has an exact probability of its own, from the counts of the corpus: a share for words in a list that grows with the
corpus, the rest by spelling, byte after byte. So the probabilities of all words, known or not, sum to one at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwarden.llm.batches import bounded
from seqwarden.session import materialize, tables_of

SIDE = 2  # tokens seen on either side
BUCKETS = 64  # ids of the words that the network does not know, by their length in bytes
CLASSES = 32
VOCABULARY = CLASSES * CLASSES  # ids, buckets included: two steps of a softmax over 32
KNOWN = VOCABULARY - BUCKETS
MOST_LISTED = 1 << 18  # listed words at most, but for chance among words of one count: they are broadcast, about 6 MB
LISTED_PER_ROOT = 8  # listed words for each root of the number of tokens
MOST_SLOT_BITS = 13  # of the contexts of the spelling, 1 KB a slot
DIM = 16
ROUNDS = 3  # averaging rounds, each over its own third of the documents
BATCH = 8192
RATE = 0.1
MODELS = 2048  # local models of a round at most
STRIP = 1 << 16
WEIGHTS = ("e", "b", "wc", "bc", "ww", "bw")


@dataclass(frozen=True)
class Spelling:
    """log P(word | its bucket) of the words that the network does not know."""

    table: np.ndarray  # log P(byte | slot of the three bytes before), slot by byte
    listed: np.ndarray  # of each listed word, by rank; of those that the network knows unused
    unlisted: np.ndarray  # log of the share that the other words of a bucket have
    longer: float  # P(one byte more) of words in the last bucket, which holds all greater lengths

    def spelled(self, words: pa.Array) -> np.ndarray:
        """By the bytes alone; the words are not empty."""
        data, starts, lengths = word_bytes(words)
        if not len(starts):
            return np.empty(0)
        logs = np.empty(len(data))
        for at in range(0, len(data), STRIP):
            to = min(len(data), at + STRIP)
            logs[at:to] = self.table.ravel()[cells(data, starts, len(self.table), at, to)]
        beyond = lengths - (BUCKETS - 1)
        return np.add.reduceat(logs, starts) + np.where(beyond >= 0, np.maximum(beyond, 0) * math.log(self.longer) + math.log1p(-self.longer), 0.0)


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, where each word starts, its length)."""
    words = pa.concat_arrays([words.cast(pa.large_string())])
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(lengths):
        return np.empty(0, np.uint8), lengths, lengths
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], lengths


def cells(data: np.ndarray, starts: np.ndarray, slots: int, at: int, to: int) -> np.ndarray:
    """The place (slot of the three bytes before in the same word, byte) in the table of each byte from ``at`` to ``to``."""
    low = max(0, at - 3)
    part = data[low:to].astype(np.uint32)
    inside = starts[np.searchsorted(starts, low) : np.searchsorted(starts, to)] - low
    before = np.zeros(len(part), np.uint32)
    shifted = part
    for k in range(3):
        shifted = np.concatenate((np.zeros(1, np.uint32), shifted[:-1]))
        shifted[inside] = 0
        before |= shifted << np.uint32(8 * k)
    slot = (before * np.uint32(0x9E3779B1)) >> np.uint32(32 - (slots.bit_length() - 1))
    return (slot.astype(np.int64) * 256 + part)[at - low :]


@dataclass(frozen=True)
class Network:
    """Weights: an embedding for each place of the window, a hidden layer, and a softmax in two steps."""

    words: tuple[str, ...]  # by falling count: the first ``KNOWN`` are known to the network, the others listed
    spelling: Spelling | None  # None while it is trained
    e: np.ndarray  # place, id (or padding), hidden
    b: np.ndarray
    wc: np.ndarray  # class, hidden
    bc: np.ndarray
    ww: np.ndarray  # class, word in class, hidden
    bw: np.ndarray

    @staticmethod
    def start(words: tuple[str, ...], spelling: Spelling | None, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return Network(words, spelling, draw(2 * SIDE, VOCABULARY + 1, DIM), zero(DIM), draw(CLASSES, DIM), zero(CLASSES), draw(CLASSES, CLASSES, DIM), zero(CLASSES, CLASSES))

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in WEIGHTS]

    def with_weights(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name in WEIGHTS:
            old = getattr(self, name)
            out[name] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return replace(self, **out)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.e[i][context[:, i]] for i in range(2 * SIDE)) + self.b)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target id given the ids around it."""
        h = self.hidden(context)
        out = np.empty(len(target))
        c, w = target // CLASSES, target % CLASSES
        for k, at in _by_class(c):
            z = h[at] @ self.ww[k].T + self.bw[k]
            out[at] = z[np.arange(len(at)), w[at]] - _log_sum(z)
        z = h @ self.wc.T + self.bc
        return out + z[np.arange(len(target)), c] - _log_sum(z)

    def gradients(self, context: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability, in the order of ``weights``."""
        n, h = len(target), self.hidden(context)
        c, w = target // CLASSES, target % CLASSES
        dc = _softmax(h @ self.wc.T + self.bc)
        dc[np.arange(n), c] -= 1
        dc /= n
        dh = dc @ self.wc
        dww, dbw = np.zeros_like(self.ww), np.zeros_like(self.bw)
        for k, at in _by_class(c):
            d = _softmax(h[at] @ self.ww[k].T + self.bw[k])
            d[np.arange(len(at)), w[at]] -= 1
            d /= n
            dww[k], dbw[k] = d.T @ h[at], d.sum(axis=0)
            dh[at] += d @ self.ww[k]
        dh *= 1 - h * h
        de = np.empty_like(self.e)
        columns = np.ascontiguousarray(dh.T)
        for i in range(2 * SIDE):
            ids = np.ascontiguousarray(context[:, i])
            for j in range(DIM):
                de[i, :, j] = np.bincount(ids, columns[j], VOCABULARY + 1)
        return [de, dh.sum(axis=0), dc.T @ h, dc.sum(axis=0), dww, dbw]


def _by_class(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(c.astype(np.int16), kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=CLASSES))))
    for k in range(CLASSES):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    return np.log(np.exp(z - top[:, None]).sum(axis=1)) + top


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _words(texts: pa.Array) -> pa.Array:
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))


def token_ids(texts: pa.Array, words: pa.Array, spelling: Spelling | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, all ids, log P(token | id)): the network's words by rank, others by their length.

    The last is 0 where the id says all, and throughout if no spelling is given.
    """
    lists = _words(texts)
    flat = lists.flatten()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    real = lengths > 0
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    counts = np.bincount(owner[real], minlength=len(lists))
    if not real.all():
        flat, lengths = flat.filter(pa.array(real)), lengths[real]
    rank = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False)
    rare = (rank < 0) | (rank >= KNOWN)
    bucket = np.minimum(lengths, BUCKETS - 1)
    ids = np.where(rare, bucket + KNOWN, rank).astype(np.int64)
    inside = np.zeros(len(ids))
    if spelling is not None:
        listed, other = rare & (rank >= 0), rank < 0
        inside[listed] = spelling.listed[rank[listed]]
        if other.any():
            inside[other] = spelling.unlisted[bucket[other]] + spelling.spelled(flat.filter(pa.array(other)))
    return counts, ids, inside


def windows(counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the padding id between texts, place of each token there), from which ``around`` reads windows."""
    place = np.arange(len(ids)) + (2 * np.repeat(np.arange(len(counts)), counts) + 1) * SIDE
    padded = np.full(len(ids) + 2 * SIDE * len(counts), VOCABULARY, np.int64)
    padded[place] = ids
    return padded, place


def around(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The ids on both sides of each place; beyond the ends of a text the padding id."""
    return np.stack([padded[place + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            found = _words(batch.column(0).cast(pa.large_string())).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    counted = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "word string, n long").filter("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """About the ``limit`` most frequent words, without a sort of all words.

    How many words have each count says at which count the limit falls. Words above it are taken, and of those at it, which may
    be most of the table, a share by hash. There are at most as many counts as twice the root of the tokens.
    """
    of_count = counted.groupBy("n").agg(F.count(F.lit(1)).alias("ties"))
    upto = F.sum("ties").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = of_count.withColumn("upto", upto).filter(F.col("upto") > limit).orderBy(F.desc("n")).first()
    if cut is None:
        return counted
    share = int((limit - (cut["upto"] - cut["ties"])) / cut["ties"] * (1 << 30))
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share
    return counted.filter((F.col("n") > cut["n"]) | ((F.col("n") == cut["n"]) & chosen))


def learn_words(docs: DataFrame, text: str = "text") -> tuple[tuple[str, ...], Spelling]:
    """The listed words by falling count, words of one count in their order, and the shares and spelling of those beyond the network's.

    The words and their counts are written once, a table that grows with the corpus. To the driver come its totals, at
    about ``MOST_LISTED`` words, and counts of the cells of the spelling, of which there are 2 ** ``MOST_SLOT_BITS`` * 256 at most.
    Both numbers grow with the corpus up to there; words that are not listed are spelled. The spelling is learned from the
    occurrences of words beyond the network's and from one of each that it knows.
    """
    counted = materialize(count_words(docs, text), "words")
    size = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    limit = min(MOST_LISTED, KNOWN + LISTED_PER_ROOT * math.isqrt(size.tokens))
    most = sorted(_most_frequent(counted, limit).collect(), key=lambda r: (-r["n"], r["word"]))
    words = tuple(r["word"] for r in most)
    slots = 1 << min(MOST_SLOT_BITS, max(4, size.words.bit_length() - 7))
    known = docs.sparkSession.sparkContext.broadcast(words[:KNOWN])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, value_set = np.zeros(slots * 256), pa.array(known.value, pa.string())
        for batch in bounded(batches, 0):
            data, starts, lengths = word_bytes(batch.column(0))
            n = batch.column(1).to_numpy(zero_copy_only=False).copy()
            n[pc.is_in(batch.column(0), value_set=value_set).to_numpy(zero_copy_only=False)] = 1
            n = np.repeat(n, lengths)
            for at in range(0, len(data), STRIP):
                to = min(len(data), at + STRIP)
                np.add.at(seen, cells(data, starts, slots, at, to), n[at:to])
        found = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["cell", "n"])

    summed = counted.mapInArrow(spell, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(slots * 256)
    seen[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float64)
    seen = seen.reshape(slots, 256)
    # any byte is possible everywhere: a slot counts as one byte more, spread as all bytes are, these as 256 more
    alike = (seen.sum(axis=0) + 1) / (seen.sum() + 256)
    table = np.log((seen + alike) / (seen.sum(axis=1, keepdims=True) + 1)).astype(np.float32)

    length = F.octet_length("word")
    beyond = F.greatest(length - (BUCKETS - 1), F.lit(0))
    totals = counted.groupBy(F.least(length, F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * beyond).alias("beyond")).collect()
    of_bucket, excess = np.zeros(BUCKETS), 0
    for r in totals:
        of_bucket[r["b"]] = r["n"]
        excess += r["beyond"]
    longer = (excess + 1) / (excess + of_bucket[-1] + 2)

    n = np.array([r["n"] for r in most], np.float64)
    buckets = np.array([min(len(w.encode()), BUCKETS - 1) for w in words], np.int64)
    of_bucket -= np.bincount(buckets[:KNOWN], n[:KNOWN], BUCKETS)
    listed = np.bincount(buckets[KNOWN:], n[KNOWN:], BUCKETS)
    unlisted = np.log((of_bucket - listed + 1) / (of_bucket + 1))
    plain = Spelling(table, np.zeros(len(words)), unlisted, longer)
    own = plain.spelled(pa.array(words, pa.large_string()))
    share = np.log(np.maximum(n, 1)) - np.log(of_bucket[buckets] + 1)
    return words, replace(plain, listed=np.logaddexp(share, unlisted[buckets] + own))


def train(docs: DataFrame, text: str = "text", seed: int = 11) -> Network:
    """Learns from every window of all documents in ``ROUNDS`` rounds of parameter averaging.

    In a round every task starts from the last average and follows the gradients of its own windows; documents are dealt
    to rounds by a hash of their text, so that each window is learned from once. The weights are summed in a
    shuffle by their number, so only one model, of a fixed size, reaches the driver.
    """
    with tables_of(docs.sparkSession):
        learned = learn_words(docs, text)  # read in full here, so that the counts may go
    net = Network.start(*learned, seed)
    rows = docs.select(F.col(text).cast("string").alias("t")).filter("t IS NOT NULL")
    size = sum(w.size for w in net.weights())
    for turn in range(ROUNDS):
        # the words beyond the network's do not matter here
        shared = docs.sparkSession.sparkContext.broadcast(replace(net, words=net.words[:KNOWN], spelling=None))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = shared.value
            words, rng = pa.array(own.words, pa.large_string()), np.random.default_rng(turn)
            weights = [w.copy() for w in own.weights()]
            moved = replace(own, **dict(zip(WEIGHTS, weights, strict=True)))
            squares = [np.full_like(w, 1e-6) for w in weights]
            seen = 0
            for batch in bounded(batches, 0):
                counts, ids, _ = token_ids(batch.column(0).cast(pa.large_string()), words)
                padded, place = windows(counts, ids)
                shuffled = rng.permutation(len(ids))
                for s in range(0, len(ids), BATCH):
                    part = shuffled[s : s + BATCH]
                    for w, q, g in zip(weights, squares, moved.gradients(around(padded, place[part]), ids[part]), strict=True):
                        q += g * g
                        w -= RATE * g / np.sqrt(q)
                seen += len(ids)
            if seen:
                flat = np.concatenate([w.ravel() for w in weights]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(flat * seen), pa.array(np.full(size, float(seen)))], ["i", "w", "n"])

        mine = rows.filter(F.pmod(F.xxhash64("t"), F.lit(ROUNDS)) == turn)
        if mine.rdd.getNumPartitions() > MODELS:
            mine = mine.coalesce(MODELS)
        sums = mine.mapInArrow(learn, "i long, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
        if len(sums):
            net = net.with_weights(sums.sort_values("i")["w"].to_numpy())
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every whole text.

    The sum of the log-probabilities of all tokens, each given the tokens around it: of its id by the network, of the word
    among those of its id by its share and spelling. A null or empty text has no token, the sum 0 and a null mean.
    Repeated rows are scored each. A very long text is one step of its task, with windows read in strips.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, words = shared.value, pa.array(shared.value.words, pa.large_string())
        for batch in bounded(batches, 1):
            counts, ids, inside = token_ids(batch.column(1).cast(pa.large_string()), words, n.spelling)
            padded, place = windows(counts, ids)
            for s in range(0, len(ids), STRIP):
                inside[s : s + STRIP] += n.log_probability(around(padded, place[s : s + STRIP]), ids[s : s + STRIP])
            sums = np.bincount(np.repeat(np.arange(len(counts)), counts), inside, len(counts)).astype(np.float64)
            mean = pa.array(sums / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(sums), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")
