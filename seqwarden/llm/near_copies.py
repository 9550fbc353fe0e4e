"""Near copies by SimHash and the similarity of word shingles: no pair of at least the similarity is missed.

Every whole text has a SimHash of its shingles. Fingerprints within two bits are found by the range join over segment popcounts
of ``simhash.close_pairs``, and the whole texts decide on each pair found; so groups of close copies are one component
before anything else is compared. Fingerprints cannot bound the rest: at a Jaccard similarity of 0.8 about 10 and up to 20 of 64
bits differ, and as far apart are the segment popcounts of unrelated texts. So texts that are not linked yet also meet where they share
one of their rarest shingles, which every pair of that similarity does. Where they meet only bitmaps are compared: each shingle of
a set flips one bit, so the number of differing bits is at most the number of shingles that only one of the two sets has. What passes
that bound is decided on the whole texts.

Joins of tables that grow with the texts sort both: the files of such a table may be a fraction of what it takes in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import bounded, releasing
from seqwarden.llm.components import connected_components
from seqwarden.llm.simhash import MAX_BITS, SEED, close_pairs, fingerprint_of, kept_rows
from seqwarden.session import materialize

WORDS = 5  # of a shingle
SIMILARITY = 0.8  # least Jaccard similarity
SLOTS = 1 << 20  # of the table of how common shingles are
SLOT_ROWS = 1 << 14  # of that table in one batch
COUNTED = 8  # one in so many sets is counted for it; it only orders shingles
LEAST_BITS, MOST_BITS = 64, 1 << 20  # of a bitmap; between them at least two for each shingle
BLOCK = 4096  # rows of a list that one task compares with each other or with another block
STRIP_BYTES = 4 << 20  # of bitmaps compared at once
LEAST_PARTS, PART_BYTES = 1024, 16 << 20  # of the (shingle, key) pairs, which are dealt out by shingle
PARTNERS = 256  # of a set that one task decides on
CLOSEST = 4  # of the sets that may be similar so many are looked at first, the closest ones


def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    last = min(len(words), max(1, len(words) - width + 1))
    begin, end, digest = starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist() if words else [], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begin, end, strict=True)), np.uint64, last)).view(np.int64)


def _set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _slots(found: np.ndarray) -> np.ndarray:
    return found & (SLOTS - 1)


def _sets(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, text_hash, key, fp, slot, n): the key, SimHash and size of each row's set of shingles and, in rows with a slot, how common shingles are."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, common = ["doc_id", "text_hash", "key", "fp", "slot", "n"], np.zeros(SLOTS, np.int64)
        for batch in batches:
            keys, fps, sizes = [], [], []
            for x in batch.column(1):
                found = shingles(x.as_py(), width)
                keys.append(_set_key(found))
                fps.append(fingerprint_of(found))
                sizes.append(len(found))
                if keys[-1] % COUNTED == 0:
                    np.add.at(common, _slots(found), 1)
            none = pa.nulls(len(keys), pa.int64())
            own = [pa.array(c, pa.int64()) for c in (keys, fps, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), own[0], own[1], none, own[2]], names)
        used = np.nonzero(common)[0]
        for at in range(0, len(used), SLOT_ROWS):
            some = used[at : at + SLOT_ROWS]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(some), pa.array(common[some])], names)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("h"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, key long, fp long, slot long, n long")


def bitmap(found: np.ndarray) -> bytes:
    """One bit for each hash value modulo a power of two, set if an odd number of shingles have it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(found) - 1).bit_length())) if len(found) else LEAST_BITS
    at = (found.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_different(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles that only one of two sets of n and m may have."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _prefixes(docs: DataFrame, text: str, width: int, similarity: float, levels: np.ndarray, parts: int) -> DataFrame:
    """Of each set of n shingles the rarest, so many that two sets of that similarity share one of them: (part, pairs).

    ``pairs`` are the (shingle, key) of one batch whose shingles fall to the part, two longs each. And a row without a
    part for each set, with its bitmap and the hash of its text. A worker gives each set once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["part", "pairs", "key", "n", "bits", "text_hash"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shared.value, set()
        for batch in bounded(batches, 0):
            rarest, keys, sizes, maps, hashes = [], [], [], [], []
            for x, h in zip(batch.column(0), batch.column(1).to_pylist()):
                found = shingles(x.as_py(), width)
                key = _set_key(found)
                if key not in seen and len(found):
                    seen.add(key)
                    take = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
                    # one order for all sets: by level, then by hash, in which ``found`` is sorted
                    rarest.append(found[np.argsort(level[_slots(found)], kind="stable")[:take]])
                    keys.append(key)
                    sizes.append(len(found))
                    maps.append(bitmap(found))
                    hashes.append(h)
            if keys:
                shingle, key = np.concatenate(rarest), np.repeat(np.array(keys, np.int64), [len(r) for r in rarest])
                part = ((shingle.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                dealt, cut = np.stack([shingle, key], axis=1)[order], np.nonzero(np.diff(part[order]))[0] + 1
                blobs = [x.tobytes() for x in np.split(dealt, cut)]
                some = part[order[np.concatenate(([0], cut))]]
                none = [pa.nulls(len(blobs), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(blobs, pa.binary()), *none], names)
                own = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), pa.array(hashes, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.binary()), *own], names)

    narrow = docs.select(F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("h"))
    return narrow.mapInArrow(run, "part long, pairs binary, key long, n long, bits binary, text_hash long")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.view(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_shingles(pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shingle, key, size, h, g) of the shingles that two sets or more have, each pair once; sizes and two sums of hashes tell lists apart."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))[: len(pairs)]]
    starts = np.nonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0]))[: len(pairs)])[0]
    sizes = np.diff(np.append(starts, len(pairs)))
    pairs = pairs[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    shingle, key = np.ascontiguousarray(pairs.T)
    starts = np.cumsum(sizes) - sizes
    sums = [np.add.reduceat(_mixed(key, seed), starts).view(np.int64) if len(key) else key for seed in (SEED, SEED << 20)]
    return shingle, key, *(np.repeat(x, sizes) for x in (sizes, *sums))


def _shared(found: DataFrame) -> DataFrame:
    """(list, key, size, h, g) of all shingles in the prefixes of two sets or more. Pairs are moved once, and one part at a time is held."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part = [], None

        def solve() -> pa.RecordBatch:
            pairs = np.frombuffer(b"".join(waiting), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in shared_shingles(pairs)], ["list", "key", "size", "h", "g"])

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != part and waiting:
                    yield solve()
                    waiting = []
                part = at
                waiting.append(blob)
        if waiting:
            yield solve()

    dealt = found.filter("part IS NOT NULL").select("part", "pairs").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "list long, key long, size long, h long, g long")


def closest(n: np.ndarray, bits: list[bytes], component: np.ndarray, side: np.ndarray | None, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(i, j, whether there are more): for each set the ``most`` closest ones of other components whose bitmaps allow the similarity."""
    by_size: dict[int, np.ndarray] = {}
    lengths = np.array([len(b) for b in bits])
    maps = {w: np.frombuffer(b"".join(b for b in bits if len(b) == w), np.uint64).reshape(-1, w // 8) for w in np.unique(lengths).tolist()}
    for w in maps:
        by_size[w] = np.nonzero(lengths == w)[0]
    found_i, found_j, more = [], [], False
    for w, x in maps.items():
        others = [(maps[v], by_size[v], v) for v in (w // 2, w, 2 * w) if v in maps]
        for y, at_y, v in others:
            a, b = (x, y) if v >= w else (_folded(x), y)
            b = _folded(b) if v > w else b
            step = max(1, STRIP_BYTES // max(1, b.nbytes))
            for begin in range(0, len(a), step):
                at_x = by_size[w][begin : begin + step]
                apart = np.bitwise_count(a[begin : begin + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                p, q = n[at_x][:, None], n[at_y][None, :]
                near = (apart <= most_different(p, q, similarity)) & (np.minimum(p, q) >= np.maximum(p, q) * similarity - 1e-6)
                near &= component[at_x][:, None] != component[at_y][None, :]
                if side is not None:
                    near &= side[at_x][:, None] != side[at_y][None, :]
                i, j = np.nonzero(near)
                order = np.lexsort((at_y[j], apart[i, j], i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                more = more or bool((rank >= most).any())
                i, j = i[rank < most], j[rank < most]
                found_i.append(at_x[i])
                found_j.append(at_y[j])
    return np.concatenate(found_i), np.concatenate(found_j), more


def _folded(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def _candidates(lists: DataFrame, sets: DataFrame, components: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b, list): pairs a < b that may be similar, and rows with the number of a list in which some set has more of them.

    ``lists`` (list, key). A list of more than ``BLOCK`` sets is cut into blocks, and every two blocks meet in a group of their own.
    """
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = lists.join(sizes.hint("merge"), "list").join(sets.hint("merge"), "key")
    rows = rows.join(components.hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"), "key", "n", "component", "bits")
    group = ["list", "lo", "hi"]

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        component = t["component"].to_numpy()
        if t.num_rows < 2 or (component == component[0]).all():
            return None
        key, side = t["key"].to_numpy(), t["side"].to_numpy() if t["lo"][0] != t["hi"][0] else None
        i, j, more = closest(t["n"].to_numpy(), t["bits"].to_pylist(), component, side, similarity, most)
        a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        extra = 1 if more else 0
        columns = [pa.concat_arrays([pa.array(c), pa.nulls(extra, pa.int64())]) for c in pairs.T]
        return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array([t["list"][0].as_py()] * extra, pa.int64())])], ["a", "b", "list"])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in group]
            cut = np.nonzero(np.any([g[1:] != g[:-1] for g in columns], axis=0))[0] + 1
            for a, b in zip(np.concatenate(([0], cut)).tolist(), np.append(cut, batch.num_rows).tolist(), strict=True):
                at = tuple(int(g[a]) for g in columns)
                if at != key and waiting:
                    if (out := solve(pa.Table.from_batches(waiting).combine_chunks())) is not None:
                        yield out
                    waiting = []
                key = at
                waiting.append(batch.slice(a, b - a))
        if waiting and (out := solve(pa.Table.from_batches(waiting).combine_chunks())) is not None:
            yield out

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, list long")


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of set keys whose whole sets have at least the Jaccard similarity.

    The texts of all a of one b follow the text of b into a task, which holds one set at a time besides that of b.
    Partners of a set are cut into pieces, and it is copied to each, so a set with many partners is no single task.
    """
    pieces = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("pieces"))
    dealt = pairs.join(pieces, "b").select("b", "a", F.pmod(F.xxhash64("a"), F.col("pieces")).cast("int").alias("piece"))
    asked = dealt.select(F.col("a").alias("key"), F.col("b").alias("centre"), "piece", F.lit(1).alias("role"))
    asked = asked.unionByName(dealt.select(F.col("b").alias("key"), F.col("b").alias("centre"), "piece", F.lit(0).alias("role")).distinct())
    asked = materialize(asked, "asked")
    wanted = materialize(asked.select("key").distinct().join(sets.select("key", "text_hash"), "key"), "wanted")
    own = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("t"))
    # one text for each wanted set; equal texts are combined before they are moved
    texts = own.join(wanted, "text_hash").groupBy("key").agg(F.first("t").alias("t"))
    sent = asked.join(texts, "key").repartition("centre", "piece").sortWithinPartitions("centre", "piece", "role")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in bounded(batches, 4):
            a, b = [], []
            for key, of, part, role, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(t, width)
                if role == 0:
                    centre, own = (of, part), found
                elif centre == (of, part):
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if both * (1 + similarity) >= similarity * (len(own) + len(found)) - 1e-6:
                        a.append(key)
                        b.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = sent.select("key", "centre", "piece", "role", "t")
    return materialize(sent.mapInArrow(run, "a long, b long"), "similar")


def _close_fingerprints(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of sets whose SimHashes are within two bits. Sets of one fingerprint are paired with its smallest key only."""
    sets = materialize(rows.filter("n > 0").groupBy("key").agg(F.first("fp").alias("fp")), "simhashes")
    classes = materialize(sets.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    own = sets.join(classes.hint("merge"), "fp").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    near = close_pairs(classes.select("fp"), MAX_BITS)
    x, y = (classes.select(F.col("fp").alias(p), F.col("least").alias(q)).hint("merge") for p, q in ("ax", "by"))
    near = near.join(x, "a").join(y, "b")
    return own.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def similar_components(docs: DataFrame, rows: DataFrame, levels: np.ndarray, parts: int, text: str, width: int, similarity: float) -> DataFrame:
    """(key, component) of all sets that are linked to another one; every pair of at least the similarity is linked, directly or not.

    Pairs with close fingerprints come first. Then sets meet in lists, one for each shingle; of lists with the same sets one is kept.
    Each set is compared with the closest ones of other components in its lists. Where a list holds more that may be similar, it is
    looked at again with more of them, but only across components; a group of copies is one component by then.
    """
    found = materialize(_prefixes(docs, text, width, similarity, levels, parts), "prefixes")
    sets = materialize(
        found.filter("part IS NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash")), "sets"
    )
    tried = materialize(_close_fingerprints(rows), "pairs")
    links = _similar(tried, docs, sets, text, width, similarity)
    components = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "key"), "components")
    shared = materialize(_shared(found), "shared")
    kept = materialize(shared.groupBy("size", "h", "g").agg(F.min("list").alias("list")).select("list"), "lists")
    met = materialize(shared.select("list", "key").join(kept.hint("merge"), "list"), "met")
    lists, most = met, CLOSEST
    while True:
        new = materialize(_candidates(lists, sets.drop("text_hash"), components, similarity, most), "candidates")
        pairs = new.filter("a IS NOT NULL").select("a", "b").distinct()
        pairs = materialize(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        more = materialize(new.filter("list IS NOT NULL").select("list").distinct(), "more")
        links = links.unionByName(_similar(pairs, docs, sets, text, width, similarity))
        components = materialize(connected_components(links, "a", "b").withColumnRenamed("node", "key"), "components")
        if more.isEmpty():
            return components
        tried = tried.unionByName(pairs)
        lists, most = met.join(more, "list"), most * 8


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of texts that links of at least the Jaccard similarity of shingles reach, with all columns.

    The row kept is chosen as in ``simhash.drop_near_duplicates``; texts with equal sets, or without words, are copies. Words are
    separated by ASCII white space and compared without the case of A to Z; a text of fewer words than a shingle is one shingle.
    A null text is empty, null ids and repeated rows stay apart only if their texts do, an empty table gives no rows. Very long
    texts take memory in proportion to their shingles, a few of them at once.
    """
    rows_and_slots = materialize(_sets(docs, doc_id, text, width), "found")
    rows, levels = rows_and_slots.filter("slot IS NULL").drop("slot"), np.zeros(SLOTS, np.uint8)
    counted = rows_and_slots.filter("slot IS NOT NULL").groupBy("slot").agg(F.sum("n").alias("n"))
    usual = (counted.agg(F.sum("n")).first()[0] or 0) / SLOTS
    # at most a quarter of the slots are so much more common than usual; the others keep level 0
    common = counted.filter(F.col("n") > 4 * usual + 4).toArrow()
    levels[common["slot"].to_numpy()] = np.log2(common["n"].to_numpy().astype(np.float64)).astype(np.uint8)
    all_pairs = rows.agg(F.sum(F.col("n") * (1 - similarity) + 2)).first()[0] or 0
    parts = max(LEAST_PARTS, int(all_pairs * 16 / PART_BYTES))
    components = similar_components(docs, rows, levels, parts, text, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    best_of = rows.groupBy("key").agg(first).join(components.hint("merge"), "key", "left")
    kept = best_of.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("first").alias("first"))
    return kept_rows(docs, kept, doc_id, text)
