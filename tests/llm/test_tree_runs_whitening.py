"""Byte BPE by halves, periodic runs and whitening, each against a plain version of its own."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seqwarden.llm import byte_bpe, catalog, periodic_runs, whitening

SMALL = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, ids string, runs string, h long, n long, best string"
TEXTS = [None, "", "  \n\t ", "a", "the cat's 12 mats x\x1cy", "İ漢字 \U0001f600\r\n", "wort " * 3000, "a" * 30_000, "the cat's 12 mats x\x1cy"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i % 8, t, "x", "y", 1, 2, "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, EXTRA).repartition(2)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe.read(catalog.BYTE_BPE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


@pytest.mark.parametrize(("leaf", "window"), [(1, 1), (2, 1), (8, 2), (5, 3)])
def test_bpe_tree_equals_the_library(coder, library, leaf, window):
    rng = random.Random(leaf)
    tree = byte_bpe.ByteBpe(coder.ranks, public_tokenizers.PATTERN, leaf_bytes=leaf, leaf_chars=20, window=window)
    for _ in range(400):
        letters = rng.choice(["ab", "aé漢", "a b\n'sd1", "the quick  12 '", "你好世ab", "  \t\nx", "aaaaaaab", "\x1c\x85  a1"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 60, 300])))
        ids = tree.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_bpe_of_every_character(coder, library):
    for at in range(0, 0x110000, 64):
        text = "".join(f"a{c}b1{c}2! {c} " for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000)
        if at < 0x3400 or at % 4096 == 0:
            assert coder.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("piece", ["a" * 100_000, "=" * 50_001, "漢字" * 30_000, " " * 40_000, "abcab" * 20_000])
def test_bpe_of_long_pieces(coder, library, piece):
    ids = coder.encode(piece).tolist()
    assert ids == library.encode_ordinary(piece) and coder.decode(ids) == piece.encode()


def test_bpe_rows(spark, docs, library):
    rows = byte_bpe.round_trip(docs, catalog.BYTE_BPE, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want.append((str(None if i == 3 else i % 8), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in rows) == sorted(want)
    assert byte_bpe.round_trip(docs.filter("doc_id = 99"), catalog.BYTE_BPE, public_tokenizers.PATTERN).collect() == []


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = catalog.op11(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_reads_rank_files():
    with open(catalog.BYTE_BPE, "rb") as lines:
        first = next(lines).split()
    assert byte_bpe.ByteBpe.read(catalog.BYTE_BPE, public_tokenizers.PATTERN).ranks[base64.b64decode(first[0])] == int(first[1])


def plain_runs(words, least, exponent):
    """All maximal runs by their definition: for each period every stretch that repeats at that distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            own = words[start : i + q]
            smaller = any(own[r:] == own[:-r] for r in range(1, q))
            if not smaller and len(own) >= max(least, exponent * q):
                out.append((start, len(own), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_the_definition():
    rng = random.Random(3)
    for _ in range(1500):
        n, letters = rng.choice([0, 1, 2, 5, 10, 30, 60]), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randrange(1, n - a + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least, exponent in ((2, 2), (6, 4), (1, 3)):
            assert periodic_runs.find_runs(words, least, exponent) == plain_runs(words, least, exponent)
        assert sorted(periodic_runs.squares_to_runs(words), key=lambda r: (r[0], r[2])) == plain_runs(words, 2, 2)
    with pytest.raises(ValueError):
        periodic_runs.find_runs([1, 1], exponent=1)


def test_access_gives_last_occurrences():
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.choice([1, 7, 25]))]
        link, length, prefix = periodic_runs.automaton(words)
        paths = periodic_runs.LinkPaths(link, length)
        for i, state in enumerate(prefix, 1):
            common = {j: next((k for k in range(j) if words[i - 1 - k] != words[j - 1 - k]), j) for j in range(1, i)}
            want, best = [], 0
            for j in range(i - 1, 0, -1):  # later ends first: a new last occurrence only where more is in common
                if common[j] > best:
                    want.append((common[j], j))
                    best = common[j]
            assert [t for t in reversed(paths.access(state, i)) if t[0] and t[1]] == want


def digest_row(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 6, 4) if n < 3000 else periodic_runs.find_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (str(doc_id), len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_rows(spark, docs):
    def query(d):
        return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_periods(d)))

    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in query(docs).collect())
    assert [g[0] for g in got] == sorted(str(None if i == 3 else i % 8) for i in range(len(TEXTS)))
    assert sorted(map(str, got)) == sorted(str(digest_row(None if i == 3 else i % 8, t)) for i, t in enumerate(TEXTS))
    assert query(docs.filter("doc_id = 99")).collect() == []
    chosen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=i % 70))) for i in chosen]
    got = {str(r["doc_id"]): tuple(r)[1:] for r in query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {str(i): digest_row(i, t)[1:] for i, t in rows} and any(r[0] for r in got.values())


def test_run_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {str(r["doc_id"]): tuple(r)[1:] for r in catalog.op12(spark, SMALL).collect()}
    short = [r for r in rows if len(r["text"] or "") < 4000]
    assert len(got) == len(rows) and len(short) > 100
    assert all(got[str(r["doc_id"])] == digest_row(r["doc_id"], r["text"])[1:] for r in short)


@pytest.mark.parametrize(("n", "d"), [(1, 3), (2, 3), (5, 4), (60, 8), (400, 16)])
def test_spectrum_follows_the_scatter(n, d):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=(n, d)) + 100_000, rng.integers(0, 3, (n, d)).astype(float), rng.normal(size=(n, d)) * np.logspace(0, -9, d), np.outer(np.arange(n), np.ones(d))):
        parts = [whitening.Spectrum.empty(d) for _ in range(2)]
        for i, row in enumerate(x):
            parts[i % 2].add(row)
        s = parts[0].merge(parts[1])
        scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
        scale = max(float(np.abs(scatter).max()), 1e-12)
        assert s.n == n and np.abs(s.basis @ np.diag(s.values) @ s.basis.T - scatter).max() < 1e-9 * scale
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-12


def plain_whitening(x, most=8):
    n, sums = len(x), [sum(int(c) for c in column) for column in x.T]
    centred = np.array([[n * int(c) - s for c, s in zip(row, sums, strict=True)] for row in x], np.float64) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return deviation, values[::-1][:most], basis[:, ::-1][:, :most], centred, values.sum()


def test_whitening_query_against_numpy(spark):
    rows = [r for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if r["embedding"]]
    x = np.floor(1024 * np.array([r["embedding"] for r in rows], np.float64)) + 100_000
    deviation, values, basis, centred, trace = plain_whitening(x)
    got = catalog.op13(spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([r["vec_id"] for r in rows], kind="stable")
    assert len(got) == 8 * len(rows) and (got["n"] == len(rows)).all() and got["identity_error"].max() < 1e-9
    assert got["deviation"].tolist() == [deviation[i] for i in order for _ in range(8)]
    want = (centred @ basis / np.sqrt(values))[order]
    white = got["whitened"].to_numpy().reshape(-1, 8)
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 8), values / trace, rtol=1e-10)


def test_whitening_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=3)], 1, 2.0) for i in range(30)] + [(i, [1.5, 2.5], 1, 2.0) for i in (5, 5, None)]
    bad = [(90, None, 1, 2.0), (91, [], 1, 2.0), (92, [1.0, None, 2.0], 1, 2.0), (93, [float("nan"), 1.0, 1.0], 1, 2.0), (94, [float("inf"), 1.0, 1.0], 1, 2.0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component int, whitened double").repartition(5)
    got = whitening.whiten(df).collect()
    three, two = [r for r in got if r["n"] == 30], [r for r in got if r["n"] == 3]
    assert len(three) == 90 and len(two) == 6 and len(got) == 96
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in two)
    assert max(r["identity_error"] for r in three) < 1e-9 and {str(r["vec_id"]) for r in two} == {"5", "None"}
    assert whitening.whiten(df.filter("vec_id > 80")).collect() == []
    far = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(far) == 4 and all(r["deviation"] is None for r in far)
    flat = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and max(r["identity_error"] for r in flat) < 1e-9
