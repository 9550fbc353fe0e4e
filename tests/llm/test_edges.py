"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator and stage."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from seqwarden.llm import catalog, html_text, language, lm_score, merkle, mixing, packing, pii, sharding, simhash, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Fingerprint string, REPLICA int, kinds string, slot string, _row string"
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog in the yard. " * 4, "en", "a"),
    (2, "The cat sat on the mat and looked at the dog in the yard. " * 4, "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "   \n\t ", "en", "b"),
    (11, "Der Hund lag im Garten und sah die Katze auf der Matte an. " * 4, "de", "b"),
    (11, "Der Hund lag im Garten und sah die Katze auf der Matte an. " * 4, "de", "b"),
    (None, "Mail anna@example.com or call +1 (555) 123-4567 now.", "en", None),
    (8, "wort " * 30_000, "de", "b"),
    (9, "12345 !!!", None, "c"),
    (12, "The mail of anna@example.com or the call to +1 (555) 123-4567 now.", "en", "c"),
    (10, "One\ttwo three\x1cfour \x01 <|endoftext|>", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, len(t or ""), "x", 7, "k", "s", "r") for i, t, la, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs)


@pytest.fixture(scope="module")
def net(docs):
    return lm_score.train(docs)


def operators(model, net):
    return {
        "pii": lambda d: pii.with_pseudonyms(d, "k"),
        "mix": lambda d: mixing.mix(d),
        "shards": lambda d: sharding.assign_shards(d, sharding.shard_names(3)),
        "score": lambda d: lm_score.score(d, net),
        "simhash": simhash.near_duplicates,
        "dedup": simhash.drop_near_duplicates,
        "language": lambda d: language.identify(d, model),
        "keep": lambda d: language.keep_identified(d, model, 0.15),
        "pack": lambda d: packing.pack_documents(d, catalog.WORD_BPE),
        "merkle": merkle.fingerprints,
    }


ONE_FOR_ONE = ("pii", "shards", "score", "simhash", "language", "merkle")


@pytest.mark.parametrize("name", ["pii", "mix", "shards", "score", "simhash", "dedup", "language", "keep", "pack", "merkle"])
def test_edges(docs, empty, model, net, name):
    f = operators(model, net)[name]
    rows = f(docs).collect()
    if name in ONE_FOR_ONE:
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in TEXTS)
    assert f(empty).collect() == []
    assert f(empty).columns == f(docs).columns
    names = [c.lower() for c in f(docs).columns]
    assert len(names) == len(set(names))


def test_simhash_groups(docs):
    got = {(r["doc_id"], r["component_id"]): r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert {c for d, c in got if d in (1, 2)} == {1}
    assert {(d, c) for d, c in got if d in (3, 4, 5)} == {(3, 3), (4, 3), (5, 3)} and got[4, 3] == "0" * 16
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted([1, 3, 11, 8, 9, 10, 12]) and kept.count(None) == 1


def test_unlinked_texts_with_one_id_all_stay(spark):
    words = [f"{a} {a}ing the {b} of {a}s and {b}s near a {b} house" for a, b in (("walk", "dog"), ("paint", "wall"), ("count", "star"), ("sing", "bird"))]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (5, words[2]), (5, words[3]), (6, words[3]), (5, words[2]), (None, words[2])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(None, words[0]), (None, words[1]), (5, words[2]), (5, words[3])])


def test_close_pairs_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 2, 3)]
    fps = sorted(set(flips) | {0, -1, 1, 3, 7})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (np.uint64(a & (2**64 - 1)) ^ np.uint64(b & (2**64 - 1))).item().bit_count() <= 2}
    got = [(r["a"], r["b"]) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert Counter(got) == Counter(want)


def test_packing_is_exact(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.WORD_BPE)
    rows = packing.pack_documents(docs, catalog.WORD_BPE).collect()
    want = Counter()
    for i, t, *_ in TEXTS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_open_bins_are_best_fit_and_bounded():
    rng = np.random.default_rng(3)
    bins, free = packing.OpenBins(100, 4), {}
    for size in rng.integers(1, 101, 3000).tolist():
        fits = {b: f for b, f in free.items() if f >= size}
        number, offset = bins.place(size)
        if fits:
            assert free[number] == min(fits.values()) and offset == 100 - free[number]
        else:
            assert offset == 0 and number not in free
            if len(free) == 4:
                least = min(free.values())
                closed = next(b for b, f in free.items() if f == least)
                gone = [b for b, f in free.items() if f == least]
                assert closed in gone
                for b in gone:
                    if b not in [x for of in bins.by_free for x in of]:
                        free.pop(b)
                        break
            free[number] = 100
        free[number] -= size
        if not free[number]:
            free.pop(number)
        assert bins.n_open == len(free) <= 4


def test_merkle_next_and_edits(docs):
    got = merkle.with_next(docs, per_block=2).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t, *_ in TEXTS), reverse=True)
    want = Counter((a, b) for a, b in zip(order, [t for _, t in order[1:]] + [order[0][1]], strict=True))
    assert Counter(((-1 if r["doc_id"] is None else r["doc_id"], r["text"]), r["next_text"]) for r in got) == want
    for r in merkle.fingerprints(docs).collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["n_chars"] == 0:
            assert r["edited_sha256"] == hashlib.sha256(b"").hexdigest() and r["near_edited"] == 1


def test_likeness_comes_from_the_tree(spark):
    a, b, c = "one two three four five six", "seven eight nine ten", "eleven twelve"
    texts = {"same": (f"{a}\n{b}", f"{a}\n{b}"), "order": (f"{a}\n{b}", f"{b}\n{a}"), "doubled": (f"{a}\n{b}", f"{a}\n{b}\n{b}"), "space": (f"{a}\n{b}", f"{a}\n {b}"),
             "blank": (f"{a}\n \n{b}", f"{a}\n\n{b}"), "part": (f"{a}\n\n{b}\n\n{c}", f"{a}\n\nx\n\n{c}"), "other": (a, b), "empty": ("", "")}
    rows = spark.createDataFrame([(k, *v) for k, v in texts.items()], "k string, x string, y string")
    rows = merkle.with_tree(merkle.with_tree(rows, "x"), "y").select("*", merkle.nodes("x").alias("m"), merkle.nodes("y").alias("n"))
    like, parts = merkle.likeness(rows["m"], rows["n"]), merkle.differing(rows["x_sections"], rows["y_sections"])
    got = {r.k: r for r in rows.select("k", like.alias("like"), parts.alias("parts"), (rows["x_root"] == rows["y_root"]).alias("equal")).collect()}
    assert {k for k, r in got.items() if r.equal} == {k for k, r in got.items() if r.like == 1} == {"same", "empty"}
    # of the nodes of each side: four runs and two paragraphs are common, section and root are not
    assert got["order"].like == 6 / 8 and got["doubled"].like == 6 / 8 and got["part"].parts == [2] and got["other"].like == 0
    assert 0 < got["blank"].like < 1 and 0 < got["space"].like < 1


def test_mixing_rates_and_weights(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 10 < 8, 'big', if(id % 10 = 8, 'small', null)) AS source")
    out = mixing.mix(df, weights={"big": 1.0, "small": 2.0, None: 1.0}, total=40_000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 20_000) < 700 and abs(n[None] - 10_000) < 500
    huge = mixing.mix(spark.range(20).selectExpr("id AS doc_id", "'s' AS source"), total=20 * 200.0)
    assert abs(huge.count() - 4000) < 400


def test_lookup_table_is_even_and_stable():
    a, b = (sharding.lookup_table(sharding.shard_names(n), 1009) for n in (10, 11))
    assert max(Counter(a).values()) - min(Counter(a).values()) <= 1
    assert sum(x == y for x, y in zip(a, b, strict=True)) > 0.6 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(("a",), 1000)


def test_language_model(model):
    assert model.languages == ("de", "en")
    assert model.scores("the dog sat").argmax() == 1 and model.scores("der Hund und die Katze").argmax() == 0
    assert model.scores("123 !") is None and model.scores(None) is None


def test_held_out_accuracy(spark):
    rows = catalog.op8(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.99


def test_pseudonyms():
    key = b"k"
    text = "card 4111 1111 1111 1111, bad 4111111111111112, ip 10.0.0.7, born 1999-12-31, not 2023-02-30, ssn 123-45-6789, DE89370400440532013000"
    new, kinds = pii.pseudonymise(text, key)
    assert sorted(kinds) == ["card", "date", "iban", "ipv4", "ssn"] and len(new.split()) == len(text.split())
    assert "4111111111111112" in new and "2023-02-30" in new and "10.0.0.7" not in new
    card = "".join(c for c in new[5:24] if c.isdigit())
    assert pii.luhn(card) % 10 == 0 and card != "4111111111111111"
    assert pii._mod97(new.split()[-1]) == 1
    assert pii.pseudonymise(text, key)[0] == new != pii.pseudonymise(text, b"other")[0]
    assert pii.pseudonymise("no values here, version 1.2.3 of 2010", key) == ("no values here, version 1.2.3 of 2010", [])
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(i, size, key, "t") for i in range(size)) == list(range(size))


def test_network_gradients_and_brute_force_score(spark, net):
    rng = np.random.default_rng(1)
    small = net.with_weights(np.concatenate([w.ravel() for w in net.weights()]))
    context, target = rng.integers(0, lm_score.VOCABULARY, (50, 4)), rng.integers(0, lm_score.VOCABULARY, 50)
    grads = small.gradients(context, target)
    flat = np.concatenate([w.ravel() for w in small.weights()]).astype(np.float64)
    at = int(np.abs(np.concatenate([g.ravel() for g in grads])).argmax())
    loss = lambda f: -net.with_weights(f).log_probability(context, target).mean()
    step = np.zeros_like(flat)
    step[at] = 1e-2
    assert abs((loss(flat + step) - loss(flat - step)) / 2e-2 - np.concatenate([g.ravel() for g in grads])[at]) < 1e-3
    # the distribution sums to one
    one = np.repeat(context[:1], lm_score.VOCABULARY, axis=0)
    assert abs(np.exp(net.log_probability(one, np.arange(lm_score.VOCABULARY))).sum() - 1) < 1e-4
    rank = {w: i for i, w in enumerate(net.words)}
    text = "The cat sat on the zebra"
    bucket = lambda w: lm_score.KNOWN + min(len(w.encode()), lm_score.BUCKETS - 1)
    ids = [rank[w] if rank.get(w, lm_score.KNOWN) < lm_score.KNOWN else bucket(w) for w in text.lower().split()]
    pad = [lm_score.VOCABULARY] * 2
    padded = pad + ids + pad
    want = sum(net.log_probability(np.array([[padded[i], padded[i + 1], padded[i + 3], padded[i + 4]]]), np.array([ids[i]]))[0] for i in range(len(ids)))
    want += sum(_inside(net, w) for w in text.lower().split())
    got = lm_score.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).first()
    assert got["n_tokens"] == 6 and abs(got["log_likelihood"] - want) < 1e-3


def _spelled(net, word):
    """log P(spelling), byte by byte."""
    table, total = net.spelling.table, 0.0
    data = [0, 0, 0, *word.encode()]
    for i in range(3, len(data)):
        before = data[i - 1] | data[i - 2] << 8 | data[i - 3] << 16
        total += float(table[(before * 0x9E3779B1 % 2**32) >> (32 - (len(table).bit_length() - 1)), data[i]])
    more = len(data) - 3 - (lm_score.BUCKETS - 1)
    return total if more < 0 else total + more * np.log(net.spelling.longer) + np.log(1 - net.spelling.longer)


def _inside(net, word):
    """log P(word | its id)."""
    if word in net.words[: lm_score.KNOWN]:
        return 0.0
    if word in net.words:
        return net.spelling.listed[net.words.index(word)]
    return net.spelling.unlisted[min(len(word.encode()), lm_score.BUCKETS - 1)] + _spelled(net, word)


def many_words(n=1_500):
    """Texts in which word i occurs n // (i + 1) + 1 times; the last ones are in all lengths up to 150 bytes."""
    word = lambda i: "".join(chr(97 + (i * 7 + k * i + k) % 26) for k in range(1 + i % 9)) + str(i)
    words = [word(i) for i in range(n)] + ["é" * k for k in range(1, 75)] + list("bcdfgh+-=§") + ["ab", "q1"]
    flat = [w for i, w in enumerate(words) for _ in range(n // (i + 1) + 1)]
    return words, [" ".join(flat[i::40]) for i in range(40)]


def test_words_beyond_the_networks_have_exact_probabilities(spark, monkeypatch):
    words, texts = many_words()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm_score, "LISTED_PER_ROOT", 2)
    listed, spelling = lm_score.learn_words(docs)
    counts = {}
    for w in " ".join(texts).lower().split():
        counts[w] = counts.get(w, 0) + 1
    by_count = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    last = min(counts[w] for w in listed)
    limit = lm_score.KNOWN + 2 * int(sum(counts.values()) ** 0.5)
    assert list(listed) == [w for w in by_count if w in set(listed)] and {w for w in counts if counts[w] > last} <= set(listed)
    assert abs(len(listed) - limit) < 0.1 * limit and lm_score.KNOWN < len(listed) < len(counts)
    net = lm_score.Network.start(listed, spelling, 1)
    # the spelling is a distribution over bytes after every context, and follows the counts of words
    assert np.allclose(np.exp(spelling.table.astype(float)).sum(axis=1), 1, atol=1e-4)
    seen = np.zeros(spelling.table.shape)
    for w in by_count:
        data = [0, 0, 0, *w.encode()]
        for i in range(3, len(data)):
            before = data[i - 1] | data[i - 2] << 8 | data[i - 3] << 16
            seen[(before * 0x9E3779B1 % 2**32) >> (32 - (len(seen).bit_length() - 1)), data[i]] += 1 if w in listed[: lm_score.KNOWN] else counts[w]
    alike = (seen.sum(axis=0) + 1) / (seen.sum() + 256)
    assert np.allclose(spelling.table, np.log((seen + alike) / (seen.sum(axis=1, keepdims=True) + 1)), atol=1e-4)
    # all words of one byte: what is listed, what is spelled, and the spelling of known words, which is never used
    unlisted = np.exp(spelling.unlisted[1])
    shares = sum(np.exp(spelling.listed[i]) - unlisted * np.exp(_spelled(net, w)) for i, w in enumerate(listed) if i >= lm_score.KNOWN and len(w.encode()) == 1)
    assert abs(shares + unlisted - 1) < 1e-6
    # whole texts by hand, in both strips and whole
    for strip in (7, 1 << 16):
        monkeypatch.setattr(lm_score, "STRIP", strip)
        text = pa.array([" ".join(words[::7]), None, "", "é" * 5_000 + " unseen \u4e2d\u6587 zzzzq"], pa.large_string())
        n, ids, inside = lm_score.token_ids(text, pa.array(listed, pa.large_string()), spelling)
        flat = [w for t in text.to_pylist() for w in (t or "").lower().split()]
        assert n.tolist() == [len((t or "").split()) for t in text.to_pylist()] and len(ids) == len(flat)
        assert np.allclose(inside, [_inside(net, w) for w in flat], atol=1e-3)


def test_rare_words_of_one_length_score_apart(spark, net):
    pair = spark.createDataFrame([(1, "the cat xqzkv"), (2, "the cat zvqkj"), (3, "the cat eaten")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(pair, net).collect()}
    assert len({round(v, 6) for v in got.values()}) == 3 and got[3] > max(got[1], got[2])


def test_training_without_a_word(spark, empty):
    for docs in (empty, spark.createDataFrame([(1, None), (2, ""), (3, " \t\n")], "doc_id long, text string")):
        net = lm_score.train(docs)
        assert net.words == ()
        got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame([(1, "unseen words"), (2, None)], "doc_id long, text string"), net).collect()}
        assert np.isfinite(got[1]["log_likelihood"]) and got[1]["n_tokens"] == 2 and got[2]["mean_log_likelihood"] is None


def test_training_lowers_the_loss_of_all_windows(spark):
    _, texts = many_words()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    fitted = lm_score.train(docs)
    first = lm_score.Network.start(fitted.words, fitted.spelling, 11)
    total = lambda n: sum(r["log_likelihood"] for r in lm_score.score(docs, n).collect())
    assert total(fitted) > total(first)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 32))
    near = base[:60] + rng.normal(size=(60, 32)) * 0.2
    all_rows = [*base, *near, *(base[0] + rng.normal(size=(40, 32)) * 0.1), *base[:5], base[7] * 3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(all_rows)]
    bad = [(900, None), (901, [0.0] * 32), (902, [None] + [1.0] * 31), (903, [float("nan")] * 32), (904, []), (None, [float(x) for x in base[9]])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.linked_vectors(df).collect()}
    e = np.array([v for _, v in rows] + [bad[-1][1]])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    ids = [i for i, _ in rows] + [None]
    link = e @ e.T >= 0.9
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.97 * (link.sum() - len(ids))
    assert all(got[i]["n_links"] <= link[k].sum() - 1 for k, i in enumerate(ids))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert got[None]["component_id"] == 9 and not got[None]["kept"] and got[7]["n_links"] >= 1
    assert vectors.linked_vectors(df.filter("vec_id < 0")).collect() == []


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(60)]
    pair = [float(x) for x in rng.normal(size=7)]
    rows += [(100, pair), (101, [x * 1.01 + 1e-6 for x in pair]), (102, pair + [0.0]), (103, [2.0]), (104, [5.0]), (105, [-1.0]), (106, rows[0][1]), (107, rows[0][1][:7])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, bucket string, N_LINKS int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.linked_vectors(df).collect()}
    assert got[100] == (1, 100, True) and got[101] == (1, 100, False) and got[102] == (0, 102, True)
    assert got[103] == (1, 103, True) and got[104] == (1, 103, False) and got[105] == (0, 105, True)
    assert got[0] == (1, 0, True) and got[106] == (1, 0, False) and got[107] == (0, 107, True) and len(got) == len(rows)


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.02]) for i in range(300)]
    monkeypatch.setattr(vectors, "BLOCK", 32)
    got = vectors.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r["n_links"] == 299 and r["component_id"] == 0 for r in got)


A = "The quick brown fox jumps over the lazy dog, and then it rests. " * 3
PAGES = {
    f"<body><header><h1>Site</h1></header><nav><a>x</a></nav><article><header><h1>Title &eacute;</h1></header><p>{A}</p><aside>{A}</aside><p>short"
    f"<div class='ad'>Buy!</div><section class='comments'><p>{A}</p></section></article><div class='sidebar'>{A}</div></body>": f"Title é\n{A.strip()}\nshort",
    f"<body class='has-sidebar'><div id='page'><div class='menu'><ul><li>a<li>b</ul></div><div id='content'><h2>H</h2><p>{A}<p>Tiny.</div></div>": f"H\n{A.strip()}\nTiny.",
    f"<body><script>var s='<article><p>no</p>';</script><article><p>{A}</p><!-- <p>no</p> --><p>a&nbsp;b&lt;c  d</article>": f"{A.strip()}\na b<c d",
    f"<div class='notice'>{A}</div><main><p>{A}</p><form><p>{A}</p></form><p>x<br>y</p></main>": f"{A.strip()}\nx y",
    "": "",
    "<html><body><nav>only</nav></body></html>": "",
    "plain   words &amp; more": "plain words & more",
}


B = "Another text, which has nothing to do with it; it tells of shops, hotels and cars. " * 3
LINKS = "".join(f"<li><a href='/{i}'>Another page {i}</a></li>" for i in range(8))
PROBES = {
    "two articles": (f"<body><article>{f'<p>{A}</p>' * 6}</article><article><p>{A}</p></article></body>", 7 * [A.strip()]),
    "weak word on a paragraph": (f"<article><p>{A}</p><p class='social'>{A}</p><p>{A}</p></article>", 3 * [A.strip()]),
    "weak word on a part": (f"<article><p>{A}</p><div id='promotion'><p>{A}</p></div><p>{A}</p></article>", 3 * [A.strip()]),
    "menu in a wrapper": (f"<body><div class='menu-wrapper'><p>{B}</p></div><article><p>{A}</p></article></body>", [A.strip()]),
    "sidebar with content": (f"<body><div class='content'><p>{A}</p></div><div class='sidebar-content'><p>{B}</p></div></body>", [A.strip()]),
    "advert without a known word": (f"<article><p>{A}</p><div class='xk7'>Buy two, pay one!</div><p>{A}</p></article>", 2 * [A.strip()]),
    "list of links": (f"<article><p>{A}</p><ul>{LINKS}</ul><p>{A}</p></article>", 2 * [A.strip()]),
    "list of the article": (f"<article><p>{A}</p><ul><li>first</li><li>the <a>second</a> one</li></ul><p>{A}</p></article>", [A.strip(), "first", "the second one", A.strip()]),
    "heading and quote": (f"<main><div class='top'><h1>Title</h1></div><div><p>{A}</p><blockquote><p>Short.</p></blockquote></div></main>", ["Title", A.strip(), "Short."]),
    "class around everything": (f"<body><div class='no-sidebar ads'><p>{A}</p><p>x</p></div><footer>{B}</footer></body>", [A.strip(), "x"]),
    "reader comments": (f"<article><p>{A}</p></article><ol class='comment-list'>{f'<li><p>{B}</p></li>' * 5}</ol>", [A.strip()]),
    "short article": ("<nav><a>Home</a></nav><article><h1>Title.</h1><p>A word.</p></article><footer>&copy; Some house, some street, some town.</footer>", ["Title.", "A word."]),
    "inline end tags": (f"<body><b><article><p>{A}</b></p><p>x <i>y</i>z</p></article>", [A.strip(), "x yz"]),
    "quotes": (f"<article title='a > b'><p data-x=\"<p>no</p>\" class=it's>{A}</p></article>", [A.strip()]),
}


@pytest.mark.parametrize("name", PROBES)
def test_paths_decide(name):
    source, lines = PROBES[name]
    assert html_text.main_text(source).split("\n") == lines


BROKEN = ["<a x ", '<a x="', "<", "</", "<!--", "<script>", "<p a='>", "<p class =", "<a b='\">", "<li><b>", "<td><p>", "<b></p>", "&amp", "<p><b></b>"]


@pytest.mark.parametrize("piece", BROKEN)
def test_long_broken_pages(piece):
    start = time.time()
    html_text.main_text(f"<p>start</p>{piece * (1_000_000 // len(piece))}")
    assert time.time() - start < 8


@pytest.mark.parametrize("source", PAGES)
def test_main_text(source):
    assert html_text.main_text(source) == PAGES[source]


@pytest.mark.parametrize("tag", ["div", "span", "b", "li", "td", "article"])
def test_deep_pages_take_linear_time(tag):
    deep = html_text.main_text(f"<body>{f'<{tag}>a' * 40_000}<p>end</p></p><i>{'</x>' * 1000}")
    assert deep.split()[-1].endswith("end") and deep.count("a") >= 0.8 * 40_000


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", "<p>" * 5000 + "deep", "z")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("1", "", 0), ("1", "deep", 4), ("None", "a", 1)]
    assert html_text.extract(df.filter("page_id = 5")).collect() == []


def test_pipeline_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    at, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, str(tmp_path))
        if name != "best-fit packing":
            assert at.columns == before.columns and [f.dataType for f in at.schema] == [f.dataType for f in before.schema]
        rows[name] = at.collect()
        assert stage(spark, before.limit(0), str(tmp_path)).collect() == []
    kept = {r["doc_id"] for r in rows["language ID"]}
    assert {3, 4, 5, 9} & kept == set() and {1, 2, 11, 12} <= kept
    ids = [r["doc_id"] for r in rows["SimHash near-dedup"]]
    assert 2 not in ids and ids.count(11) == 1 and ids.count(1) == 1
    assert not any("anna@example" in r["text"] or "123-4567" in r["text"] for r in rows["PII"])
    assert {r["doc_id"] for r in rows["best-fit packing"]} == {r["doc_id"] for r in rows["mixing sources"]}
