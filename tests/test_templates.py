import random
import time
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sequential_mining import mine

from seqwarden.operators import leaves
from seqwarden.operators.leaves import Matches, changing_rows
from seqwarden.operators import templates as tm
from seqwarden.operators.templates import MiningSpec, _applied_by_row, apply_templates, catalogue, mine_templates, with_message

MESSAGES = [
    "ListBuckets from 10.0.0.1 by root",
    "ListBuckets from 192.168.1.100 by root",
    "ListBuckets from 172.16.0.50 by root",
    "DescribeInstances in us-east-1 by admin",
    "CreateUser backup for account 999888777666",
]


def frame(spark, messages):
    return spark.createDataFrame(list(enumerate(messages)), "pos long, text string").repartition(3)


def mined(spark, messages, **kw):
    out = mine_templates(frame(spark, messages), "text", ["pos"], **kw)
    keys = [r.key for r in out.keys.orderBy("pos").collect()]
    rows = out.templates.orderBy("key").collect()
    assert [r.key for r in rows] == list(range(len(rows)))
    return keys, [r.template for r in rows], [r["size"] for r in rows]


def test_three_templates(spark):
    keys, templates, sizes = mined(spark, MESSAGES)
    assert keys == [0, 0, 0, 1, 2]
    assert sizes == [3, 1, 1]
    assert templates[0] == "ListBuckets from <*> by root"


def test_edges(spark):
    assert mined(spark, []) == ([], [], [])
    assert mined(spark, ["only one left"] + ["same text"] * 10) == ([0] + [1] * 10, ["only one left", "same text"], [1, 10])
    # an empty message matches nothing, not even another one
    assert mined(spark, ["", "a b", " ", ""]) == ([0, 1, 2, 3], ["", "a b", "", ""], [1, 1, 1, 1])
    assert mined(spark, ["", "a b", ""], spec=MiningSpec(threshold=0.0)) == ([0, 1, 0], ["", "a b"], [2, 1])
    assert mined(spark, ["", "a b", ""], mint_empty=False) == ([-1, 0, -1], ["a b"], [1])
    with pytest.raises(ValueError):
        MiningSpec(threshold=1.5)
    with pytest.raises(ValueError):
        MiningSpec(depth=0)


def random_case(rng):
    words = ["a", "b", "c", "d", "<*>"][: rng.randint(2, 5)]
    length = rng.randint(1, 5)
    lengths = [length] if rng.random() < 0.6 else [0, 1, 2, length]
    return [" ".join(rng.choice(words) for _ in range(rng.choice(lengths))) for _ in range(rng.randint(5, 60))]


@pytest.mark.parametrize("seed,rows_per_task,slice_size", [(0, 10**6, 9), (1, 10**6, 9), (2, 1, 50_000), (3, 1, 7), (4, 1, 3)])
def test_equals_the_sequential_pass(spark, monkeypatch, seed, rows_per_task, slice_size):
    """Folding whole routes, and solving every shared route by windows, both give the sequential result."""
    monkeypatch.setattr(tm, "MESSAGES_PER_SLICE", slice_size)
    rng = random.Random(seed)
    messages = random_case(rng) + random_case(rng)
    spec = MiningSpec(rng.randint(2, 4), rng.choice([0.2, 0.4, 0.6]), rng.choice([1, 2, 3]))
    want = mine([m.split() for m in messages], spec.depth, spec.threshold, spec.max_children)
    got = mined(spark, messages, spec=spec, masked=False, rows_per_task=rows_per_task, candidates_per_round=20)
    assert got == want


def solve_by_windows(messages, threshold, batch):
    """The windows of a large route on one machine, with the functions that Spark runs."""
    first = {}
    for i, m in enumerate(messages):
        first.setdefault(m, i)
    distinct, begin, closed = sorted(first), -1, []
    state = Matches(threshold, distinct)
    while True:
        unmet = sorted(first[m] for m, o in zip(distinct, state.outcome) if o < 0 and first[m] > begin)
        end = unmet[batch - 1] if len(unmet) >= batch else len(messages)
        window = [(m, i) for i, m in enumerate(messages) if begin < i <= end]
        moving = {m for m, o in zip(distinct, state.outcome) if o < 0}
        found = {}
        for m, i in window:
            if m in moving:
                found.setdefault(m, i)
        rows = sorted((i, m) for m, i in found.items())
        while True:
            log = changing_rows(threshold, [(m, i) for i, m in rows], state.templates())
            trial = Matches(threshold, distinct, state.best, state.equal, state.outcome, state.since, state.templates(), state.opened)
            for m, i in log:
                trial.step(m, i)
            missed = [
                (i, m)
                for m, a, b, c in trial.closed + trial.still_open()
                for t, i in window
                if c is None and t == m and (a is None or i >= a) and (b is None or i < b)
            ]
            if not missed:
                break
            rows = sorted({*((i, m) for m, i in log), *sorted(missed)[:batch]})
        closed += trial.closed
        state, begin = Matches(threshold, distinct, trial.best, trial.equal, trial.outcome, trial.since, trial.templates(), trial.opened), end
        if end == len(messages):
            break
    joined = {i: c for m, a, b, c in closed + state.still_open() if c is not None for i, t in enumerate(messages) if t == m and i >= a and (b is None or i < b)}
    rank = {c: k for k, c in enumerate(sorted(set(joined.values())))}
    return [rank[joined[i]] for i in range(len(messages))]


@pytest.mark.parametrize("dense", [0, 3, 48])
def test_indexed_clusters_equal_the_sequential_pass(monkeypatch, dense):
    monkeypatch.setattr(leaves, "DENSE", dense)
    monkeypatch.setattr(leaves, "PAIRED", dense)
    rng = random.Random(dense)
    for _ in range(400):
        words = ["a", "b", "c", "d", "e", "<*>"][: rng.randint(2, 6)]
        length = rng.randint(1, 8)
        messages = [" ".join(rng.choice(words) for _ in range(length)) for _ in range(rng.randint(1, 80))]
        threshold = rng.choice([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
        coder, clusters = leaves.Coder(), leaves.Clusters(threshold)
        assert [clusters.add(coder.encode(m))[0] for m in messages] == mine([m.split() for m in messages], depth=1, threshold=threshold)[0]


def test_many_clusters_are_met_through_the_index():
    """20,000 diverse messages of one route, each compared with few of the clusters before it."""
    rng = random.Random(1)
    messages = [" ".join(f"w{rng.randrange(1000)}" for _ in range(10)) for _ in range(20_000)]
    coder, clusters = leaves.Coder(), leaves.Clusters(0.4)
    start = time.perf_counter()
    for m in messages:
        clusters.add(coder.encode(m))
    assert clusters.n > 19_000 and time.perf_counter() - start < 6  # about 1 s alone; every cluster compared would take 8 s and four times that for each doubling


@pytest.mark.parametrize("seed", range(40))
def test_windows_reach_the_sequential_result(seed):
    rng = random.Random(seed)
    length, words = rng.randint(1, 5), ["a", "b", "c", "d", "<*>"]
    messages = [" ".join(rng.choice(words) for _ in range(length)) for _ in range(rng.randint(2, 50))]
    threshold = rng.choice([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    want, _, _ = mine([m.split() for m in messages], depth=1, threshold=threshold)
    for batch in (1, 3, 1000):
        assert solve_by_windows(messages, threshold, batch) == want


def test_order_columns(spark):
    """Two integer columns and a time order by their values, whatever the partitioning."""
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["x 1a", "x 2b", "y 1a", "x 1b"])) for s in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "session long, seq long, text string").repartition(5)
    want, _, _ = mine([t.split() for _, _, t in rows], threshold=0.6, depth=2)
    spec = MiningSpec(depth=2, threshold=0.6)
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("session") * 100 + F.col("seq")))
    for order, limit in ((["session", "seq"], 10**6), (["session", "seq"], 1), (["ts", "seq"], 10**6)):
        out = mine_templates(timed, "text", order, spec, rows_per_task=limit)
        assert [r.key for r in out.keys.orderBy("session", "seq").collect()] == want


def test_frozen_vocabulary(spark):
    out = mine_templates(frame(spark, MESSAGES), "text", ["pos"])
    again = apply_templates(frame(spark, MESSAGES), "text", out.templates)
    assert [r.key for r in again.orderBy("pos").collect()] == [0, 0, 0, 1, 2]
    new = ["ListBuckets from 8.8.8.8 by root", "DeleteTrail now", "ListBuckets from 8.8.8.8 via x", ""]
    keys = [r.key for r in apply_templates(frame(spark, new), "text", out.templates).orderBy("pos").collect()]
    assert keys == [0, -1, 0, -1]


def test_frozen_vocabulary_by_message_equals_by_row(spark):
    rng = random.Random(8)
    draw = lambda n: [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(n)]
    spec = MiningSpec(depth=3, threshold=0.6, max_children=3)
    out = mine_templates(frame(spark, draw(150)), "text", ["pos"], spec)
    new = frame(spark, draw(200) + ["a b c d"] * 2000)  # one message is nine tenths of the rows
    rows = with_message(new, "text")
    one_by_one = _applied_by_row(rows, [F.col("pos"), F.col("text")], out.templates, spec)
    got = {r.pos: r.key for r in apply_templates(new, "text", out.templates, spec).collect()}
    assert got == {r.pos: r.key for r in one_by_one.collect()} and len(got) == 2200 and len(set(got.values())) > 5


def test_catalogue_counts_messages(spark):
    out = mine_templates(frame(spark, MESSAGES), "text", ["pos"])
    assert {r.key: r["size"] for r in catalogue(out.keys).collect()} == {0: 3, 1: 1, 2: 1}


def test_fold_searches_again_only_where_a_template_changed(monkeypatch):
    """The fold against a search for every row, on messages with wildcards of their own; steady messages are not searched again."""
    rng = random.Random(11)
    for threshold, length, tokens in ((0.6, 4, 6), (0.4, 5, 4), (0.0, 3, 5), (1.0, 3, 3), (0.5, 8, 3)):
        words = [[f"t{p}{i}" for i in range(tokens)] + ["<*>"] * (threshold < 0.6) for p in range(length)]
        rows = [("r", " ".join(rng.choice(w) for w in words), i) for i in range(4000)]
        batch = pd.DataFrame(rows, columns=["_leaf", "_msg", "_pos"])
        fast = pd.concat(leaves.fold_sorted(threshold)(iter([batch])))
        with monkeypatch.context() as m:
            m.setattr(leaves.Clusters, "still_joins", lambda *_: False)
            slow = pd.concat(leaves.fold_sorted(threshold)(iter([batch])))
        assert sorted(map(repr, fast.itertuples(index=False))) == sorted(map(repr, slow.itertuples(index=False)))
    searched = []
    best = leaves.Clusters.best
    monkeypatch.setattr(leaves.Clusters, "best", lambda self, x: searched.append(1) or best(self, x))
    # a new user every 20 rows opens a cluster, and all users so far go on sending their two messages
    rows = [("r", f"s3 {rng.choice(('Get', 'Put'))} ip{u} arn{u}", i) for i in range(20_000) for u in (rng.randrange(i // 20 + 1),)]
    list(leaves.fold_sorted(0.6)(iter([pd.DataFrame(rows, columns=["_leaf", "_msg", "_pos"])])))
    assert len(searched) < 6000


@pytest.mark.parametrize("length,limit", [(8, 160), (40, 60)])
def test_a_token_of_a_large_route_takes_few_bytes(length, limit):
    """6,000 distinct messages of one route, folded: sets of clusters by position and token took about 500 bytes a token."""
    rng = random.Random(length)
    rows = [("r", " ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(length)), i) for i in range(6000)]
    batches = [pd.DataFrame(rows[i : i + 1000], columns=["_leaf", "_msg", "_pos"]) for i in range(0, len(rows), 1000)]
    tracemalloc.start()
    out = sum(len(done) for done in leaves.fold_sorted(0.6)(iter(batches)))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert out >= 6000 and peak < limit * length * len(rows)
