"""Files that are one JSON text, read in pieces, against Python's own reader."""

import json
import random

import pytest

from seqwarden.sources.json_pieces import scan_elements


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    texts = ["", "a", 'q"uote', "back\\slash", "}", "{", '"}"', "[],:", "\\", "\\}", '\\"}', "Records", "é漢", "line\nbreak", ' "Records": [ ']
    if kind < 2:
        return rng.choice(texts)
    if kind < 4:
        return rng.choice([1, -2.5, None, True])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b}", "Records", 'k"', "c\\"]) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def event(rng):
    return {"id": rng.randrange(10**6), "x": value(rng), "Records": [value(rng)] if rng.random() < 0.2 else None}


def texts_of(rng):
    """(text, events) of files in every form."""
    events = [event(rng) for _ in range(rng.choice([1, 2, 30]))]
    indent = rng.choice([None, 2])
    envelope = rng.choice([{"Records": events}, {"meta": {"n": [1, {"a": "}"}]}, "Records": events}, {"other": [{"o": 1}, {"o": 2}], "Records": events, "last": [{"l": 1}]}])
    single = {"id": 1, "x": value(rng)}
    return [
        ("envelope", json.dumps(envelope, indent=indent, ensure_ascii=rng.random() < 0.5), events),
        ("array", json.dumps(events, indent=indent), events),
        ("object", json.dumps(single, indent=2) + "\n", [single]),
    ]


@pytest.mark.parametrize("split", ["128m", "1500"])
def test_pieces_equal_the_whole_text(spark, tmp_path, split):
    rng = random.Random(11)
    want = {}
    for i in range(6):
        for form, text, events in texts_of(rng):
            name = f"{i:02d}-{form}.json"
            (tmp_path / name).write_text(text)
            want[name] = events
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = scan_elements(spark, str(tmp_path)).orderBy("source_file", "ordinal").collect()
        only = {form: scan_elements(spark, str(tmp_path), form=form).count() for form in ("array", "envelope")}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {}
    for r in rows:
        got.setdefault(r["source_file"].rsplit("/", 1)[1], []).append(json.loads(r["value"]))
    assert got == want
    assert only == {form: sum(len(e) for n, e in want.items() if form in n) for form in only}


def test_files_without_events(spark, tmp_path):
    for name, text in {"a": "", "b": " \n", "c": "[]", "d": '{"Records": []}', "e": '{"Records": [ ]\n}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert scan_elements(spark, str(tmp_path), form="envelope").collect() == []
    assert scan_elements(spark, str(tmp_path), form="array").collect() == []
