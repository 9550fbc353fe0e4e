"""What a Python worker holds while it packs and afterwards; each measure is taken in a process of its own."""

import subprocess
import sys

import pyarrow as pa
import pytest

from seqwarden.llm.batches import releasing

PACKS = """
import random, re, threading, time
from unittest.mock import MagicMock

import public_tokenizers
import pyarrow as pa

from seqwarden.llm import packing

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
text = lambda: " ".join("".join(rng.choices(syllables, k=4)) for _ in range(2000))
batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([text() for _ in range(400)])], ["doc_id", "t"])
packing._tokenizer(path)
base, peak, over = mb(), [0], []

def watch():
    while not over:
        peak[0] = max(peak[0], mb())
        time.sleep(0.01)

at = threading.Thread(target=watch)
at.start()
packing.F, docs = MagicMock(), MagicMock()
docs.select.return_value.mapInArrow = lambda run, _: list(run(iter([batch])))
found = packing.pieces(docs, path)
over.append(True)
at.join()
print(len(found), sum(b.num_rows for b in found), peak[0] - base)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_packing_many_long_texts_takes_bounded_memory():
    # the stand-in for a frame hands one batch of 400 texts (7 MB, 800,000 words nearly all distinct) to the operator's function
    done = subprocess.run([sys.executable, "-c", PACKS], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    batches, pieces, grown = done.stdout.split()
    assert int(batches) > 1 and int(pieces) > 400
    assert float(grown) < 300, f"{grown} MB"


def test_what_arrow_keeps_is_released_when_a_task_is_over(monkeypatch):
    calls = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: calls.append(pool.bytes_allocated())})())

    @releasing
    def run(batches):
        for b in batches:
            yield b

    one = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    rows = run(iter([one, one]))
    next(rows)
    assert not calls
    assert len(list(rows)) == 1 and len(calls) == 1
