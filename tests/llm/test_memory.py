"""What the workers hold beside their rows."""
import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import common
from tickloom.llm.common import Words, not_space, lower_ascii, text_slices

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Prints the MB that a worker's function leaves behind in a process of its own.
LEFT = """
import gc, re
import numpy as np, pyarrow as pa
from tickloom.llm import toxicity

class Docs:
    schema = []
    def mapInArrow(self, run, schema):
        return run

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(1)
model = toxicity.Model(np.sort(rng.integers(0, 1 << 63, 4096).astype(np.uint64)), np.zeros(4096), -3.0)
words = np.array([f"word{i}" for i in range(5000)])
batches = lambda: (pa.record_batch({"text": pa.array([" ".join(words[rng.integers(0, 5000, 250)]) for _ in range(4000)])}) for _ in range(3))
rows = sum(b.num_rows for b in batches())
gc.collect()
before = held()
assert sum(out.num_rows for out in toxicity.not_toxic(Docs(), model)(batches())) == rows
gc.collect()
print(held() - before)
"""


def test_texts_are_read_where_they_lie():
    column = pa.array(["some words and more " * 50] * 3000).slice(7)
    tracemalloc.start()
    pool = pa.total_allocated_bytes()
    got = [(first, len(offsets) - 1, data[:4].tobytes()) for first, offsets, data in text_slices(column, 1 << 16)]
    assert pa.total_allocated_bytes() - pool < 100_000
    assert tracemalloc.get_traced_memory()[1] < 200_000
    tracemalloc.stop()
    assert sum(n for _, n, _ in got) == len(column) and {x for _, _, x in got} == {b"some"}


def test_texts_with_nulls_slices_and_wide_offsets():
    texts = ["x", None, "", "ä b", "c"]
    for kind in (pa.string(), pa.large_string(), pa.string_view()):
        for column in (pa.array(texts, kind).slice(1), pa.chunked_array([pa.array(texts[1:3], kind), pa.array(texts[3:], kind)])):
            got = [data[a:b].tobytes().decode() for _, offsets, data in text_slices(column) for a, b in zip(offsets[:-1], offsets[1:])]
            assert got == ["", "", "ä b", "c"], (kind, got)


def test_word_hashes_take_eight_bytes_a_byte():
    data = np.frombuffer(b"many words " * 20_000, np.uint8)
    words = Words(np.array([0, len(data)]), data, not_space(), lower_ascii())
    Words(np.array([0, 2]), data[:2], not_space(), lower_ascii()).hashes()  # the powers are kept
    tracemalloc.start()
    hashes = words.hashes()
    assert tracemalloc.get_traced_memory()[1] < 8 * len(data) * 1.2 + 8 * 8 * len(hashes)
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 2


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_workers_give_memory_back():
    out = subprocess.run([sys.executable, "-c", LEFT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert float(out.stdout) < 30, out.stderr


def test_powers_are_as_many_as_the_slices_need():
    common._kept_powers.clear()
    for size in (1000, 1 << 18, 5000):
        data = np.frombuffer(b"many words " * (size // 11), np.uint8)
        Words(np.array([0, len(data)]), data, not_space(), lower_ascii()).hashes()
    assert sum(x.nbytes for x in common._kept_powers) < 17 << 18


def test_hashes_do_not_depend_on_the_powers_kept():
    data = np.frombuffer("some Wörds and more words ".encode() * 3000, np.uint8)
    hashes = []
    for kept in (0, 1 << 10, common.PIECE_BYTES):
        common._kept_powers.clear()
        if kept:
            common._powers(kept)
        hashes.append(Words(np.array([0, len(data)]), data, not_space(), lower_ascii()).hashes())
    assert (hashes[0] == hashes[1]).all() and (hashes[0] == hashes[2]).all()


def test_few_rows_at_a_time_are_all_rows_in_order():
    sizes = [0, 1, common.TAKEN_ROWS, 0, 2 * common.TAKEN_ROWS + 3]
    ends = np.cumsum(sizes)
    batches = [pa.record_batch({"x": pa.array(np.arange(b - n, b))}) for n, b in zip(sizes, ends, strict=True)]
    got = list(common.sparing(lambda rows: rows)(iter(batches)))
    assert [x for b in got for x in b.column("x").to_pylist()] == list(range(sum(sizes)))
    assert max(b.num_rows for b in got) == common.TAKEN_ROWS
    assert list(common.sparing(lambda rows: rows)(iter([]))) == []
