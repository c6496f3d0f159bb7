"""How the documents are dealt for the lattice."""
import random
import time

import pyarrow as pa
import pytest

from tickloom.llm import sentencepiece_lattice as lattice


@pytest.fixture(scope="module")
def pieces():
    return lattice.load_pieces(lattice.default_model())


def test_paths_reach_the_blocks_without_a_join(make, pieces):
    out = lattice.encode(make([(1, "some words"), (2, "more words")]), pieces)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 3  # words, paths, documents


def test_runs_do_not_depend_on_batches():
    rng = random.Random(1)
    texts = [rng.choice([None, "", "x" * rng.randrange(40), "y" * 300]) for _ in range(900)]
    cut = lambda sizes: [pa.record_batch({"text": pa.array(texts[a:b], pa.string())}) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    runs = [[(rows.num_rows, data.tobytes()) for rows, _, data in lattice._runs(iter(cut(sizes)), 256)] for sizes in ([0, 900], [0, 1, 400, 401, 401, 900], [*range(901)])]
    assert runs[0] == runs[1] == runs[2]
    assert sum(n for n, _ in runs[0]) == 900


def test_a_very_long_word_takes_seconds(make, pieces):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef") for _ in range(60_000))
    began = time.time()
    (r,) = lattice.decode(lattice.encode(make([(1, text)]), pieces), pieces).collect()
    assert r.text == text
    assert time.time() - began < 60
