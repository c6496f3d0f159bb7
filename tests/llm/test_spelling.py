"""Spelling variants against slow versions."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def slow_variants(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def edited(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice((word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :], word + rng.choice(letters)))


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abc", 8), ("aéÿz", 12), ("語言😀", 30)])
def test_variants_against_all_pairs(spark, letters, longest):
    rng = random.Random(len(letters))
    words = {}
    if longest > 12:
        words = {letters[0] * n + letters[1] * (90 - n): 2 for n in range(0, 90, 7)} | {letters[0] * n + letters[1] * (89 - n): 40 for n in range(0, 80, 5)}
    while len(words) < 250:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, longest + 1)))
        for _ in range(rng.choice((0, 1, 4))):
            words[word] = rng.choice((2, 3, 20, 30, 200, 300, 5000))
            word = edited(rng, word, letters)
            if len(word) < 7:
                break
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.variants(table).collect()]
    assert sorted(got) == slow_variants(words)


def test_forms_lead_through_many_steps(spark):
    words = {"a" * 7 + "b" * i: 2 * 10**i for i in range(12)} | {"c" * 40 + "d" * i: 2 * 10**i for i in range(3)} | {"x" * 50_000: 2, "x" * 50_001: 40, "y" * 50_000 + "z": 4}
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {w: got[w].root for w in words if w[0] == "a"} == {w: "a" * 7 + "b" * 11 for w in words if w[0] == "a"}
    assert got["x" * 50_000].form == "x" * 50_001 and got["y" * 50_000 + "z"].n_near == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_pivots_are_disjoint_and_weigh_least():
    rng = random.Random(4)
    for _ in range(500):
        places = rng.sample(range(12), rng.choice((3, 4, 6)))
        prefix = [(rng.randrange(1, 9), p) for p in places]
        a, b = spelling.pivots_of(prefix)
        weight = dict((p, w) for w, p in prefix)
        assert b - a >= 2
        assert weight[a] + weight[b] == min(w + v for w, p in prefix for v, q in prefix if q - p >= 2)
    assert spelling.prefix_of("aaaaaaa", np.zeros(spelling.CLASSES, np.int64))[0] == [(0, p) for p in range(5)]


def test_counting_odd_rows(make):
    rows = [(1, "Straßen straßen STRASSEN"), (2, None), (3, ""), (None, "Wörterbuch, wörterbuch"), (4, "Wörterbuch\nabcdefg"), (4, "Wörterbuch\nabcdefg"), (5, "abc1defghijk x×÷yabcde Àbcdefg àbcdefg"), (6, "lang " * 10 + "n" * 70_000 + " " + "n" * 70_000)]
    for plant in (False, True):
        want = Counter()
        for i, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if plant and h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    want[run] += 1
        got = {r.word: r.n for r in spelling.count_words(make(rows, clash=True), plant=plant).collect()}
        assert got == {w: n for w, n in want.items() if n >= 2}
    assert spelling.variants(spelling.count_words(make([]))).count() == 0
    assert spelling.count_words(make([(1, "abcdefg")])).count() == 0
