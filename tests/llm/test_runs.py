"""Periodic runs against slow versions."""
import hashlib
import os
import random
import re
import zlib

import pytest

from tickloom.llm import periodic_runs, queries

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def slow_runs(words, least, exponent):
    """Every period by itself: stretches that keep it, without those that keep a smaller one."""
    out = set()
    for p in range(1, len(words) // exponent + 1):
        same = [words[i] == words[i + p] for i in range(len(words) - p)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                own = words[i : j + p]
                if not any(own[q:] == own[:-q] for q in range(1, p)):
                    out.add((i, j - i + p, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(5)
        words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 2), (6, 3), (9, 5)])
def test_runs_of_random_lists(least, exponent):
    rng = random.Random(least)
    for _ in range(600):
        words = periodic(rng, rng.randrange(50), rng.choice((1, 2, 3, 6)))
        assert periodic_runs.runs_of(words, least, exponent) == slow_runs(words, least, exponent)


def test_agreement_of_suffixes():
    rng = random.Random(5)
    for n in (1, 2, 7, 40):
        s = periodic(rng, n, 2)
        tree = periodic_runs.SuffixTree(s)
        ahead = periodic_runs.Agreement(*tree.tour())
        for i in range(n):
            for j in range(n + 1):
                if i != j:
                    k = 0
                    while max(i, j) + k < n and s[i + k] == s[j + k]:
                        k += 1
                    assert ahead(periodic_runs.np.array([i]), periodic_runs.np.array([j])).tolist() == [k]


def test_words_in_no_run_are_set_aside_without_loss(make):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.choice((1, 3))):
            words += [f"w{x}" for x in periodic(rng, rng.choice((3, 30)), rng.choice((2, 4, 50)))]
            words += [f"v{rng.randrange(9)}" for _ in range(rng.choice((0, 5, 40)))]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(make(rows, clash=True), "doc_id").collect()}
    assert any(len(r.runs) > 1 for r in got.values())
    for i, text in rows:
        words = text.split(" ")
        runs = slow_runs(words, 6, 4)
        assert [tuple(x) for x in got[i].runs] == runs and got[i].n_words == len(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        assert got[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)


def test_odd_rows(make):
    one_word, long = "na " * 200_000, " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b a b"), (5, one_word), (None, "x " * 6), (6, "A a " * 4), (6, "A a " * 4), (7, long), (8, "　 " * 5), (9, "x " * 5)]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(make(rows, clash=True), "doc_id").collect()), key=repr)
    assert got == sorted(
        [
            (1, 0, [], ""),
            (2, 0, [], ""),
            (3, 0, [], ""),
            (4, 3, [], "a b a b"),
            (5, 200_000, [(0, 200_000, 1)], "na"),
            (0, 6, [(0, 6, 1)], "x"),
            (6, 8, [(0, 8, 2)], "A a"),
            (6, 8, [(0, 8, 2)], "A a"),
            (7, 60_000, [(0, 60_000, 5000)], " ".join(f"w{i}" for i in range(5000))),
            (8, 5, [], " ".join(["　"] * 5)),
            (9, 5, [], " ".join(["x"] * 5)),
        ],
        key=repr,
    )
    assert periodic_runs.periodic_runs(make([]), "doc_id").count() == 0
    assert periodic_runs.with_planted_periods(make(rows, clash=True)).columns == make(rows, clash=True).columns
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(make([]), exponent=1)


def test_the_query_against_a_slow_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        if len(words) > 2000:
            continue  # the slow version takes the square of the length
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = slow_runs(words, 6, 4)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert planted > 20
