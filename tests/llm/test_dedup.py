"""Exact, near and line deduplication and sharding against slow versions."""
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from tickloom.llm import components, exact_dedup, line_dedup, sharding, simhash

LONG = "word " * 60_000
ODD = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, LONG), (6, LONG), (7, LONG + "x"), (None, None), (8, "é" * 5000)]


def test_exact_groups_of_odd_rows(make):
    got = [tuple(r) for r in exact_dedup.exact_groups(make(ODD, clash=True), block_bytes=16).collect()]
    texts = [t or "" for _, t in ODD]
    assert len(got) == len(ODD)
    for i, keep, size, _, digest in got:
        alike = [(j, t or "") for j, t in ODD if hashlib.sha256((t or "").encode()).hexdigest() == digest]
        assert size == len(alike) and keep == max((j for j, _ in alike if j is not None), default=None)
        assert (i, digest) in {(j, hashlib.sha256(t.encode()).hexdigest()) for j, t in alike}
    assert sum(r[3] for r in got) == len(set(texts))
    assert all(r[0] == r[1] for r in got if r[3])


def test_exact_groups_survive_colliding_hashes(make):
    from pyspark.sql import functions as F

    def weak(block, seed):
        return F.struct(F.xxhash64(F.lit(seed), block).bitwiseAND(F.lit(3 if seed < 2 else -1)).alias("a"), F.lit(0).alias("b"))

    rows = [(i, str(i % 40) * 50) for i in range(100)]
    got = exact_dedup.exact_groups(make(rows), block_bytes=8, keys=weak).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, max(j for j in range(100) if j % 40 == i % 40)) for i in range(100)}
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(make(rows), block_bytes=8, keys=lambda b, s: F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))).collect()


def test_tables_without_rows(make, spark):
    none = make([])
    assert exact_dedup.exact_groups(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).columns == none.columns
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates_against_all_pairs(make):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 40, 300)))]
        for j in range(rng.choice((1, 1, 4))):
            rows.append((10 * i + j, " ".join(words)))
            if words:
                words = [*words[:-1], f"Ärger{j}"]
    rows.append((5, LONG))
    got = {r.doc_id: r for r in simhash.near_duplicates(make(rows, clash=True)).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want


def test_near_duplicates_of_odd_rows(make):
    got = simhash.near_duplicates(make(ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {2}
    kept = simhash.one_of_each(make(ODD, clash=True)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got})
    assert {r["_th"] for r in kept} == {"x"}


def test_links_connect_all_pairs_in_large_buckets(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {center}
    for _ in range(400):
        x = center
        for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
            x ^= 1 << b
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for paired in (2, 16, 10_000):
        edges = simhash.links(nodes, 2, paired)
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
        got = {r.node: r.root for r in components.components(edges).collect()}
        want = slow_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
        assert {x: got.get(x, x) for x in signed} == want


def test_masks_cover_every_pair_in_the_radius():
    for radius in (2, 4):
        tables = simhash.masks(radius)
        rng = random.Random(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in tables)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}}


def test_lines_of_odd_rows(make):
    shared, short = "This is a line that very many documents have in common.", "too short"
    rows = [(i, f"  {shared.upper()}\t\nown line of document {i} that no other has\n{short}\n\n") for i in range(4)]
    rows += [(4, shared), (4, shared), (None, f"{shared}\nx"), (9, f"{shared}\n{shared}"), (10, None), (11, ""), (12, "ü" * 39), (13, "\n")]
    got = line_dedup.dedup_lines(make(rows, clash=True)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append((r.text, r["_n_lines"], r["_n_dropped"]))
    assert texts[0] == [(f"own line of document 0 that no other has\n{short}\n\n", 5, 1)]
    assert texts[4] == [("", 1, 1)] * 2
    assert texts[None] == [("x", 2, 1)]
    assert texts[9] == [(f"{shared}\n{shared}", 2, 0)]
    assert texts[10] == texts[11] == [("", 1, 0)] and texts[13] == [("\n", 2, 0)]
    assert line_dedup.line_hash(b"\xc3\xbc" * 39, 40) is None and line_dedup.line_hash(b"\xc3\xbc" * 40, 40) is not None


def slow_capacity(sizes, shards):
    def fits(c):
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shards_have_the_least_capacity(make, seed):
    rng = random.Random(seed)
    texts = [rng.choice("abc") * rng.choice((1, 5, 50, 700 if seed == 2 else 60)) + str(rng.randrange(80)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, None), (0, texts[0]), (1000, "")]
    got = sharding.shard(make(rows, clash=True)).collect()
    sizes = {}
    for _, t in rows:
        d = hashlib.sha256((t or "").encode()).hexdigest()
        sizes[d] = sizes.get(d, 0) + len((t or "").encode()) + 1
    load, where, slots = {}, {}, {}
    for r in got:
        load[r["_shard"]] = load.get(r["_shard"], 0) + r["_size"]
        where.setdefault(r["_digest"], set()).add(r["_shard"])
        slots.setdefault(r["_shard"], []).append(r["_slot"])
    assert max(load.values()) == slow_capacity([sizes[d] for d in sorted(sizes)], 8)
    assert all(len(s) == 1 for s in where.values()) and set(load) <= set(range(8))
    order = sorted(where)
    assert [min(where[d]) for d in order] == sorted(min(where[d]) for d in order)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fewer_groups_than_shards(make):
    got = sharding.shard(make([(1, "a"), (2, "b"), (3, "a")])).collect()
    assert len({r["_shard"] for r in got if r["_digest"] == got[0]["_digest"]}) == 1 and len(got) == 3
    assert zlib.crc32(b"") == 0
