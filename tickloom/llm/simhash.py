"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Each of the 2**(r+1) - 1 tables looks at fingerprints through a structured bit mask: every bit position has a
non-zero vector of r + 1 bits, and the mask of table v holds the positions whose vector has an odd product with v.
Any r positions leave a v for which all their products are even, so two fingerprints that differ in at most
r bits agree under some mask: no pair within the radius is missed.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import content_key, spare, sparing
from tickloom.llm.components import components
from tickloom.sources.session import settle

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Fingerprints in a bucket up to which its pairs are compared one by one.
PAIRED = 16
#: Words whose shingles are hashed together.
STRETCH = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: a bit is set if more than half of the shingles' XXH64 have it."""
    words = text.lower().split()  # of bytes: A-Z only, blanks are 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    ones, n = np.zeros(BITS, np.int64), 0
    for first in range(0, max(1, len(words) - shingle + 1), STRETCH):
        part = words[first : first + STRETCH + shingle - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False)) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_th"), pa.array(prints, pa.int64())], ["doc_id", "_th", "fp"])

    return run


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks, as signed longs; the vectors of the positions go round all non-zero values."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    out = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2)
        out.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return out


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _flips(distance: int, bits: list[int]) -> list[int]:
    """Patterns of up to ``distance`` set bits among ``bits``."""
    flips = {0}
    for _ in range(distance):
        flips |= {f ^ (1 << b) for f in flips for b in bits}
    return sorted(map(_signed, flips))


def links(prints: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints ``fp`` differ in at most ``radius`` bits, an even number.

    In a bucket of at most ``paired`` fingerprints all pairs are compared. A larger bucket would grow with its square;
    there each fingerprint sends itself and its neighbours at up to ``radius`` / 2 flips of unmasked bits, and those
    that meet in a neighbour are tied to the least one. They are within the radius of each other, and any two
    within the radius meet half-way, so the components are those of all pairs.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = masks(radius)
    spread = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key"))
    sizes = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    full = settle(spread.join(sizes, ["t", "key"]), "buckets")
    few = full.where(F.col("n") <= paired).select("t", "key", "fp")
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("b")))
    pairs = few.join(few.withColumnRenamed("fp", "b"), ["t", "key"]).where((F.col("fp") < F.col("b")) & (differing <= radius)).select(F.col("fp").alias("a"), "b")
    free = [[i for i in range(BITS) if not m >> i & 1] for m in tables]
    flips = F.array(*[F.array(*[F.lit(f) for f in _flips(radius // 2, bits)]) for bits in free])
    many = full.where(F.col("n") > paired).select("t", "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    sent = many.select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    hubs = sent.groupBy("t", "z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("t", "z", "a")
    stars = sent.join(hubs, ["t", "z"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _th, fp, component_id), a row for each row of ``docs``.

    Words are split at blanks after A-Z are lower-cased; shingles are ``shingle`` words, repeats included, joined by a blank; a text
    of fewer words is one shingle, one without words has fingerprint zero, and links like any other. Null counts
    as empty. Rows with equal fingerprints are one node; nodes link at up to ``radius`` differing bits.
    ``component_id`` is the least ``doc_id`` that can be reached; it is null only where no row of the component has
    an id. Repeated rows get equal results, other columns are ignored, an empty table gives none.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", content_key(docs), "text").mapInArrow(sparing(_fingerprints(shingle)), f"doc_id {ids}, _th long, fp long")
    rows = settle(rows, "simhash")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = settle(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "_th", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, that with the least ``doc_id``.

    Repeated rows of that id are one row. A component whose rows have no id keeps the one with the least content hash.
    """
    found = near_duplicates(docs, shingle, radius)
    stays = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_th")).alias("k"))
    stays = stays.select(F.col("k.doc_id").alias("_id"), F.col("k._th").alias("_t"))
    (key,) = spare(docs, "_th")
    keyed = docs.withColumn(key, content_key(docs))
    kept = keyed.join(stays, keyed["doc_id"].eqNullSafe(stays["_id"]) & (keyed[key] == stays["_t"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*docs.columns)
