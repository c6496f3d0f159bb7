"""Line deduplication: lines that many documents share stay in one of them only."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import spare, sparing
from tickloom.sources.session import settle

LEAST_CHARS = 40
LEAST_DOCS = 5
_SPACE = b" \t\n\v\f\r"


def line_hash(line: bytes, least_chars: int) -> bytes | None:
    """128-bit hash of a line's key, None for a key that is too short to count."""
    key = line.strip(_SPACE).lower()  # of bytes: A-Z only
    if len(key) < least_chars or not key.isascii() and len(key.decode()) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _hashed(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                for key in {line_hash(x, least_chars) for x in (text.as_py() or b"").split(b"\n")} - {None}:
                    ids.append(i)
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _rebuilt(least_chars: int, drop_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, gone = [], [], []
            for text, drop in zip(batch.column("text").cast(pa.large_binary()), batch.column(drop_name), strict=True):
                parts = (text.as_py() or b"").split(b"\n")
                drop = drop.as_py()
                kept = parts
                if drop:
                    drop = set(drop)
                    kept = [x for x in parts if line_hash(x, least_chars) not in drop]
                texts.append(b"\n".join(kept))
                lines.append(len(parts))
                gone.append(len(parts) - len(kept))
            names = [n for n in batch.schema.names if n not in ("text", drop_name, "_n_lines", "_n_dropped")]
            arrays = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                [*names, "text", "_n_lines", "_n_dropped"],
            )

    return run


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with shared lines taken out of ``text``, and ``_n_lines`` and ``_n_dropped``.

    A line's key is the line without blanks ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. A key of at least
    ``least_chars`` code points that at least ``least_docs`` rows hold loses all its lines, but for those in the
    rows with the largest ``doc_id`` that holds it. The other lines stay in place and are joined by ``\\n``.

    Lines become 16-byte hashes at once, one per key and row; hashes are counted with partial sums, and only
    those over the limit meet the documents again. Null and empty texts are one empty line (and come out
    empty). Each row is a document of its own, repeated rows too; rows with a null ``doc_id`` keep a line only
    if no row with an id holds it. Other columns pass unchanged (but for ones named like the two results), an empty table gives an empty table.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    keys = docs.select("doc_id", "text").mapInArrow(sparing(_hashed(least_chars)), f"doc_id {ids}, key binary")
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("stays"))
    shared = settle(counted.where(F.col("n") >= least_docs).select("key", "stays"), "shared-lines")
    hits = keys.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    to, drop = spare(docs, "_to", "_drop")
    drops = hits.groupBy(F.col("doc_id").alias(to)).agg(F.collect_set("key").alias(drop))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[to]), "left").drop(to)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("text", "_n_lines", "_n_dropped")]
    schema = ", ".join([*fields, "text string", "_n_lines long", "_n_dropped long"])
    return joined.mapInArrow(sparing(_rebuilt(least_chars, drop)), schema)
