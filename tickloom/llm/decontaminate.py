"""Benchmark decontamination by winnowing.

Fingerprints of a text are the least k-gram hashes of each run of w consecutive k-grams, so that any two texts
which share a span of k + w - 1 words share a fingerprint of it. Document and benchmark fingerprints meet in
a join; each hit is extended to the benchmark windows around it, which are compared word for word.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Words, alphanumeric, content_key, lower_ascii, mixed, spare, sparing, text_slices
from tickloom.sources.session import settle

WINDOW = 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A hit is packed as position * 2**8 + words of the window.
_PACK = 256
#: Bytes of text that a task fingerprints at once.
_SLICE = 1 << 19


def gram_length(window: int) -> int:
    """k for a guaranteed span of ``window`` words; the sliding window then has ``window`` - k + 1 grams."""
    return (window + 1) // 2


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a k-gram's first word, hash) of every gram that is the least of some sliding window."""
    k = gram_length(window)
    w = window - k + 1
    n = len(words.start) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    each = words.hashes()
    grams = np.zeros(n + w - 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x100000001B3) + each[j : j + n + w - 1]
    grams = mixed(grams)
    least = grams[:n].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + n], out=least)
    whole = words.text[:n] == words.text[window - 1 : window - 1 + n]  # the sliding window lies in one text
    chosen = np.zeros(len(grams), bool)
    for j in range(w):
        chosen[j : j + n] |= whole & (grams[j : j + n] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _winnowed(lengths: tuple[int, ...]):
    """Rows (doc_id, _th, hit, m, fp) of the documents for each window length in ``lengths``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, fold = alphanumeric(), lower_ascii()
        for batch in batches:
            for first, offsets, data in text_slices(batch.column("text"), _SLICE):
                words = Words(offsets, data, keep, fold)
                for m in lengths:
                    at, fp = fingerprints(words, m)
                    row = words.text[at]
                    taken = pa.array(row + first)
                    hit = (at - words.first[row]) * _PACK + m
                    columns = [batch.column("doc_id").take(taken), batch.column("_th").take(taken), pa.array(hit), pa.array(np.full(len(at), m, np.int32)), pa.array(fp.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_th", "hit", "m", "fp"])

    return run


def _item_windows(window: int):
    """Rows (item_id, win, m, fp) of the benchmark: each window with each of its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, fold = alphanumeric(), lower_ascii()
        for batch in batches:
            ids, wins, ms, fps = [], [], [], []
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                found = _WORD.findall((text.as_py() or "").encode().lower())
                m = min(len(found), window)
                for i in range(len(found) - m + 1 if m else 0):
                    win = b" ".join(found[i : i + m])
                    for fp in set(fingerprints(Words(np.array([0, len(win)]), np.frombuffer(win, np.uint8), keep, fold), m)[1].tolist()):
                        ids.append(item.as_py())
                        wins.append(win.decode())
                        ms.append(m)
                        fps.append(fp)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("item_id").type), pa.array(wins, pa.string()), pa.array(ms, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["item_id", "win", "m", "fp"],
            )

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count of each document and, around its hits, the windows that may be a benchmark's."""
    keep, fold = alphanumeric(), lower_ascii()
    for batch in batches:
        counts = [Words(offsets, data, keep, fold).count for _, offsets, data in text_slices(batch.column("text"), _SLICE)]
        starts, wins = [], []
        for text, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
            at, around = [], []
            if hits.is_valid:
                found = _WORD.findall((text.as_py() or "").encode().lower())
                asked = set()
                for hit in hits.as_py():
                    pos, m = divmod(hit, _PACK)
                    asked.update((i, m) for i in range(max(0, pos + gram_length(m) - m), min(pos, len(found) - m) + 1))
                for i, m in sorted(asked):
                    at.append(i * _PACK + m)
                    around.append(b" ".join(found[i : i + m]).decode())
            starts.append(at)
            wins.append(around)
        total = np.concatenate(counts) if counts else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_th"), pa.array(total.astype(np.int64)), pa.array(starts, pa.list_(pa.int64())), pa.array(wins, pa.list_(pa.string()))],
            ["doc_id", "_th", "n_words", "starts", "wins"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark passages in documents: (doc_id, _th, n_words, spans, n_hit, n_items, item_ids), one row per row of ``docs``.

    Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z are lower-cased. A window is
    ``window`` consecutive words of an item, or all words of a shorter item that has any. ``spans`` holds (start, words) of every
    occurrence of a window, ``n_hit`` the words inside any of them, ``item_ids`` the items with such windows,
    sorted as text. Null and empty texts have no words and no hits; null item ids are left out of
    ``item_ids``. Repeated rows get equal results. Other columns are ignored; with no documents or no items there are no hits.

    Shorter items are winnowed by their own length, so only the lengths that occur cost anything. Items are
    looked up once per set of windows, so a passage that many documents and items share is not multiplied out.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    item_id = items.schema["item_id"].dataType.simpleString()
    known = settle(items.select("item_id", "text").mapInArrow(sparing(_item_windows(window)), f"item_id {item_id}, win string, m int, fp long"), "item-windows")
    lengths = tuple(sorted(r[0] for r in known.select("m").distinct().collect()))  # at most ``window`` numbers
    prints = settle(known.select("m", "fp").distinct(), "item-prints")
    keyed = docs.select("doc_id", "text", content_key(docs))
    found = keyed.mapInArrow(sparing(_winnowed(lengths)), f"doc_id {ids}, _th long, hit long, m int, fp long")
    hits = found.join(prints, ["m", "fp"], "left_semi").groupBy("doc_id", "_th").agg(F.collect_set("hit").alias("hits"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t"), "hits")
    met = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits["_id"]) & (keyed["_th"] == hits["_t"]), "left")
    met = settle(met.select("doc_id", "_th", "text", "hits").mapInArrow(sparing(_extended), f"doc_id {ids}, _th long, n_words long, starts array<long>, wins array<string>"), "windows-around-hits")

    windows = settle(known.select("win").distinct(), "distinct-windows")
    around = met.where(F.size("wins") > 0).select("doc_id", "_th", F.explode(F.arrays_zip("starts", "wins")).alias("w")).select("doc_id", "_th", F.col("w.starts").alias("at"), F.col("w.wins").alias("win"))
    real = around.join(windows, "win", "left_semi").groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("win")).alias("win"))
    real = settle(real.withColumn("sig", F.sha2(F.concat_ws(",", "win"), 256)), "hits")
    sets = real.groupBy("sig").agg(F.first("win").alias("win")).select("sig", F.explode("win").alias("win"))
    owners = known.where("item_id is not null").select("win", F.col("item_id").cast("string").alias("item")).distinct()
    items_of = sets.join(owners, "win").groupBy("sig").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))

    def covered(acc, at):
        start, end = F.floor(at / _PACK), F.floor(at / _PACK) + at % _PACK
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["n"] + F.greatest(end - F.greatest(start, acc["upto"]), F.lit(0))).alias("n"))

    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    hit = real.join(items_of, "sig", "left").select(
        F.col("doc_id").alias("_id"),
        F.col("_th").alias("_t"),
        F.transform("at", lambda a: F.struct(F.floor(a / _PACK).cast("int").alias("start"), (a % _PACK).cast("int").alias("words"))).alias("spans"),
        F.aggregate("at", zero, covered, lambda acc: acc["n"]).alias("n_hit"),
        "item_ids",
    )
    rows = met.select("doc_id", "_th", "n_words")
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit["_id"]) & (rows["_th"] == hit["_t"]), "left").select(
        "doc_id",
        "_th",
        "n_words",
        "spans",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean_only(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns as they are."""
    bad = decontaminate(docs, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t")).distinct()
    (key,) = spare(docs, "_th")
    keyed = docs.withColumn(key, content_key(docs))
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed[key] == bad["_t"]), "left_anti").select(*docs.columns)
