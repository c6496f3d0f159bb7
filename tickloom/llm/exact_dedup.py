"""Exact deduplication by naming blocks.

A text is cut into blocks of fixed size. The distinct blocks of all texts are sorted and get integer names;
then adjacent names are paired and the distinct pairs named in the same way, until each document has one
name. Two documents of equally many blocks have the same name exactly when their texts are equal: names
stand for contents, not for digests.

A 128-bit hash only carries names back to their blocks, so that texts are shuffled once. It may do so
because the hashes of all distinct blocks are checked to differ; should two ever agree, another seed is taken.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.session import settle

BLOCK_BYTES = 8192
SEEDS = 16


def block_keys(block: Column, seed: int) -> Column:
    """Two hashes of a block; they find its name."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def name_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keys=block_keys) -> DataFrame:
    """(row, pos, n, name): the named blocks of each row.

    ``row`` numbers the rows of ``docs`` within this settled result; ``doc_id`` and the text's SHA-256 go with it.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select("doc_id", body.alias("body"))
    count = F.greatest(F.ceil(F.octet_length("body") / block_bytes), F.lit(1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("body", i * block_bytes + 1, F.lit(block_bytes)))
    for seed in range(SEEDS):
        distinct = texts.select(F.explode(blocks).alias("block")).distinct().sortWithinPartitions("block")
        names = settle(distinct.select(keys(F.col("block"), seed).alias("key"), F.monotonically_increasing_id().alias("name")), "block-names")
        if names.count() == names.select("key").distinct().count():
            break
    else:
        raise ValueError("no seed keeps the hashes of all blocks apart")
    rows = settle(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("body", 256).alias("text_sha256"),
            F.transform(blocks, lambda b: keys(b, seed)).alias("keys"),
        ),
        "block-rows",
    )
    placed = rows.select("row", "doc_id", "text_sha256", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    return placed.join(names, "key").select("row", "doc_id", "text_sha256", "n", "pos", "name")


def name_documents(blocks: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, n, name): one name per row, by pairing adjacent names again and again."""
    level = settle(blocks, "names")
    most = level.agg(F.max("n")).first()[0] or 1
    done = []
    carried = ("row", "doc_id", "text_sha256", "n")
    for k in range(math.ceil(math.log2(most)) + 1):
        left = F.ceil(F.col("n") / 2**k)
        done.append(level.where(left == 1).select(*carried, "name"))
        if 2**k >= most:
            break
        pairs = (
            level.where(left > 1)
            .groupBy(*carried, F.floor(F.col("pos") / 2).alias("half"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("x"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("y"))
        )
        pairs = settle(pairs, "pairs")
        named = settle(pairs.select("x", "y").distinct().sortWithinPartitions("x", "y").withColumn("name", F.monotonically_increasing_id()), "pair-names")
        level = pairs.join(named, ["x", "y"]).select(*carried, F.col("half").alias("pos"), "name")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keys=block_keys) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Needs ``doc_id`` and ``text``; other columns are ignored. Null texts count as empty, and empty texts are
    equal. The row with the largest ``doc_id`` stays; where repeated rows share it, the first of them (by the
    settled row number) is kept alone. A null ``doc_id`` loses against any other. An empty table gives none.
    """
    named = settle(name_documents(name_blocks(docs, block_bytes, keys)), "identities")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
    # written first: a join against plain rows may split the rows of one text over tasks, one that shares its shuffle with the aggregate may not
    groups = settle(named.groupBy("n", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.row")).alias("kept"),
        "text_sha256",
    )
