"""Groups spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered from rare to frequent; the first three are its prefix, of which dynamic programming chooses two
that share no letter, the pivots. One edit changes one of two disjoint bigrams at most. So of two words that are one edit apart, the one whose
prefix ends earlier in that order has a pivot that is left whole, and it is in the other's prefix, moved by one place at most.
Pivots meet prefixes in an equi-join, and every pair found is verified.

The edit is left of the second pivot or, if not, right of the first. The join's key is therefore the word from the second pivot on, or
up to the first, with the other word's length; where that side is under half of the word, half of the rest goes with it, since one edit leaves one of two halves
as it is. A key says half of a word at least, so that a bigram which many words share makes no large group.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources.session import settle

LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Code points of a word at least; its occurrences at least; how much more frequent a form is than the word.
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
PREFIX = 3
PIVOTS = 2
#: Bigrams are ordered by the words that have one of their class; there are so many classes whatever the alphabet.
CLASSES = 1 << 16
#: Code points of words that are verified by Spark's edit distance.
SHORT = 64
#: Different words that a counting task holds before it passes them on.
HELD_WORDS = 1 << 17


def _gram_class(gram: str) -> int:
    return (ord(gram[0]) * 509 + ord(gram[1])) % CLASSES


def mutated(run: str, before: int) -> str:
    """``run`` without one code point, where 31 divides the crc32 that ``before`` starts and the run ends."""
    h = zlib.crc32(run.encode(), before)
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int, plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lowered = text.as_py().encode().lower().decode() if text.is_valid else ""  # of bytes only A-Z are lowered
                before = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(LETTERS.findall(lowered)).items():
                    if len(found) >= least_length:
                        word = mutated(found, before) if plant else found
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield passed_on()
        yield passed_on()

    return run


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, plant: bool = False) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, of at least ``least_length`` code points and ``least_count`` occurrences.

    With ``plant`` one code point goes from some runs, as ``mutated`` says of ``doc_id``; a null id counts as an empty one. Null and
    empty texts have no words, repeated rows count each, columns beside ``doc_id`` and ``text`` are ignored, an empty table has no words.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_counted(least_length, plant), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def prefix_of(word: str, frequency: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """((weight, place) of the rarest bigrams, order of the third): three of them, then the third's own next places up to its fifth.

    A pivot is among the first three places of its bigram. An edit makes two new bigrams at most, so the same pivot is among the first five in
    the other word: a word that repeats one bigram needs no more of them.
    """
    order = []
    for place in range(len(word) - 1):
        gram = word[place : place + 2]
        kind = _gram_class(gram)
        order.append(((int(frequency[kind]), kind, gram), place))
    order.sort()
    last = order[PREFIX - 1][0]
    own = [place for key, place in order if key == last][: PREFIX + 2]
    return [(key[0], place) for key, place in order[:PREFIX]] + [(last[0], p) for p in own if p > order[PREFIX - 1][1]], last[0] * CLASSES + last[1]


def pivots_of(prefix: list[tuple[int, int]]) -> list[int]:
    """Places of the bigrams without a common letter whose weights add up to least; of equal sums the leftmost."""
    grams = sorted((place, weight) for weight, place in prefix)
    # best[k]: (sum, places) of k disjoint bigrams among those seen, by where the last one is
    best: list[list[tuple[int, list[int]]]] = [[(0, [])]] + [[] for _ in range(PIVOTS)]
    for place, weight in grams:
        for k in range(PIVOTS, 0, -1):
            ways = [(total + weight, [*places, place]) for total, places in best[k - 1] if not places or places[-1] + 2 <= place]
            if ways:
                best[k].append(min(ways))
    return min(best[PIVOTS])[1]


def keys_before(word: str, place: int, target: int) -> Iterator[str]:
    """What a word of ``target`` letters must share with ``word`` if they are one edit apart, and that is right of the bigram at ``place``."""
    head = word[: place + 2]
    rest, cut = target - len(head), (target - len(head)) // 2
    if rest <= len(head):
        yield f"{target} {len(head)} all {head}"
    else:
        yield f"{target} {len(head)} near {word[: len(head) + cut]}"
        yield f"{target} {len(head)} far {head} {word[max(len(head), len(word) - rest + cut) :]}"


def keys_after(word: str, place: int, target: int) -> Iterator[str]:
    """The same if the edit is left of the bigram."""
    tail = word[place:]
    rest, cut = target - len(tail), (target - len(tail)) // 2
    if rest <= len(tail):
        yield f"{target} {-len(tail)} all {tail}"
    else:
        yield f"{target} {-len(tail)} near {word[max(0, place - rest + cut) :]}"
        yield f"{target} {-len(tail)} far {word[: min(cut, place)]} {tail}"


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, n): words of a task that have a bigram of each class."""
    seen = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for word in batch.column("word").to_pylist():
            seen[list({_gram_class(a + b) for a, b in zip(word, word[1:], strict=False)})] += 1
    kinds = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(seen[kinds])], ["kind", "n"])


def one_edit(a: str, b: str) -> Column:
    """Whether exactly one inserted, deleted or replaced code point leads from column ``a`` to column ``b``.

    Spark's bounded edit distance takes the square of the length, so longer words are cut where they first differ, found by halving.
    """
    n, m = F.char_length(a), F.char_length(b)
    agree = F.expr(
        f"aggregate(sequence(30, 0), 0, (x, k) -> if(x + shiftleft(1, k) <= least(char_length({a}), char_length({b}))"
        f" and left({a}, x + shiftleft(1, k)) = left({b}, x + shiftleft(1, k)), x + shiftleft(1, k), x))"
    )
    rests = F.substring(a, agree + 1 + (n >= m).cast("int"), n) == F.substring(b, agree + 1 + (m >= n).cast("int"), m)
    return (F.abs(n - m) <= 1) & (F.col(a) != F.col(b)) & F.when(n <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(rests)


def _indexed(frequency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                out: list[tuple[bool, str, int, str, int]] = []
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                    prefix, last = prefix_of(word, frequency)
                    # an edit that is not left of the second pivot is right of the first
                    first, second = pivots_of(prefix[:PREFIX])
                    own = {key for size in (len(word) - 1, len(word), len(word) + 1) for key in (*keys_before(word, first, size), *keys_after(word, second, size))}
                    out += [(True, key, last, word, n) for key in sorted(own)]
                    own = {key for _, place in prefix for key in (*keys_before(word, place, len(word)), *keys_after(word, place, len(word)))}
                    out += [(False, key, last, word, n) for key in sorted(own)]
                columns = list(zip(*out, strict=True)) if out else [()] * 5
                kinds = (pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pivot", "key", "last", "word", "n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m): all pairs of ``words`` (word, n) that are exactly one edit apart, in both orders, with their counts.

    Words must differ and have four code points at least; ``n`` must not be null. A table without words gives no pairs.
    """
    frequency = np.zeros(CLASSES, np.int64)
    for row in words.select("word").mapInArrow(_gram_counts, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # CLASSES rows at most
        frequency[row.kind] = row.n
    index = words.mapInArrow(_indexed(frequency), "pivot boolean, key string, last long, word string, n long")
    index = settle(index.withColumn("key", F.xxhash64("key")), "gram-index")
    pivots = index.where("pivot").select("key", "last", "word", "n")
    prefixes = index.where("not pivot").select("key", F.col("last").alias("until"), F.col("word").alias("other"), F.col("n").alias("m"))
    pairs = pivots.join(prefixes, "key").where("last <= until").where(one_edit("word", "other")).select("word", "n", "other", "m")
    both = pairs.select(F.explode(F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))).alias("x"))
    return both.select("x.*").repartition("word").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    ``form`` is the near word of largest count (of equal counts the smallest in code-point order) if its count is ``ratio`` (2 or more) times the word's
    or more, else null; ``root`` is where the forms lead, the word itself if it has none. Every step multiplies the count, so the forms' chains are
    short and pointers doubled a few times reach their ends. A word has as many near words at most as one edit makes; no group is larger.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    words = settle(words, "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    out = settle(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), chosen["word"].alias("form"), (-chosen["m"]).alias("form_n")), "forms")
    least, most = out.agg(F.min("n"), F.max("n")).first()
    steps = math.floor(math.log(most / max(least, 1), ratio) + 1e-9) if most else 0
    led = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        led = settle(led, "roots")
        on = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = led.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
