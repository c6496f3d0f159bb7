"""Periodic runs of words: stretches that repeat a short root, with their exact bounds.

For the words of a text a suffix tree is built, and one for the words backwards. The tour through a tree turns between
each leaf and the next at their lowest common ancestor; the least depth among the turns between two leaves, found in constant
time from a table of ranges, is how far two suffixes agree. The longest Lyndon word that starts at each place, in the order of
words and in its opposite, is the only root a run can have there; it is extended both ways by two such questions.

Before that, words that can be in no run are set aside: in a run of at least ``exponent`` periods every three neighbouring
words come back so often that texts without such repeats need no tree. This loses no run.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import spare, text_slices

LEAST_WORDS = 6
EXPONENT = 4
#: Bytes of text whose words a task looks at together; a longer text is looked at alone.
SLICE_BYTES = 1 << 19


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers, with an end mark below all of them.

    ``children`` maps the first symbol of an edge to its node; a leaf's ``start`` is where its edge begins.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, -1]
        self.text = text
        children: list[dict[int, int] | None] = [{}]
        start, end, link = [0], [0], [0]
        last = len(text)
        node, edge, length, waiting = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            waiting += 1
            parent = 0  # an inner node made in this phase that still lacks its link
            while waiting:
                if not length:
                    edge = i
                below = children[node]
                child = below.get(text[edge])
                if child is None:
                    below[text[edge]] = len(start)
                    children.append(None)
                    start.append(i)
                    end.append(last)
                    link.append(0)
                    if parent:
                        link[parent] = node
                        parent = 0
                else:
                    first = start[child]
                    reach = min(end[child], i + 1) - first
                    if length >= reach:
                        edge, length, node = edge + reach, length - reach, child
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if parent:
                            link[parent] = node
                        break
                    inner = len(start)
                    below[text[edge]] = inner
                    children += ({text[first + length]: child, symbol: inner + 1}, None)
                    start += (first, i)
                    end += (first + length, last)
                    link += (0, 0)
                    start[child] = first + length
                    if parent:
                        link[parent] = inner
                    parent = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.children, self.start, self.end = children, start, end

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(place of each suffix among the leaves, depth of the turn before each leaf), in the order of symbols or its opposite."""
        children, start, end, n = self.children, self.start, self.end, len(self.text)
        place, turns = np.empty(n, np.int32), np.empty(n, np.int32)
        waiting, turn, seen = [(0, 0, -1)], 0, 0
        while waiting:
            node, above, turned = waiting.pop()
            if turned >= 0:
                turn = turned
            below = children[node]
            if below is None:
                place[start[node] - above] = seen
                turns[seen] = turn
                seen += 1
                continue
            depth = above + (end[node] - start[node] if node else 0)
            # the stack gives the last of these first; the end mark comes before all others in both orders
            nodes = [below[s] for s in sorted(below, key=lambda s: (s >= 0, -s))] if backwards else [below[s] for s in sorted(below)]
            waiting += [(x, depth, depth) for x in reversed(nodes[1:])]
            waiting.append((nodes[0], depth, -1))
        return place, turns


class Agreement:
    """How many symbols from two places on agree, for arrays of places, in constant time each."""

    def __init__(self, place: np.ndarray, turns: np.ndarray):
        self.place, self.tables = place, [turns]
        while 1 << len(self.tables) <= len(turns):
            at = self.tables[-1]
            half = 1 << len(self.tables) - 1
            self.tables.append(np.minimum(at[:-half], at[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            own = level == k
            table = self.tables[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def _next_smaller(place: np.ndarray) -> np.ndarray:
    """For each suffix the next one that is smaller; the longest Lyndon word of a place ends before it."""
    ranks = place.tolist()
    out, open_ = [0] * len(ranks), []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out[:-1], np.int64)


def runs_of(symbols: list[int], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` symbols and ``exponent`` (2 or more) periods, by start and period."""
    n = len(symbols)
    if n < least:
        return []
    tree = SuffixTree(symbols)
    place, turns = tree.tour()
    ahead, opposite = Agreement(place, turns), tree.tour(backwards=True)[0]
    del tree
    i = np.tile(np.arange(n), 2)
    p = np.concatenate([_next_smaller(place), _next_smaller(opposite)]) - i
    fits = p * exponent <= n
    i, p = i[fits], p[fits]
    length = p + ahead(i, i + p)
    back = Agreement(*SuffixTree(symbols[::-1]).tour())
    left = back(n - i, n - i - p)
    length = length + left
    kept = length >= np.maximum(least, exponent * p)
    return sorted(set(zip((i - left)[kept].tolist(), length[kept].tolist(), p[kept].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Spans of words outside which no run of four periods and six words has a word.

    Such a run has each of its triples of neighbours three times or more: with period 1 there are four equal ones at least, and
    with period q at least 4 q - 2 triples, of which every q-th are equal. Stretches of triples that come three times are cut again
    by the counts within them until nothing goes.
    """
    if len(codes) < 3:
        return []
    start = np.flatnonzero(owner[:-2] == owner[2:])
    many = int(codes.max()) + 1
    pairs = pd.factorize(codes[:-1] * many + codes[1:])[0].astype(np.int64)
    triples = pairs[start] * many + codes[start + 2]
    part = owner[start]
    while len(start):
        triples = pd.factorize(triples)[0].astype(np.int64)
        key = pd.factorize(triples * (int(part.max()) + 1) + part)[0]
        kept = np.bincount(key)[key] >= 3
        # four triples in a row at least make six words
        fresh = np.r_[True, (np.diff(start[kept]) != 1) | (np.diff(part[kept]) != 0)][: int(kept.sum())]
        parts = np.cumsum(fresh) - 1
        long = np.bincount(parts, minlength=1)[parts] >= 4
        changed = not (kept.all() and long.all())
        start, triples, part = start[kept][long], triples[kept][long], parts[long]
        if not changed:
            break
    if not len(start):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
    last = np.r_[first[1:], len(start)] - 1
    return list(zip(start[first].tolist(), (start[last] + 3).tolist(), strict=True))


def _of_texts(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of the words of each text."""
    size = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    flat = np.empty(len(owner), object)
    flat[:] = [w for words in texts for w in words]
    codes = pd.factorize(flat)[0].astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if least >= LEAST_WORDS and exponent >= EXPONENT:
        spans = _stretches(codes, owner)
    else:
        spans = [(int(e - n), int(e)) for e, n in zip(ends, size, strict=True)]
    for a, b in spans:
        found = runs_of(codes[a:b].tolist(), least, exponent)
        if found:
            text = int(owner[a])
            shift = a - int(ends[text] - size[text])
            out[text] += [(s + shift, n, p) for s, n, p in found]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _found(least: int, exponent: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.select([n for n in batch.schema.names if n != "text"])
            for first, offsets, data in text_slices(batch.column("text"), SLICE_BYTES):
                raw, cuts = data.tobytes(), offsets.tolist()
                words = [raw[a:b].split() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]  # bytes split at \x20 and \x09-\x0D alone
                found = _of_texts(words, least, exponent)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                kept = [b" ".join(collapsed(w, runs)).decode() for w, runs in zip(words, found, strict=True)]
                own = carried.slice(first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([len(w) for w in words], pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())], [*own.schema.names, "n_words", "runs", "collapsed"]
                )

    return run


def periodic_runs(docs: DataFrame, *carried: str, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """(carried columns, n_words, runs, collapsed) for every row of ``docs``; ``runs`` are its runs by start and period.

    Words are ``[^\\x20\\x09-\\x0D]+`` of ``text``. A run is a maximal stretch (start, length, period) of at least ``least`` words
    and ``exponent`` smallest periods; ``collapsed`` has the words, one blank between them, that no run has after its first period.
    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows get equal results, runs that
    overlap or share a start are all kept, other columns are ignored whatever their names, an empty table gives an empty table.
    A task holds one text of any length, or a slice of shorter ones; its trees take some 600 bytes for each word in stretches that repeat.
    """
    if least < 1 or exponent < 2:
        raise ValueError("a run has at least one word and two periods")
    taken = docs.select(*carried, "text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in taken.schema if f.name != "text")
    return taken.mapInArrow(_found(least, exponent), f"{fields}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with every text in ten made periodic from some word on, as the crc32 of the decimal ``doc_id`` says.

    With h that crc32, g = floor(h / 10) and n words, texts whose h ends in 0 get from word a = g % n on the words from a on again and again,
    1 + floor((n - a) / (3 + g % 8)) of them. Texts that change have their words joined by one blank; rows with a null id, and texts without words, stay.
    """
    h, w, a, p = spare(docs, "_h", "_w", "_a", "_p")
    g = F.floor(F.col(h) / 10)
    n = F.size(w).cast("long")
    repeats = docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    repeats = repeats.withColumn(w, F.when(F.col(h) % 10 == 0, words))
    repeats = repeats.withColumn(a, F.when(n > 0, g % n))
    repeats = repeats.withColumn(p, 1 + F.floor((n - F.col(a)) / (3 + g % 8)))
    changed = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))))
    return repeats.withColumn("text", F.when(F.col(a).isNotNull(), changed).otherwise(F.col("text"))).select(*docs.columns)
