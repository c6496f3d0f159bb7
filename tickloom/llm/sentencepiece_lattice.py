"""SentencePiece encoding and decoding by a relational lattice.

Words are exploded into substrings of bounded length, which meet the piece table in an equi-join; the pieces found
are the edges of the word's lattice, grouped by word, and the best path is found over the edges of many words at a time, by array operations. Texts are first cut wherever no piece has the two characters around the cut, so that words are short and recur.
Documents are dealt into blocks of some thousand and kept as word numbers. Each different word is solved once for the blocks of
a thousand tasks; its path goes to the blocks that have it, once to each, and the documents are put together there. A block is
bounded, so a frequent word loads no task.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import give_back, sparing, text_slices

SPACE = "▁"
#: A block ends when it has so many different words, or so many bytes of text.
BLOCK_WORDS = 1 << 19
BLOCK_BYTES = 1 << 25
#: Bits of a word's place: task, block of the task and number of the word.
TASK_BITS, SERIAL_BITS, CODE_BITS = 20, 17, 26
#: Bits of an edge: end (the rest), size and piece; unknown characters are negative pieces.
SIZE_BITS, ID_BITS = 10, 22
END_SHIFT, UNKNOWN_IDS = SIZE_BITS + ID_BITS, 1 << ID_BITS - 1
#: Bytes of text that are cut at once, rows that are looked at for them, words sent at once, and documents put together at once.
RUN_BYTES, RUN_ROWS, SENT_WORDS, CODED_ROWS = 1 << 20, 256, 1 << 16, 128
#: Tasks whose words share one solution of a word, as a power of two: bounds the places that go with it.
SHARING_BITS = 10
#: Tasks that solve words, per shuffle partition of the session.
SOLVING_TASKS = 8
#: Fixed values of the model format: kinds of pieces, and what an unknown character costs beyond the worst piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0


@dataclass
class Pieces:
    """The piece table of a model file."""

    text: list[str]
    score: list[float]
    kind: list[int]

    @property
    def longest(self) -> int:
        return max((len(t) for t, k in zip(self.text, self.kind, strict=True) if k in (NORMAL, USER_DEFINED)), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for s, k in zip(self.score, self.kind, strict=True) if k == NORMAL), default=0.0) - UNKNOWN_COST

    @property
    def unknown_id(self) -> int:
        return self.kind.index(UNKNOWN) if UNKNOWN in self.kind else 0

    def byte_ids(self) -> list[int] | None:
        """Ids of the 256 byte pieces; None if the model has none."""
        found = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        return [found[b] for b in range(256)] if len(found) == 256 else None


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, kind, data[at : at + size]
        at += size


def load_pieces(path: str) -> Pieces:
    """Read the pieces of a model file on the driver."""
    out = Pieces([], [], [])
    with open(path, "rb") as f:
        model = f.read()
    for field, _, value in _fields(model):
        if field != 1:
            continue
        piece = {k: v for k, _, v in _fields(value)}
        out.text.append(piece[1].decode())
        out.score.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
        out.kind.append(piece.get(3, NORMAL))
    return out


def word_pattern(pieces: Pieces) -> re.Pattern:
    """Cuts normalised text where no piece reaches across: before blanks that follow other characters, and round line ends."""
    usable = [t for t, k in zip(pieces.text, pieces.kind, strict=True) if k in (NORMAL, USER_DEFINED)]
    if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in usable):
        raise ValueError("the model has pieces that reach across words")
    if any("\n" in t for t in usable):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    return re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def inner_pairs(pieces: Pieces) -> frozenset[str]:
    """Pairs of neighbours inside pieces; no path has an edge across any other pair."""
    usable = [t for t, k in zip(pieces.text, pieces.kind, strict=True) if k in (NORMAL, USER_DEFINED)]
    return frozenset(t[i : i + 2] for t in usable for i in range(len(t) - 1))


def pack_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each number): seven bits a byte, lowest first, the top bit set on all but a number's last byte."""
    size = 1 + sum((x >> (7 * i) > 0).astype(np.int8) for i in range(1, 5))
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for i in range(int(size.max(initial=0))):
        has = size > i
        out[start[has] + i] = (x[has] >> (7 * i) & 0x7F).astype(np.uint8) | ((size[has] > i + 1).astype(np.uint8) << 7)
    return out, size


def unpack_numbers(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 0x80)
    start = np.r_[0, last[:-1] + 1][: len(last)]
    out = np.zeros(len(last), np.int64)
    for i in range(int((last - start).max(initial=-1)) + 1):
        has = last - start >= i
        out[has] |= (raw[start[has] + i].astype(np.int64) & 0x7F) << (7 * i)
    return out


def _bounds(sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets of lists that hold elements of such sizes and begin at element ``at``."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))[at].astype(np.int32)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and at which of them each row begins and the last ends."""
    if not len(column):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    where = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data if data is not None else b"", np.uint8)[where[0] : where[-1]]
    return unpack_numbers(raw), np.append(0, np.cumsum(raw < 0x80))[where - where[0]]


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes of their texts) of runs of rows with about ``most`` bytes each, however the rows are cut into batches."""
    rest: list[pa.RecordBatch] = []
    for batch in (whole.slice(i, RUN_ROWS) for whole in batches for i in range(0, whole.num_rows, RUN_ROWS)):
        batch = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0] if rest else batch
        rest = []
        for first, offsets, data in text_slices(batch.column("text"), most):
            rows = batch.slice(first, len(offsets) - 1)
            if first + rows.num_rows < batch.num_rows:
                yield rows, offsets, data
            else:  # the next batch may have more rows for it
                rest = [rows]
    for rows in rest:
        for _, offsets, data in text_slices(rows.column("text"), most):
            yield rows, offsets, data


def _cutter(pieces: Pieces):
    """Cuts texts into words: (dictionary-encoded words of all texts, number of words of each)."""
    word_pattern(pieces)  # its cuts are among those that no pair allows
    inside = inner_pairs(pieces)
    letters = {c: i for i, c in enumerate(sorted(set("".join(inside))), 1)}
    joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for x, y in inside:
        joined[letters[x], letters[y]] = True

    def ready():
        # made in the task, so that it doesn't travel with the function
        kinds = np.zeros(0x110000, np.int32)
        for c, i in letters.items():
            kinds[ord(c)] = i
        kinds[ord(" ")] = kinds[ord(SPACE)]

        def cut(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
            filled = offsets[:-1] < offsets[1:]
            at = offsets[:-1][filled]
            data = np.insert(data, at, ord(" "))
            kind = kinds[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
            new = np.ones(len(kind), bool)
            new[1:] = ~joined.ravel()[kind[:-1] * len(joined) + kind[1:]]
            del kind
            letter = np.flatnonzero((data & 0xC0) != 0x80)
            text = at + np.arange(len(at))
            new[np.searchsorted(letter, text)] = True
            start = letter[new]
            words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data))
            n = np.zeros(len(offsets) - 1, np.int64)
            n[filled] = np.diff(np.append(np.searchsorted(start, text), len(start)))
            return words.dictionary_encode(), n

        return cut

    return ready


def _dealt(pieces: Pieces, block_words: int, block_bytes: int, words: bool):
    """The words of each block (place, word), or its documents (block, ..., codes).

    Words are numbered by how often the block has them, so that most numbers are short; a place is the block and
    that number. Both runs cut blocks alike.
    """
    ready = _cutter(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, serial, size = ready(), TaskContext.get().partitionId(), 0, 0
        known, count = pa.array([], pa.large_string()), np.empty(0, np.int64)
        held: list[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]] = []  # rows of the block that still wait for its numbers

        def ended() -> Iterator[pa.RecordBatch]:
            block = task << SERIAL_BITS | serial
            if max(task >> TASK_BITS, serial >> SERIAL_BITS, len(known) >> CODE_BITS):
                raise ValueError("more tasks, blocks or words than a place can number")
            order = np.argsort(-count, kind="stable")
            if words:
                ranked = pc.replace_substring(known.take(pa.array(order)), " ", SPACE).cast(pa.string())
                place = pa.array((block << CODE_BITS) + np.arange(len(order)))
                for i in range(0, len(order), SENT_WORDS):
                    yield pa.RecordBatch.from_arrays([place[i : i + SENT_WORDS], ranked[i : i + SENT_WORDS]], ["place", "word"])
                return
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            for rows, digests, codes, n in held:
                packed, sizes = pack_numbers(rank[codes])
                ends = _bounds(sizes, np.append(0, np.cumsum(n)))
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), *rows.columns, binary, pa.array(digests, pa.string())], ["block", *rows.schema.names, "codes", "text_sha256"])

        # runs are short beside a block, and their words few
        for rows, offsets, data in _runs(batches, min(RUN_BYTES, block_bytes, 4 * block_words)):
            found, n = cut(offsets, data)
            number = pc.index_in(found.dictionary, value_set=known)
            new = number.is_null().to_numpy(zero_copy_only=False)
            number = number.fill_null(0).to_numpy().astype(np.int32)
            number[new] = len(known) + np.arange(int(new.sum()), dtype=np.int32)
            known = pa.concat_arrays([known, found.dictionary.filter(pa.array(new))])
            codes = number[found.indices.to_numpy()]
            count = np.append(count, np.zeros(len(known) - len(count), np.int64))
            count[number] += np.bincount(found.indices.to_numpy(), minlength=len(number))
            if not words:
                digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                held.append((rows.select([c for c in rows.schema.names if c != "text"]), digests, codes, n))
            size += len(data)
            if len(known) >= block_words or size >= block_bytes:
                yield from ended()
                known, count, held, serial, size = pa.array([], pa.large_string()), np.empty(0, np.int64), [], serial + 1, 0
        if held or len(known):
            yield from ended()

    return run


def _best_paths(pieces: Pieces):
    """Best path through each list of edges, many words at a time: all their edges that end after one character, after two and so on."""
    scores = np.append(np.array(pieces.score, np.float64), pieces.unknown_score)

    def run(edges: pa.Array) -> pa.Array:
        edges = edges.combine_chunks() if isinstance(edges, pa.ChunkedArray) else edges
        count = np.diff(edges.offsets.to_numpy()).astype(np.int64)
        edge, word = edges.flatten().to_numpy(), np.repeat(np.arange(len(count)), count)
        order = np.lexsort((edge, word, edge >> END_SHIFT))  # by end, word, size, id
        edge, word = edge[order], word[order]
        end, size, ids = edge >> END_SHIFT, edge >> ID_BITS & (1 << SIZE_BITS) - 1, (edge & (1 << ID_BITS) - 1) - UNKNOWN_IDS
        score = scores[np.where(ids < 0, len(scores) - 1, ids)]
        length = np.zeros(len(count), np.int64)
        length[word] = end  # the last of a word's edges has its largest end
        start = np.cumsum(length + 1) - length - 1
        node = start[word] + end
        best, back = np.zeros(int((length + 1).sum())), np.zeros(int((length + 1).sum()), np.int64)
        head = np.flatnonzero(np.diff(node, prepend=-1))  # the first edge into each node
        bounds = np.searchsorted(end[head], np.arange(1, int(length.max(initial=0)) + 2))
        last = np.append(head, len(edge))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            x, y = last[a], last[b]
            ways, heads = best[node[x:y] - size[x:y]] + score[x:y], head[a:b] - x
            most = np.maximum.reduceat(ways, heads)
            first = np.where(ways == np.repeat(most, np.diff(last[a : b + 1])), np.arange(x, y), len(edge))
            best[node[head[a:b]]] = most
            back[node[head[a:b]]] = np.minimum.reduceat(first, heads)
        at, which, steps = length.copy(), np.arange(len(count)), []
        which = which[at > 0]
        while len(which):
            taken = back[start[which] + at[which]]
            steps.append((which, ids[taken]))
            at[which] -= size[taken]
            which = which[at[which] > 0]
        n = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(count)) if steps else np.zeros(len(count), np.int64)
        ends = np.cumsum(n)
        out = np.empty(int(n.sum()), np.int64)
        for i, (w, x) in enumerate(steps):
            out[ends[w] - 1 - i] = x
        packed, sizes = pack_numbers(np.where(out < 0, -2 * out - 1, 2 * out))
        return pa.BinaryArray.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(_bounds(sizes, np.append(0, ends))), pa.py_buffer(packed)])

    def spared(edges: pa.Array) -> pa.Array:
        paths = run(edges)
        give_back()
        return paths

    return spared


def solve_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(places, path) of rows (word, place, places): the best path of each ``word``, its piece ids as packed numbers, unknown characters as -1 - code point.

    A path's score is the sum of its pieces' scores; of equal scores the shorter last piece wins, then the smaller id.
    ``place`` tells the rows apart. Packed numbers are doubled, and odd for negative ones.
    """
    spark = words.sparkSession
    longest = pieces.longest
    if longest >> SIZE_BITS or len(pieces.text) > UNKNOWN_IDS:
        raise ValueError("the model has longer or more pieces than an edge can hold")
    usable = [(t, i) for i, (t, k) in enumerate(zip(pieces.text, pieces.kind, strict=True)) if k in (NORMAL, USER_DEFINED)]
    table = spark.createDataFrame(usable, "sub string, id int")
    start_at = F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.lit(longest)))).alias("start", "ahead")
    key = ["word", "place"]
    starts = words.where("word <> ''").select(*key, "places", start_at)
    sized = starts.select(*key, "places", "start", "ahead", F.explode(F.sequence(F.lit(1), F.char_length("ahead"))).alias("size"))
    subs = sized.select(*key, "places", "start", "size", F.substring("ahead", F.lit(1), F.col("size")).alias("sub"))
    # the table is the model's vocabulary, some ten thousand rows whatever the data
    edges = subs.join(F.broadcast(table), "sub", "left").where("id is not null or size = 1")
    # an edge is one number: its end, size and piece
    end, piece = (F.col("start") + F.col("size")).cast("long"), F.coalesce("id", -1 - F.ascii("sub")) + F.lit(UNKNOWN_IDS)
    # the places go with a word's first edge only
    first = F.when((F.col("start") == 0) & (F.col("size") == 1), F.col("places")).alias("places")
    edges = edges.select(*key, first, (F.shiftleft(end, END_SHIFT) + F.shiftleft(F.col("size").cast("long"), ID_BITS) + piece).alias("edge"))
    lattice = edges.groupBy(*key).agg(F.first("places", ignorenulls=True).alias("places"), F.collect_list("edge").alias("edges"))
    return lattice.select("places", F.arrow_udf(_best_paths(pieces), "binary")("edges").alias("path"))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the elements of many spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _assembled(pieces: Pieces, carried: list[str]):
    """Piece ids of the documents of one block from the paths of its words."""
    byte_ids, unknown = pieces.byte_ids(), pieces.unknown_id
    names = [*carried, "text_sha256", "ids"]

    def spelled(i: int) -> list[int]:
        return [byte_ids[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")] if byte_ids else [unknown]

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        ids, begins = _unpacked(words.sort_by("place").column("path").combine_chunks())
        ids, sizes = np.where(ids & 1, -(ids + 1 >> 1), ids >> 1), np.diff(begins)
        if (ids < 0).any():
            each = {int(i): spelled(int(i)) for i in np.unique(ids[ids < 0])}
            more = np.ones(len(ids), np.int64)
            more[ids < 0] = [len(each[i]) for i in ids[ids < 0].tolist()]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            out = np.repeat(ids, more)
            out[np.repeat(ids < 0, more)] = [b for i in ids[ids < 0].tolist() for b in each[i]]
            ids, sizes = out, np.bincount(owner, more, len(sizes)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        out = []
        docs = docs.combine_chunks()
        for batch in docs.to_batches(CODED_ROWS):
            at, n = _unpacked(batch.column("codes"))
            ends = _bounds(sizes[at], n)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[_spans(starts[at], sizes[at])].astype(np.int32)))
            out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), batch.column("text_sha256"), lists], names))
        return pa.Table.from_batches(out, pa.schema([*(docs.schema.field(c) for c in carried), pa.field("text_sha256", pa.string()), pa.field("ids", pa.list_(pa.int32()))]))

    def spared(docs: pa.Table, words: pa.Table) -> pa.Table:
        coded = run(docs, words)
        give_back()
        return coded

    return spared


def encode(docs: DataFrame, pieces: Pieces, block_words: int = BLOCK_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``ids`` (piece ids) and ``text_sha256`` in place of ``text``, a row for each row.

    The text is normalised as the model family does: a blank in front, blanks as U+2581, nothing else changed.
    The result is the best path by the pieces' scores; characters without a piece are spelled in byte pieces where the
    model has them, and are the unknown piece otherwise. Null and empty texts have no ids. Repeated rows are encoded each,
    other columns pass unchanged but for ones named block, codes, text_sha256 or ids, an empty table gives an empty table.
    """
    docs = docs.drop("block", "codes", "text_sha256", "ids")
    carried = [c for c in docs.columns if c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    # both runs read the same rows in the same order, so a lost task cuts its blocks as before
    words = docs.select("text").mapInArrow(sparing(_dealt(pieces, block_words, block_bytes, True)), "place long, word string")
    coded = docs.mapInArrow(sparing(_dealt(pieces, block_words, block_bytes, False)), f"block long, {fields}codes binary, text_sha256 string")
    # a word makes some twenty edges: many tasks, so that each sorts its edges in memory; lattices stay where their words are
    tasks = SOLVING_TASKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharing = F.shiftright("place", SERIAL_BITS + CODE_BITS + SHARING_BITS)
    each = words.repartition(tasks, "word").groupBy("word", sharing.alias("sharing")).agg(F.collect_list("place").alias("places"))
    solved = solve_words(each.select("word", F.col("places")[0].alias("place"), "places"), pieces)
    paths = solved.select(F.explode("places").alias("place"), "path").select(F.shiftright("place", CODE_BITS).alias("block"), "place", "path")
    return coded.groupBy("block").cogroup(paths.groupBy("block")).applyInArrow(_assembled(pieces, carried), f"{fields}text_sha256 string, ids array<int>")


def decode_ids(ids: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> bytes:
    """Bytes of a list of pieces, without the blank in front; ``data`` holds the pieces' bytes one after another."""
    ends = np.cumsum(sizes)
    text = data[_spans((ends - sizes)[ids], sizes[ids])].tobytes().replace(SPACE.encode(), b" ")
    return text[1:] if text[:1] == b" " else text


def _decoded(pieces: Pieces):
    raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.encode() for t, k in zip(pieces.text, pieces.kind, strict=True)]
    sizes, data = np.array([len(r) for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few rows at a time: a batch's texts as strings would be most of a worker's memory
        for batch in (whole.slice(i, CODED_ROWS) for whole in batches for i in range(0, whole.num_rows, CODED_ROWS)):
            ids = batch.column("ids")
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            texts = [decode_ids(flat[a:b], sizes, data).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with the ``text`` that its ``ids`` spell.

    Control pieces are nothing, the unknown piece is U+2047 between blanks, bytes that aren't UTF-8 become U+FFFD. Null ids give an
    empty text. It undoes ``encode`` but for U+2581 in the text, which comes back as a blank, and characters a model without
    byte pieces doesn't know.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(sparing(_decoded(pieces)), f"{fields}, text string")


def default_model() -> str:
    """Path of the piece model that this machine offers."""
    return "/opt/tokenizers/piece_bpe_32k.model"


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip): every text encoded and decoded again; digests of the comma-joined ids and of the text."""
    pieces = load_pieces(path or default_model())
    both = decode(encode(docs.select("doc_id", "text"), pieces), pieces)
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        decoded.alias("decoded_sha256"),
        (decoded == F.col("text_sha256")).alias("round_trip"),
    )
