"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

The model predicts the symbol of each token from the symbols of the four tokens before it: frequent words are
symbols of their own, the others share one per class of first letters. Within a class words have their
smoothed share of the corpus counts, so the probabilities of all words add up to one. Every task trains a copy on
its own part of the text in numpy, the copies are averaged by tokens. Scores come from batched matrix products over all symbols.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Words, id_part, lower_ascii, not_space, text_slices
from tickloom.sources.session import settle

#: Words that are symbols, classes of the others, tokens of context, length of the vectors.
OWN_SYMBOLS = 384
CLASSES = 128
CONTEXT = 4
WIDTH = 24
#: Words whose counts go along with the scoring tasks; all others are looked up by a join.
CARRIED = 1 << 17
#: Noise words per batch, tokens per batch, step size.
NOISE = 64
BATCH = 1024
RATE = 0.1
#: Share of the training texts of the first round, from whose average the second round starts on all of them.
WARM_UP = 0.1
#: Tokens that are scored together, and scores whose exponentials, summed over all symbols, fit a float.
SCORED = 1024
EXP_RANGE = 75.0
END = 0
_SYMBOLS = 1 + OWN_SYMBOLS + CLASSES
_PAD = _SYMBOLS


@dataclass
class Counts:
    """Corpus counts: a table of all words, and what tasks carry of it."""

    table: DataFrame
    tokens: int
    distinct: int
    ends: int
    words: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray


def _hashed(offsets: np.ndarray, data: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a slice, their hashes, and the classes of their first letters."""
    words = Words(offsets, data, not_space(), lower_ascii())
    first = words.hashes(np.minimum(words.end, words.start + 2))
    return words, words.hashes(), (first % np.uint64(CLASSES)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, classes = [], []
        for _, offsets, data in text_slices(batch.column("text")):
            _, h, c = _hashed(offsets, data)
            hashes.append(h)
            classes.append(c)
        if hashes:
            h, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(classes)[at].astype(np.int32)), pa.array(n)], ["word", "class", "n"])


def count_words(docs: DataFrame) -> Counts:
    """Count all words of ``docs``; a word is known by a 64-bit hash of its bytes."""
    counted = docs.select("text").mapInArrow(_counted, "word long, class int, n long")
    table = settle(counted.groupBy("word", "class").agg(F.sum("n").alias("n")), "word-counts")
    ends = docs.count()
    per_class = {r[0]: (r[1], r[2]) for r in table.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect()}
    # the counts at which the most frequent words begin come from a histogram of some hundred steps
    step = F.floor(F.log2("n") * 16)
    steps = sorted(table.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    total, least = 0, None
    for s, k in steps:
        if total + k > CARRIED:
            break
        total, least = total + k, s
    frequent = table.where(step >= least).collect() if least is not None else []  # CARRIED rows at most
    frequent = sorted(frequent, key=lambda r: (-r["n"], r["word"]))
    own = frequent[:OWN_SYMBOLS]
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (n, k) in per_class.items():
        class_tokens[c], class_words[c] = n, k
    for r in own:
        class_tokens[r["class"]] -= r["n"]
        class_words[r["class"]] -= 1
    words = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(words)
    symbol = np.zeros(len(frequent), np.int64)
    symbol[: len(own)] = np.arange(1, len(own) + 1)
    return Counts(
        table,
        int(sum(n for n, _ in per_class.values())) + ends,
        int(sum(k for _, k in per_class.values())) + (ends > 0),
        ends,
        words[order],
        np.array([r["n"] for r in frequent], np.int64)[order],
        symbol[order],
        class_tokens,
        class_words,
    )


class Tokens:
    """The tokens of a slice in order, an end after each text: symbols, and which words need a look-up."""

    def __init__(self, counts: Counts, offsets: np.ndarray, data: np.ndarray):
        words, self.hashes, classes = _hashed(offsets, data)
        place = np.minimum(np.searchsorted(counts.words, self.hashes), max(len(counts.words) - 1, 0))
        self.carried = counts.words[place] == self.hashes if len(counts.words) else np.zeros(len(place), bool)
        own = counts.own[place] if len(counts.words) else place
        self.n = np.where(self.carried, counts.counts[place] if len(counts.words) else 0, 0)
        self.classes = np.where(self.carried & (own > 0), -1, classes)
        symbol = np.where(self.classes < 0, own, 1 + OWN_SYMBOLS + classes)
        self.text, self.count = words.text, words.count
        self.at = np.arange(len(symbol)) + words.text  # an end stands before every later text
        self.first = np.cumsum(words.count + 1) - words.count - 1
        self.symbols = np.full(len(symbol) + len(self.count), END, np.int64)
        self.symbols[self.at] = symbol

    def contexts(self) -> list[np.ndarray]:
        """Symbols one to CONTEXT places before each token, in the same text."""
        within = np.arange(len(self.symbols)) - np.repeat(self.first, self.count + 1)
        out = []
        for i in range(1, CONTEXT + 1):
            before = np.full(len(self.symbols), _PAD, np.int64)
            before[i:] = self.symbols[:-i] if i < len(self.symbols) else before[i:]
            out.append(np.where(within >= i, before, _PAD))
        return out


def symbol_shares(counts: Counts) -> np.ndarray:
    """Share of each symbol among all tokens, smoothed."""
    n = np.full(_SYMBOLS, 0.5)
    n[END] += counts.ends
    n[counts.own[counts.own > 0]] += counts.counts[counts.own > 0]
    n[1 + OWN_SYMBOLS :] += np.maximum(counts.class_tokens, 0)
    return n / n.sum()


def initial(counts: Counts) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    return {
        "read": rng.normal(0, 0.3, (_SYMBOLS + 1, WIDTH)).astype(np.float32),
        "mix": np.stack([np.eye(WIDTH, dtype=np.float32) / CONTEXT] * CONTEXT),
        "write": rng.normal(0, 0.1, (_SYMBOLS, WIDTH)).astype(np.float32),
        "bias": np.log(symbol_shares(counts)).astype(np.float32),
    }


def _gather(values: np.ndarray, picked: np.ndarray, rows: np.ndarray, into: int) -> np.ndarray:
    """Sums of ``values[picked]`` by row number."""
    order = np.argsort(rows.astype(np.int16), kind="stable")  # two bytes are sorted by counting
    at = rows.take(order)
    starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    out = np.zeros((into, *values.shape[1:]), np.float32)
    out[at.take(starts)] = np.add.reduceat(values.take(picked.take(order), axis=0), starts, axis=0)
    return out


def _step(p: dict, seen: dict, context: np.ndarray, target: np.ndarray, noise: np.ndarray, log_kp: np.ndarray) -> None:
    """One step of noise-contrastive estimation; all tokens of the batch share the noise words.

    ``context`` has a row per place. Vectors are mixed once per symbol and place, and the gradients of both tables come from the sums per symbol and place.
    """
    size, symbols = len(target), _SYMBOLS + 1
    rows = (context + np.arange(CONTEXT)[:, None] * symbols).ravel()
    mixed = np.matmul(p["read"], p["mix"]).reshape(CONTEXT * symbols, WIDTH)
    q = mixed.take(rows, axis=0).reshape(CONTEXT, size, WIDTH).sum(axis=0)
    write, written = p["write"].take(target, axis=0), p["write"].take(noise, axis=0)
    real = np.einsum("bd,bd->b", q, write) + (p["bias"] - log_kp).take(target)
    false = q @ written.T + (p["bias"] - log_kp).take(noise)
    dreal = 1 / (1 + np.exp(-real)) - 1
    np.exp(np.negative(false, out=false), out=false)
    dfalse = np.reciprocal(np.add(false, 1, out=false), out=false)
    dq = dreal[:, None] * write + dfalse @ written
    by_place = _gather(dq, np.tile(np.arange(size), CONTEXT), rows, CONTEXT * symbols).reshape(CONTEXT, symbols, WIDTH)
    grads = {
        "write": _gather(dreal[:, None] * q, np.arange(size), target, _SYMBOLS) + _gather(dfalse.T @ q, np.arange(len(noise)), noise, _SYMBOLS),
        "bias": (np.bincount(target, dreal, _SYMBOLS) + np.bincount(noise, dfalse.sum(0), _SYMBOLS)).astype(np.float32),
        "mix": np.matmul(p["read"].T, by_place),
        "read": np.matmul(by_place, p["mix"].transpose(0, 2, 1)).sum(axis=0),
    }
    for k, g in grads.items():
        seen[k] += g * g
        p[k] -= RATE * g / (np.sqrt(seen[k]) + 1e-3)


def _trained(counts: Counts, start: dict[str, np.ndarray]):
    """Rows (at, value, tokens): the parameters that a task ends with, each times its tokens."""
    light = _without_table(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in start.items()}
        seen = {k: np.full(v.shape, 0.1, np.float32) for k, v in start.items()}
        rng, done = np.random.default_rng(11), 0
        share = symbol_shares(light)
        log_kp = np.log(NOISE * share).astype(np.float32)
        upto = np.cumsum(share)
        for batch in batches:
            for _, offsets, data in text_slices(batch.column("text")):
                tokens = Tokens(light, offsets, data)
                context, order = np.stack(tokens.contexts()), rng.permutation(len(tokens.symbols))
                for i in range(0, len(order), BATCH):
                    part = order[i : i + BATCH]
                    noise = np.minimum(np.searchsorted(upto, rng.random(NOISE), "right"), _SYMBOLS - 1)
                    _step(p, seen, context.take(part, axis=1), tokens.symbols.take(part), noise, log_kp)
                done += len(order)
        if done:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * done), pa.array(np.full(len(flat), done, np.int64))], ["at", "value", "tokens"])

    return run


def _without_table(counts: Counts) -> Counts:
    return Counts(None, *[getattr(counts, k) for k in list(Counts.__dataclass_fields__)[1:]])


def train(docs: DataFrame, counts: Counts) -> dict[str, np.ndarray]:
    """Parameters after two rounds, the second over all texts; each round averages the copies of all tasks.

    The result depends on how the texts are cut into tasks, as any training in parts does; without texts it is the start.
    """
    p = initial(counts)
    for part in (docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1000)) < WARM_UP * 1000), docs):
        sums = part.select("text").mapInArrow(_trained(counts, p), "at int, value double, tokens long").groupBy("at").agg((F.sum("value") / F.sum("tokens")).alias("mean"))
        found = sorted(sums.collect())  # one row per parameter
        if found:
            flat, at = np.array([m for _, m in found], np.float32), 0
            for k in sorted(p):
                p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
                at += p[k].size
    return p


def log_softmax_at(p: dict, context: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Normalised natural log probability of each target symbol after its context."""
    out = np.empty(len(target))
    mixed = np.matmul(p["read"], p["mix"]).reshape(-1, WIDTH)
    weights = np.vstack([p["write"].T, p["bias"]])
    steepest, highest = np.linalg.norm(p["write"], axis=1).max(), np.abs(p["bias"]).max()
    rows = np.stack(context) + np.arange(CONTEXT)[:, None] * len(p["read"])
    most = min(SCORED, len(target))
    vectors, scores, ones = np.ones((most, WIDTH + 1), np.float32), np.empty((most, _SYMBOLS), np.float32), np.ones(_SYMBOLS, np.float32)
    for i in range(0, len(target), SCORED):
        to = target[i : i + SCORED]
        q, s = vectors[: len(to)], scores[: len(to)]
        np.sum(mixed.take(rows[:, i : i + SCORED], axis=0), axis=0, out=q[:, :WIDTH])
        np.matmul(q, weights, out=s)
        # a bound on the scores tells whether their exponentials can leave the range of a float
        if np.sqrt(np.einsum("bd,bd->b", q[:, :WIDTH], q[:, :WIDTH]).max()) * steepest + highest > EXP_RANGE:
            s -= s.max(axis=1, keepdims=True)
        own = s[np.arange(len(to)), to].astype(np.float64)
        out[i : i + SCORED] = own - np.log(np.exp(s, out=s) @ ones)
    return out


def _scored(counts: Counts, p: dict[str, np.ndarray]):
    light = _without_table(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_norm = np.log10(light.tokens + 0.5 * (light.distinct + 1))
        class_norm = np.log10(light.class_tokens + 0.5 * light.class_words + 0.5)
        for batch in batches:
            n_tokens, base, score, known, tails, times = [], [], [], [], [], []
            for _, offsets, data in text_slices(batch.column("text")):
                t = Tokens(light, offsets, data)
                rows = len(t.count)
                of_all = np.repeat(np.arange(rows), t.count + 1)
                log_p = np.bincount(of_all, log_softmax_at(p, t.contexts(), t.symbols), rows) / np.log(10)
                in_class = t.classes >= 0
                log_p -= np.bincount(t.text[in_class], class_norm[t.classes[in_class]], rows)
                found = np.flatnonzero(t.carried)
                log_n = np.log10(t.n[found] + 0.5)
                log_p += np.bincount(t.text[found], log_n * in_class[found], rows)
                own = np.bincount(t.text[found], log_n, rows) + np.log10(light.ends + 0.5)
                n_tokens.append(t.count + 1)
                base.append(own - (t.count + 1) * base_norm)
                score.append(log_p)
                known.append(np.bincount(t.text[found], minlength=rows) + (light.ends > 0))
                rest = ~t.carried
                for words in np.split(t.hashes[rest], np.cumsum(np.bincount(t.text[rest], minlength=rows))[:-1]):
                    word, n = np.unique(words, return_counts=True)
                    tails.append(word.view(np.int64))
                    times.append(n.astype(np.int32))
            join = lambda x: np.concatenate(x) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "text"),
                    pa.array(join(n_tokens).astype(np.int64)),
                    pa.array(join(base).astype(np.float64)),
                    pa.array(join(score).astype(np.float64)),
                    pa.array(join(known).astype(np.int64)),
                    pa.array(tails, pa.list_(pa.int64())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                [*(c for c in batch.schema.names if c != "text"), "n_tokens", "base", "score", "known", "tail", "times"],
            )

    return run


def held_out(parts: int = 5, part: int = 1):
    return id_part(parts) == part


def score(docs: DataFrame, counts: Counts, p: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Tokens are the words between blanks, A-Z lower-cased, and one end; null texts count as empty and have the end alone.
    ``base_score`` is the smoothed unigram log10 probability, ``score`` that of the model. Words that tasks don't carry are looked up in
    the counts by a join, once per document and word. Repeated rows are scored each; with no training text
    all counts are zero. Other columns are ignored.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, n_tokens long, base double, score double, known long, tail array<long>, times array<int>"
    rows = settle(docs.select("doc_id", "text").mapInArrow(_scored(counts, p), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    looked = rare.join(counts.table.select("word", "n"), "word", "left")
    log_n = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    found = looked.groupBy("row").agg(F.sum(F.col("times") * log_n).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    joined = rows.select("row", "doc_id", "n_tokens", "base", "score", "known").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
