"""Toxicity by a classifier with a counterfactual penalty.

A logistic model over the words of a text and their beginnings is fitted on labelled texts. Every labelled
text that names groups of people is copied with the names swapped for others of the same set, and the model pays for any
change of its score between the two, so that naming a group does not count as toxic by itself.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Words, alphanumeric, id_part, lower_ascii, mixed, sparing, text_slices

THRESHOLD = 0.3
#: Bytes of text that a task looks at together; the features of a byte take some 50 bytes.
SLICE_BYTES = 1 << 18
#: Labelled rows that a model is fitted on at most: those with the least hash of their id.
SAMPLE_ROWS = 20_000
#: Features of a model at most; the least number and share of toxic texts that have one, and its least chi-square with the label.
FEATURES = 4_096
LEAST_TEXTS = 3
LEAST_SHARE = 0.003
LEAST_CHI2 = 20.0
#: Bytes of a word's beginnings that are features beside the word.
STEMS = (3, 4, 5, 6)
RIDGE = 0.5
SWAP_PENALTY = 4.0
STEPS = 400
SWAPS = 2
# Names of groups; each line is a set whose members replace each other.
GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("frauen", "maenner"),
    ("mujeres", "hombres"),
)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the score of a text without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words of some texts and of their beginnings; repeats are not yet taken out."""
    words = Words(offsets, data, alphanumeric(), lower_ascii())
    length = words.end - words.start
    texts, hashes = [words.text], [words.hashes()]
    for n in STEMS:
        longer = np.flatnonzero(length > n)
        part = words.hashes(np.minimum(words.end, words.start + n))[longer]
        texts.append(words.text[longer])
        hashes.append(mixed(part + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def _of_texts(texts: list[str] | pa.Array) -> list[np.ndarray]:
    """Distinct feature hashes of each text."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    for first, offsets, data in text_slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), SLICE_BYTES):
        at, hashes = _features(offsets, data)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            out[first + i] = np.unique(hashes[order[cuts[i] : cuts[i + 1]]])
    return out


def group_features() -> np.ndarray:
    return np.unique(np.concatenate(_of_texts([name for names in GROUPS for name in names])))


def swapped(text: str, by: int) -> str | None:
    """``text`` in lower case with each group name replaced by the one ``by`` places on in its set; None if it has none."""
    place = {name: (names, i) for names in GROUPS for i, name in enumerate(names)}
    changed, out = False, []
    for word in text.lower().split():
        core = word.strip(".,;:!?\"'()")
        if core in place:
            names, i = place[core]
            other = names[(i + by) % len(names)]
            changed |= other != core
            word = word.replace(core, other, 1)
        out.append(word)
    return " ".join(out) if changed else None


def _counted(among: np.ndarray | None = None):
    """(feature, n): texts of a batch that have the feature; only of features ``among``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _of_texts(batch.column("text"))
            if among is not None:
                seen = [np.intersect1d(found, among, assume_unique=True) for found in seen]
            feature, n = np.unique(np.concatenate([np.empty(0, np.uint64), *seen]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(n)], ["feature", "n"])

    return run


def _reduced(chosen: np.ndarray):
    """Labelled texts as indices of chosen features, with those of their swapped copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def index(texts: list[str]) -> list[list[int]]:
            out = []
            for found in _of_texts(texts):
                at = np.minimum(np.searchsorted(chosen, found), len(chosen) - 1)
                out.append(at[chosen[at] == found].tolist())
            return out

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            own = index(texts)
            copies: list[list[list[int]]] = []
            for text in texts:
                other = [x for x in (swapped(text, by) for by in range(1, SWAPS + 1)) if x is not None]
                copies.append(index(other) if other else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(copies, pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "copies"]
            )

    return run


def _fit(labels: np.ndarray, own: list, copies: list, n: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + penalty for score changes, by Adam on all rows."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col = np.array([c for x in own for c in x], np.int64)
    # a swapped copy less its original: only the features in which they differ
    prow, pcol, sign, pairs = [], [], [], 0
    for mine, others in zip(own, copies, strict=True):
        for other in others:
            for c in set(other) ^ set(mine):
                prow.append(pairs)
                pcol.append(c)
                sign.append(1.0 if c in set(other) else -1.0)
            pairs += 1
    prow, pcol, sign = np.array(prow, np.int64), np.array(pcol, np.int64), np.array(sign)
    w = np.zeros(n + 1)
    w[n] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 10.0))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1 if len(labels) else 0):
        score = np.bincount(row, w[col], len(labels)) + w[n]
        error = 1 / (1 + np.exp(-score)) - labels
        grad = np.append(np.bincount(col, error[row], n) + RIDGE * w[:n], error.sum())
        if pairs:
            change = np.bincount(prow, sign * w[pcol], pairs)
            grad[:n] += 2 * SWAP_PENALTY * np.bincount(pcol, sign * change[prow], n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labels`` (doc_id, toxic) and their texts, on the ``sample_rows`` with the least hash of the id at most.

    Rows with a null label or id are left out; of several labels of an id the larger counts; a label is 0 or 1. Without any
    labelled text the model has no features and a low constant score. Features come from counts over the sample, and
    the driver gets only the chosen features and the sample's indices into them.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # sample_rows rows of two numbers
    totals = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, bad = totals[0], totals[1] or 0

    def counts(label: int, among: np.ndarray | None, least: float) -> dict[int, int]:
        found = rows.where(F.col("toxic") == label).select("text").mapInArrow(sparing(_counted(among)), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        return dict(map(tuple, found.where(F.col("n") >= least).collect()))

    # no text has many features, so few can be in LEAST_SHARE of the toxic texts, however many there are
    toxic = counts(1, None, max(LEAST_TEXTS, LEAST_SHARE * bad))
    feature = np.sort(np.array(list(toxic), np.int64).view(np.uint64))
    clean = counts(0, feature, 1)
    names = feature.view(np.int64).tolist()
    a, b = np.array([toxic[f] for f in names], float), np.array([clean.get(f, 0) for f in names], float)
    chi2 = n * (a * (n - bad) - b * bad) ** 2 / np.maximum(float(bad) * (n - bad) * (a + b) * (n - a - b), 1e-9)
    best = np.lexsort((feature, -chi2))[:FEATURES]
    chosen = np.unique(np.concatenate([feature[best[chi2[best] >= LEAST_CHI2]], group_features()]))
    kept = rows.mapInArrow(sparing(_reduced(chosen)), "toxic int, own array<int>, copies array<array<int>>").collect()  # sample_rows at most
    kept.sort(key=lambda r: (r[0], r[1]))  # so that sums don't depend on the order of tasks
    weights, bias = _fit(np.array([r[0] for r in kept], float), [r[1] for r in kept], [r[2] for r in kept], len(chosen))
    return Model(chosen, weights, bias)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(42)
        maybe = np.zeros(1 << 22, bool)
        maybe[model.features >> shift] = True
        for batch in batches:
            scores = np.full(batch.num_rows, model.bias)
            for first, offsets, data in text_slices(batch.column("text"), SLICE_BYTES):
                at, hashes = _features(offsets, data)
                near = np.flatnonzero(maybe[hashes >> shift])
                place = np.searchsorted(model.features, hashes[near])
                place = np.minimum(place, len(model.features) - 1)
                hit = model.features[place] == hashes[near]
                pairs = np.unique(at[near][hit] * len(model.features) + place[hit])
                text, feature = np.divmod(pairs, len(model.features))
                scores[first : first + len(offsets) - 1] += np.bincount(text, model.weights[feature], len(offsets) - 1)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(1 / (1 + np.exp(-scores)))], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """(doc_id, carried columns, score) of every whole text, a row for each row of ``docs``.

    Null and empty texts, and texts without any feature, get the model's constant. Repeated rows are scored each and equal texts
    score the same; columns that are not carried are ignored whatever their names; an empty table gives an empty table.
    """
    taken = docs.select("doc_id", *carried, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema if f.name != "text"]
    return taken.mapInArrow(sparing(_scored(model)), ", ".join([*fields, "score double"]))


def held_out(parts: int = 4, part: int = 2):
    """True for documents whose labels are never learned from."""
    return id_part(parts) == part


def not_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns unchanged.

    A score equal to ``threshold`` goes. Null and empty texts have the model's constant score, and repeated rows go or stay
    together. Only ``text`` is read, so other columns may have any names; an empty table gives an empty table.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scored(model)
        for batch in batches:
            values = next(scored(iter([batch.select(["text"])]))).column("score")
            yield batch.filter(pa.array(values.to_numpy() < threshold))

    return docs.mapInArrow(sparing(run), ", ".join(fields))
