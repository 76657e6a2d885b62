"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A text's features are its words, hashed to slots and weighted by their counts with length one;
statistics of its structure and its stated length, each as the quantile range it falls in. The
machine adds a weight per feature and, for each pair of features, the product of their
low-rank vectors. The sum over pairs is half of (square of the sum minus sum of the squares),
so a text is scored in time linear in its length; slices of texts are scored as matrix products.

The fit reads a bounded sample of labelled texts; scoring reads every whole text in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import LOWER, SPACED, find_words, text_slices

#: The fit reads at most so many labelled documents, the first in the order of a hash of the id.
SAMPLE_DOCUMENTS = 6000
SLOTS = 4096
BINS = 8
RANK = 8
EPOCHS = 30
BATCH = 64
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7
_ROWS = 256

_PUNCTUATION = np.frombuffer(b".,;:?", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def _member(listed: np.ndarray) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[listed] = True
    return flags


_KINDS = {
    "upper": _member(np.arange(65, 91)),
    "lower": _member(np.arange(97, 123)),
    "digit": _member(np.arange(48, 58)),
    "symbol": _member(_SYMBOLS),
    "bar": _member(np.array([124])),
    "exclamation": _member(np.array([33])),
    "punctuation": _member(_PUNCTUATION),
    "space": ~SPACED,
    "newline": _member(np.array([10])),
    "wide": np.arange(256) >= 128,
}
N_STATS = len(_KINDS) + 8


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds."""
    sums = np.zeros(len(bounds) - 1, np.int64)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        sums[filled] = np.add.reduceat(values, bounds[filled], dtype=np.int64)
    return sums


def text_features(
    data: np.ndarray, offsets: np.ndarray, stated: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(word weights, statistics) of texts, a row each; an empty text has no word weights."""
    rows = len(offsets) - 1
    found = find_words(LOWER[data], offsets, SPACED)
    owner = np.repeat(np.arange(rows), np.diff(found.first))
    slots = (found.hashes % np.uint64(SLOTS)).astype(np.int64)
    counts = np.bincount(owner * SLOTS + slots, minlength=rows * SLOTS).reshape(rows, SLOTS)
    n_words = np.diff(found.first)
    size = np.diff(offsets)
    stats = np.zeros((rows, N_STATS))
    per_byte = 1 / np.maximum(size, 1)
    for j, members in enumerate(_KINDS.values()):
        stats[:, j] = _sums(members[data], offsets) * per_byte
    lengths = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    word_bytes = lengths[found.first[1:]] - lengths[found.first[:-1]]
    closing = np.concatenate([[0], np.cumsum(_member(_PUNCTUATION)[data[found.ends - 1]])])
    per_word = 1 / np.maximum(n_words, 1)
    same = np.zeros(len(found.hashes))
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.concatenate([[0], np.cumsum(same)])
    known = np.where(np.isnan(stated), 0, stated)
    stats[:, len(_KINDS) :] = np.column_stack(
        [
            np.log1p(size),
            word_bytes * per_word,
            (counts > 0).sum(axis=1) * per_word,
            counts.max(axis=1, initial=0) * per_word,
            (closing[found.first[1:]] - closing[found.first[:-1]]) * per_word,
            (repeats[found.first[1:]] - repeats[found.first[:-1]]) * per_word,
            np.log1p(np.maximum(known, 0)),
            np.isnan(stated),
        ]
    )
    weights = np.sqrt(np.maximum((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True), 1))
    return (counts / weights).astype(np.float32), stats


@dataclass
class FactorisationMachine:
    """Weights of the fit; with ``edges`` None the score is ``share`` for every text."""

    share: float
    edges: np.ndarray | None = None
    bias: float = 0.0
    linear: np.ndarray | None = None
    vectors: np.ndarray | None = None

    def inputs(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        bins = np.zeros((len(stats), N_STATS * BINS), np.float32)
        for j in range(N_STATS):
            at = np.searchsorted(self.edges[j], stats[:, j], "right")
            bins[np.arange(len(stats)), j * BINS + at] = 1 / np.sqrt(N_STATS)
        return np.concatenate([words, bins], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = x @ self.vectors
        squares = (x * x) @ (self.vectors * self.vectors)
        return self.bias + x @ self.linear + 0.5 * ((total * total) - squares).sum(axis=1)

    def scores(self, words: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if self.edges is None:
            return np.full(len(stats), self.share)
        return 1 / (1 + np.exp(-np.clip(self.margins(self.inputs(words, stats)).astype(np.float64), -35, 35)))


def fit_machine(words: np.ndarray, stats: np.ndarray, label: np.ndarray) -> FactorisationMachine:
    """Logistic loss, by AdaGrad over shuffled batches; the same rows give the same machine."""
    machine = FactorisationMachine(float(label.mean()) if len(label) else 0.5)
    if len(set(label.tolist())) < 2:
        return machine
    machine.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    random = np.random.default_rng(7)
    n = SLOTS + N_STATS * BINS
    machine.bias = float(np.log(machine.share / (1 - machine.share)))
    machine.linear = np.zeros(n, np.float32)
    machine.vectors = random.normal(0, 0.05, (n, RANK)).astype(np.float32)
    seen = [1e-6, np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32)]
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            x = machine.inputs(words[rows], stats[rows])
            slope = (1 / (1 + np.exp(-np.clip(machine.margins(x), -35, 35))) - label[rows]).astype(np.float32)
            slope /= len(rows)
            total = x @ machine.vectors
            steps = [
                float(slope.sum()),
                x.T @ slope + DECAY * machine.linear,
                x.T @ (slope[:, None] * total)
                - machine.vectors * ((x * x).T @ slope)[:, None]
                + DECAY * machine.vectors,
            ]
            seen = [s + g * g for s, g in zip(seen, steps, strict=True)]
            machine.bias -= RATE * steps[0] / seen[0] ** 0.5
            machine.linear -= RATE * steps[1] / np.sqrt(seen[1])
            machine.vectors -= RATE * steps[2] / np.sqrt(seen[2])
    return machine


def _slices(batch: pa.RecordBatch, text: int, stated: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Features of a few hundred rows at a time."""
    lengths = batch.column(stated).to_numpy(zero_copy_only=False).astype(float)
    for a, b, data, offsets in text_slices(batch.column(text)):
        for low in range(a, b, _ROWS):
            high = min(b, low + _ROWS)
            bounds = offsets[low - a : high - a + 1]
            part = data[bounds[0] : bounds[-1]]
            words, stats = text_features(part, bounds - bounds[0], lengths[low:high])
            yield low, high, words, stats


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words, stats in _slices(batch, 2, 3):
            at, slot = np.nonzero(words)
            bounds = pa.array(np.searchsorted(at, np.arange(high - low + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    batch.column(1).slice(low, high - low),
                    pa.ListArray.from_arrays(bounds, pa.array(slot.astype(np.int16))),
                    pa.ListArray.from_arrays(bounds, pa.array(words[at, slot])),
                    pa.array([s.tobytes() for s in stats], pa.binary()),
                ],
                ["doc_id", "quality", "slots", "weights", "stats"],
            )


def learned_from(doc_id: Column) -> Column:
    """Rows whose labels may be learned; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> FactorisationMachine:
    """Fit to labelled documents that are not held out, at most ``sample`` of them.

    Of repeated labels of a document the lowest counts, of its repeated texts the first in
    order. Without labels of both kinds the machine scores every text by the share of label 1, or
    by a half if there are no labels.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & learned_from(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("n_chars").cast("double").alias("n_chars")).alias("d"),
        )
        .join(F.broadcast(chosen), "doc_id")  # ``sample`` rows of two numbers
        .groupBy("doc_id", "quality")
        .agg(F.min("d").alias("d"))
        .select("doc_id", "quality", "d.text", "d.n_chars")
        .mapInArrow(
            _sampled,
            "doc_id long, quality int, slots array<short>, weights array<float>, stats binary",
        )
        .toArrow()
        .sort_by("doc_id")
    )
    words = np.zeros((len(rows), SLOTS), np.float32)
    for i, (slots, weights) in enumerate(zip(rows["slots"], rows["weights"], strict=True)):
        words[i, slots.values.to_numpy()] = weights.values.to_numpy()
    stats = np.frombuffer(b"".join(rows["stats"].to_pylist()), np.float64).reshape(-1, N_STATS)
    return fit_machine(words, stats, rows["quality"].to_numpy().astype(np.float32))


def _scored(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for low, high, words, stats in _slices(batch, batch.num_columns - 2, batch.num_columns - 1):
                scores[low:high] = machine.value.scores(words, stats)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(scores)], [*batch.schema.names[:-2], "score"]
            )

    return run


def score_quality(
    docs: DataFrame, machine: FactorisationMachine, keep: list[str], score: str = "score"
) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and ``score``, from ``text`` and ``n_chars``.

    A score of 0 to 1 is higher where label 1 is likelier. Null and empty texts are scored as
    texts without words; a null n_chars is a feature of its own. Repeated rows score alike.
    Columns of ``docs`` that are called score, or like the inputs, do no harm.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
        F.col("text").cast("string").alias("t"),
        F.col("n_chars").cast("double").alias("n"),
    )
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return rows.mapInArrow(_scored(held), f"{schema}, score double").toDF(*keep, score)


@query("op3_quality_classifier")
def _op3(spark, folder):
    docs = table(spark, folder, "documents")
    machine = fit_quality(docs, table(spark, folder, "labels"))
    return score_quality(docs, machine, ["doc_id"]).select(
        "doc_id",
        F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
