"""Language identification by string kernels.

The kernel of two texts counts the distinct character n-grams, n from 1 to 3, that both have, over
the square root of the product of the numbers that each has (a blended spectrum of presences).
Nystroem's method maps texts to as many numbers as there are landmark texts, and one ridge
regression per language is fitted to them. The map and the regressions fold into one matrix,
so scoring is two matrix products for a slice of texts.

Characters are code points. A long text is scored in blocks of equal length, whose outputs are
averaged: presences of a whole long text would fill up and say little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import LOWER, mix, text_slices
from ledgerloom.session import stage

#: The fit reads about so many texts of each language, and fewer of each the more languages there
#: are, so that they are about SAMPLE_TEXTS in all.
SAMPLE_PER_LANGUAGE = 800
SAMPLE_TEXTS = 8192
#: Code points of a block, of which longer texts have several.
BLOCK_POINTS = 2048
LANDMARKS_PER_LANGUAGE = 40
MOST_LANDMARKS = 512
SLOTS = 4096
RIDGE = 0.05
_ROWS = 256
#: Languages whose counts are small enough to broadcast.
_FEW_LANGUAGES = 1 << 16
UNDETERMINED = "und"


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, A-Z lower-cased, and the offsets of the texts in them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = LOWER[data[lead]]
    point = first.astype(np.uint32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        point[size == n] &= mask
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        point[more] = (point[more] << np.uint32(6)) | (data[lead[more] + k] & 0x3F)
    return point, np.searchsorted(lead, offsets)


def presences(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones: hashed n-grams of the code points of each block."""
    rows = len(offsets) - 1
    there = np.zeros(rows * SLOTS, np.float32)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    left = offsets[1:][owner] - np.arange(offsets[0], offsets[-1])
    code = points[offsets[0] : offsets[-1]].astype(np.uint64)
    gram = code
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] << np.uint64(21)) | code[n - 1 :]
        fits = left[: len(gram)] >= n
        slot = mix(gram[fits] ^ np.uint64(n << 62)) % np.uint64(SLOTS)
        there[owner[: len(gram)][fits] * SLOTS + slot.astype(np.int64)] = 1
    return there.reshape(rows, SLOTS)


def _unit(there: np.ndarray) -> np.ndarray:
    """Rows whose products are kernel values."""
    return there / np.sqrt(np.maximum(there.sum(axis=1, keepdims=True), 1))


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # unit rows
    weights: np.ndarray  # landmarks by languages

    def outputs(self, there: np.ndarray) -> np.ndarray:
        return _unit(there) @ self.landmarks.T @ self.weights


def fit_model(there: np.ndarray, languages: list[str]) -> LanguageModel:
    """Landmarks from every language in turn; one regression per language against the rest."""
    names = sorted(set(languages))
    known = np.array([names.index(x) for x in languages])
    rows = _unit(there)
    each = min(LANDMARKS_PER_LANGUAGE, max(1, MOST_LANDMARKS // max(1, len(names))))
    chosen = [np.flatnonzero(known == j)[:each] for j in range(len(names))]
    landmarks = rows[np.concatenate(chosen)] if names else np.zeros((0, SLOTS), np.float32)
    among = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among) if names else (np.zeros(0), np.zeros((0, 0)))
    root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)
    mapped = rows @ (landmarks.T @ root) if names else np.zeros((0, 0))
    wanted = np.where(known[:, None] == np.arange(len(names)), 1.0, -1.0) if names else mapped
    # Rows of a language weigh as much as those of any other.
    weight = 1 / np.bincount(known, minlength=len(names))[known][:, None] if names else 1
    inner = mapped.T @ (mapped * weight) + RIDGE / 10 * np.eye(mapped.shape[1])
    solved = np.linalg.solve(inner, mapped.T @ (wanted * weight)) if names else np.zeros((0, 0))
    return LanguageModel(names, landmarks, (root @ solved).astype(np.float32))


def learned_from(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place of the block in it, presences) of all blocks of the texts of ``column``."""
    for a, b, data, offsets in text_slices(column):
        points, bounds = code_points(data, offsets)
        sizes = np.diff(bounds)
        count = np.maximum(1, -(-sizes // BLOCK_POINTS))
        text = np.repeat(np.arange(b - a), count)
        place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        starts = bounds[text] + place * sizes[text] // count[text]
        edges = np.append(starts, bounds[-1])
        for low in range(0, len(text), _ROWS):
            high = min(len(text), low + _ROWS)
            yield a + text[low:high], place[low:high], presences(points, edges[low : high + 1])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of each text, chosen by a hash of its id."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        chance = mix(np.nan_to_num(ids.astype(float)).astype(np.int64).view(np.uint64)) % np.uint64(1 << 20)
        sizes = pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)
        wanted = chance.astype(np.int64) % np.maximum(1, -(-sizes.astype(np.int64) // BLOCK_POINTS))
        for text, place, there in _blocks(batch.column(2)):
            own = np.flatnonzero(place == wanted[text])
            if len(own):
                bits = np.packbits(there[own].astype(np.uint8), axis=1)
                columns = [batch.column(j).take(pa.array(text[own])) for j in (0, 1)]
                columns.append(pa.array([b.tobytes() for b in bits], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "grams"])


def fit_languages(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, texts: int = SAMPLE_TEXTS
) -> LanguageModel:
    """Fit to rows of ``docs`` that are not held out and have a text and a language.

    Every language value that occurs is learned. The sample takes rows by a hash of id and text, at a
    rate that gives about ``per_language`` of each language and ``texts`` of all, but no fewer than the
    smallest hash of each, and of a long text one block.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).filter(learned_from(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "languages")
    languages = counts.count()
    per_language = max(1, min(per_language, texts // max(1, languages)))
    sample = (
        rows.join(F.broadcast(counts) if languages <= _FEW_LANGUAGES else counts, "lang")
        .filter((place * F.col("n") < per_language) | (place == F.col("first")))
        .dropDuplicates(["doc_id", "lang", "text"])
        .select("doc_id", "lang", "text")
        .mapInArrow(_sampled, "doc_id long, lang string, grams binary")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("grams", "ascending")])
    )
    bits = np.frombuffer(b"".join(sample["grams"].to_pylist()), np.uint8).reshape(-1, SLOTS // 8)
    return fit_model(np.unpackbits(bits, axis=1).astype(np.float32), sample["lang"].to_pylist())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _predicted(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array(model.languages, object)
        for batch in batches:
            told = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            told &= bool(len(names))
            languages = np.full(batch.num_rows, UNDETERMINED, object)
            scores = np.zeros(batch.num_rows)
            if len(names) and batch.num_rows:
                out, blocks = np.zeros((batch.num_rows, len(names))), np.zeros(batch.num_rows)
                for text, _, there in _blocks(batch.column(2)):
                    np.add.at(out, text, model.outputs(there))
                    np.add.at(blocks, text, 1)
                out /= np.maximum(blocks, 1)[:, None]
                best = out.argmax(axis=1)
                languages = names[best]
                scores = np.clip((out[np.arange(len(out)), best] + 1) / 2, 0, 1)
            languages[~told], scores[~told] = UNDETERMINED, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): lang_pred and score, from 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language.
    Of equal outputs the first language in order wins. Repeated rows stay; null ids too. Very long
    texts are scored in blocks, all of them.
    Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_letter(text).alias("told"), text.alias("text"))
    return rows.mapInArrow(_predicted(held), "doc_id long, lang_pred string, score double")


@query("op6_language_id")
def _op6(spark, folder):
    docs = table(spark, folder, "documents")
    return identify_languages(docs, fit_languages(docs)).select(
        "doc_id",
        F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
