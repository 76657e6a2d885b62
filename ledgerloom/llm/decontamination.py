"""Benchmark decontamination by winnowing.

Words of items and documents are hashed. From every window of 13 consecutive words the
smallest 7-gram hash is kept (the leftmost of equal ones): two equal windows keep the same
one, so each window that a document shares with an item shows as a shared fingerprint. Shared
fingerprints are joined and extended word by word to both sides; six words to each side tell
all windows that hold the fingerprint. An item of fewer than 13 words is one window with its
whole as fingerprint, and documents are looked through for windows of the lengths in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bitmaps import bitmap, in_bitmap
from ledgerloom.llm.frames import numbered
from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import ALNUM, LOWER, find_words, mix, text_slices, windows
from ledgerloom.session import stage

WINDOW = 13
GRAM = 7
SIDE = WINDOW - GRAM
MAP_BITS = 1 << 23
_ITEM_PAD, _TEXT_PAD = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)

_HITS = "fps array<long>, lens array<int>, places array<int>, lefts array<binary>, rights array<binary>"


def winnow(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the fingerprints of texts whose words begin at ``first`` in ``hashes``."""
    grams = windows(hashes, GRAM)
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:count].copy(), np.zeros(count, np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        less = grams[j : j + count] < best
        best[less] = grams[j : j + count][less]
        at[less] = j
    start = np.arange(count)
    ends = np.repeat(first[1:], np.diff(first))[:count]
    chosen = np.zeros(len(hashes), bool)
    whole = start + WINDOW <= ends
    chosen[(start + at)[whole]] = True
    return np.flatnonzero(chosen)


def _sides(
    hashes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, pad: np.uint64
) -> tuple[np.ndarray, np.ndarray]:
    """Words before and after each fingerprint, the nearest first."""
    steps = np.arange(1, SIDE + 1)
    left = at[:, None] - steps
    right = at[:, None] + GRAM - 1 + steps
    out = []
    for place, there in ((left, left >= low[:, None]), (right, right < high[:, None])):
        words = np.full(place.shape, pad)
        words[there] = hashes[place[there]]
        out.append(words)
    return out[0], out[1]


def _binaries(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).tobytes()
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (8 * SIDE)
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]
    )


def _fingerprints(pad: np.uint64, lengths: list[int] | None, wanted):
    """(id, n_words, fingerprints and their surroundings) of each text.

    ``lengths`` None: a text of under 13 words is one window. Else windows of these lengths
    are looked for, and only fingerprints in the bitmap ``wanted`` are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                found = find_words(LOWER[data], offsets, ALNUM)
                sizes = np.diff(found.first)
                owner = np.repeat(np.arange(b - a), sizes)
                at = winnow(found.hashes, found.first)
                parts = [(windows(found.hashes, GRAM)[at] if len(at) else at.view(np.uint64), at, WINDOW)]
                for length in range(1, WINDOW) if lengths is None else lengths:
                    grams = windows(found.hashes, length, 100 + length)
                    starts = np.arange(len(grams))
                    own = owner[: len(grams)]
                    fits = starts + length <= found.first[1:][own]
                    if lengths is None:
                        fits &= sizes[own] == length
                    parts.append((grams[fits], starts[fits], length))
                rows = []
                for fps, at, length in parts:
                    keep = in_bitmap(wanted.value, fps) if wanted is not None else np.ones(len(fps), bool)
                    rows.append((fps[keep], at[keep], np.full(keep.sum(), length, np.int32)))
                fps, at, lens = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.argsort(owner[at], kind="stable")
                fps, at, lens = fps[order], at[order], lens[order]
                own = owner[at]
                left, right = _sides(found.hashes, at, found.first[own], found.first[own + 1], pad)
                bounds = pa.array(np.searchsorted(own, np.arange(b - a + 1)).astype(np.int32))
                columns = [
                    pa.array(fps.view(np.int64)),
                    pa.array(lens),
                    pa.array((at - found.first[own]).astype(np.int32)),
                    _binaries(left),
                    _binaries(right),
                ]
                ids = [batch.column(j).slice(a, b - a) for j in range(batch.num_columns) if j != 1]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(sizes.astype(np.int64)), _text_digests(found.hashes, found.first)]
                    + [pa.ListArray.from_arrays(bounds, c) for c in columns],
                    [batch.schema.field(j).name for j in range(batch.num_columns) if j != 1]
                    + ["n_words", "sequence", "fps", "lens", "places", "lefts", "rights"],
                )

    return run


def _text_digests(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """A hash of each text's word sequence."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    marked = mix(hashes ^ mix(place.astype(np.uint64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marked, dtype=np.uint64)])
    return pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64))


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words around each shared fingerprint."""
    for batch in batches:
        row, sequence, place, length = (
            batch.column(j).to_numpy(zero_copy_only=False) for j in range(4)
        )
        reach = []
        for j in (4, 6):
            a, b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, SIDE)
                for k in (j, j + 1)
            )
            reach.append(np.cumprod(a == b, axis=1).sum(axis=1))
        left, right = reach
        long = length == WINDOW
        left[~long] = right[~long] = 0
        hit = ~long | (left + right >= SIDE)
        start = place - left
        end = place + np.where(long, GRAM, length) + right
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[hit].astype(np.int64)) for x in (row, sequence, start, end)],
            ["row_id", "sequence", "low", "high"],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): hit words and items, judged by coverage.

    Returns doc_id, text_hash (Spark's xxhash64 of the text, for joins with rows whose ids
    repeat), n_words, n_hit, items and contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased. A word is hit if it
    lies in an occurrence of 13 consecutive words of an item, or of a whole shorter item.
    ``contaminated``: some words are hit, and those are at least a twentieth of all.
    ``items`` are the ids, as strings, sorted, of items with occurring windows.

    Null and empty texts have no words and are clean. Repeated rows, of documents or of items,
    each count; rows with a null item_id hit words without being listed. An empty benchmark
    leaves everything clean. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string"))
    items = stage(
        items.mapInArrow(
            _fingerprints(_ITEM_PAD, None, None),
            f"item_id string, n_words long, sequence long, {_HITS}",
        ),
        "items",
    )
    grams = _rows(items, "sequence").withColumnsRenamed(
        {"left": "item_left", "right": "item_right"}
    ).select("fp", "len", "sequence", "item_left", "item_right").distinct()
    lengths = sorted(
        r[0] for r in items.filter(f"n_words BETWEEN 1 AND {WINDOW - 1}")
        .select(F.col("n_words").cast("int")).distinct().collect()
    )
    wanted = spark.sparkContext.broadcast(bitmap(grams.select("fp"), MAP_BITS))

    source = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("text").cast("string").alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    scanned = stage(
        source.mapInArrow(
            _fingerprints(_TEXT_PAD, lengths, wanted),
            f"row_id long, doc_id long, text_hash long, n_words long, sequence long, {_HITS}",
        ),
        "scanned",
    )
    shared = _rows(scanned, "row_id").join(grams, ["fp", "len"])
    spans = stage(
        shared.select(
            "row_id", "sequence", "place", "len", "left", "item_left", "right", "item_right"
        ).mapInArrow(_extend, "row_id long, sequence long, low long, high long"),
        "spans",
    )
    before = Window.partitionBy("row_id").orderBy("low", "high").rowsBetween(
        Window.unboundedPreceding, -1
    )
    hit = (
        spans.groupBy("row_id", "low").agg(F.max("high").alias("high"))
        .withColumn("done", F.greatest(F.coalesce(F.max("high").over(before), F.lit(0)), "low"))
        .groupBy("row_id")
        .agg(F.sum(F.greatest(F.col("high") - F.col("done"), F.lit(0))).alias("n_hit"))
    )
    listed = (
        spans.select("row_id", "sequence").distinct()
        .join(items.filter("item_id IS NOT NULL").select("sequence", "item_id").distinct(), "sequence")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        scanned.select("row_id", "doc_id", "text_hash", "n_words")
        .join(hit, "row_id", "left")
        .join(listed, "row_id", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = decontaminate(docs, benchmark).filter("contaminated")
    found = stage(found.select("doc_id", "text_hash").distinct(), "contaminated")
    rows, names = numbered(docs)
    same = F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")) & (
        F.xxhash64(F.col(names["text"]).cast("string")) == F.col("text_hash")
    )
    return rows.join(found, same, "left_anti").toDF(*docs.columns)


def _rows(texts: DataFrame, key: str) -> DataFrame:
    """One row per fingerprint."""
    return texts.select(
        key, F.explode(F.arrays_zip("fps", "lens", "places", "lefts", "rights")).alias("h")
    ).select(
        key, F.col("h.fps").alias("fp"), F.col("h.lens").alias("len"),
        F.col("h.places").alias("place"), F.col("h.lefts").alias("left"), F.col("h.rights").alias("right"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
    unnest([array_to_string(w[k:k + least(len(w), 13) - 1], ' ') FOR k IN range(1, len(w) - least(len(w), 13) + 2)])
    AS win FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
    unnest([array_to_string(w[k:k + size - 1], ' ') FOR k IN range(1, len(w) - size + 2)]) AS win
  FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT dw.doc_id, dw.pos, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT word) AS n FROM
  (SELECT doc_id, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT doc_id, pos, size FROM hits)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items,
  sha256(coalesce(listed.ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def _op2(spark, folder):
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )
