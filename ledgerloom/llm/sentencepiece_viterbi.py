"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

A text gets a mark in front, blanks become marks, and it falls into marked words: pieces have marks
at their beginning only and no line breaks, so none crosses words. A task takes the distinct
words of a slice of texts in order, which is a walk through their trie, depth first: a word
starts from the forward scores of the letters it has in common with the word before. The
score of a segmentation is the sum of its pieces' scores; letters without a piece are
spelled in byte pieces.

The score of a piece is the logarithm of its chance. Files of merging encoders hold merge ranks in its
place, which say nothing when summed up; a piece of rank r then counts as one that Zipf's law gives a
chance in proportion to 1 / (r + RANK_SHIFT). Nothing is trained for it. Best sums are not what a
merging encoder returns for every word; both decode to the same text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that is in the text itself; valid texts hold no lone surrogates.
_OWN_MARK = "\udc81"
_CUT = re.compile("(?<! ) ")
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
SLICE_BYTES = 4 << 20
#: Mandelbrot's shift in Zipf's law.
RANK_SHIFT = 2.7


@dataclass
class Vocabulary:
    """Pieces and what the search needs of them."""

    scores: dict[str, float | None]  # of pieces, and None for other endings of pieces
    ids: dict[str, int]
    byte_ids: list[int]
    byte_score: float
    spelled: list[bytes]  # by id, marks as blanks

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read the file at ``path`` in the driver; the result is sent to tasks."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids: dict[str, int] = {}
        scores: dict[str, float | None] = {}
        spelled: list[bytes] = []
        byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                if "\n" in piece or MARK in piece.lstrip(MARK):
                    raise ValueError("a piece goes across words")
                ids[piece], scores[piece] = i, model.get_score(i)
                spelled.append(piece.replace(MARK, " ").encode())
        if all(s == round(s) for s in scores.values()):  # merge ranks, negated
            total = sum(1 / (RANK_SHIFT - s) for s in scores.values())
            scores = {piece: -math.log((RANK_SHIFT - s) * total) for piece, s in scores.items()}
        low = min((s for s in scores.values() if s > -1e8), default=0.0)
        for piece in ids:
            for j in range(1, len(piece)):
                scores.setdefault(piece[j:], None)
        return cls(scores, ids, byte_ids, low - 10, spelled)


def marked_words(text: str, front: str = MARK) -> list[str]:
    if not text:
        return []
    text = text.replace(MARK, _OWN_MARK) if MARK in text else text
    return _WORDS.findall(front + text.replace(" ", MARK))


def text_pieces(text: str, size: int) -> Iterator[str]:
    """A long text in pieces of about ``size`` letters, whose marked words are those of the whole.

    It is cut before blanks that follow another letter. Pieces after the first begin with one and
    take no mark in front.
    """
    low = 0
    while len(text) - low > size:
        found = _CUT.search(text, low + size)
        if found is None:
            break
        yield text[low : found.start()]
        low = found.start()
    yield text[low:]


def encode_words(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of the best segmentation of each of ``words``, which are distinct and in order.

    Of equal sums the one whose last piece is shortest wins, and so on towards the front.
    """
    scores, ids = vocabulary.scores, vocabulary.ids
    best, back = [0.0], [0]
    before = ""
    out = []
    for word in words:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, start = -1e300, end - 1
            i = end - 1
            while i >= 0:
                score = scores.get(word[i:end], _ABSENT)
                if score is _ABSENT:
                    break
                if score is not None and best[i] + score > top:
                    top, start = best[i] + score, i
                i -= 1
            if word[end - 1] not in ids:
                spelled = best[end - 1] + vocabulary.byte_score * len(_letter(word[end - 1]))
                if spelled > top:
                    top, start = spelled, end - 1
            best.append(top)
            back.append(start)
        before = word
        pieces: list[int] = []
        end = len(word)
        while end:
            start = back[end]
            known = ids.get(word[start:end])
            if known is None:
                pieces += [vocabulary.byte_ids[b] for b in reversed(_letter(word[start:end]))]
            else:
                pieces.append(known)
            end = start
        out.append(pieces[::-1])
    return out


_ABSENT = object()


def _letter(letter: str) -> bytes:
    return MARK.encode() if letter == _OWN_MARK else letter.encode()


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids begin); a single long text goes in pieces."""
    if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
        pieces = enumerate(text_pieces(texts[0], SLICE_BYTES))
        marked = (marked_words(piece, "" if i else MARK) for i, piece in pieces)
        flat = np.concatenate([_encode_marked([words], vocabulary)[0] for words in marked])
        return flat, np.array([0, len(flat)])
    return _encode_marked([marked_words(t) for t in texts], vocabulary)


def _encode_marked(words: list[list[str]], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    distinct = sorted(set(chain.from_iterable(words)))
    pieces = encode_words(distinct, vocabulary)
    number = dict(zip(distinct, range(len(distinct)), strict=True))
    flat = np.fromiter(chain.from_iterable(pieces), np.int32)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(sizes) - sizes
    sequence = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
    lengths = sizes[sequence]
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[sequence] - (ends - lengths), lengths)
    per_text = np.cumsum([0, *(len(w) for w in words)])
    bounds = np.concatenate([[0], ends])[per_text]
    return flat[at] if len(at) else flat[:0], bounds


def decode_ids(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids; the mark in front goes, bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(map(vocabulary.spelled.__getitem__, ids))
    return raw.removeprefix(b" ").decode(errors="replace")


def _encode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                raw = data.tobytes()
                texts = [raw[i:j].decode() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                flat, bounds = encode_texts(texts, held.value)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), ids, batch.column(1).slice(a, b - a)],
                    ["doc_id", "ids", "text"],
                )

    return run


def _decode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [decode_ids(x.values.to_numpy().tolist(), held.value) for x in part["ids"]]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"]
                )

    return run


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids. Repeated rows and null ids stay. A mark that is in a text
    is spelled in bytes, so it is not taken for a blank. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_encode(held), "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``encoded``, with the text of ``ids`` as ``decoded``. Null ids are no ids."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = encoded.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(held), f"{schema}, decoded string")


@query("op9_sentencepiece")
def _op9(spark, folder):
    found = decode(encode(table(spark, folder, "documents")))
    return found.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
