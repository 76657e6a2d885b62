"""Passages of over 50 words that repeat, with fewer than 400 bytes."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as brute_contaminated
from test_pipeline import first_of_groups

from ledgerloom.llm import quality_classifier as qc
from ledgerloom.llm import sentencepiece_viterbi as sp
from ledgerloom.llm import suffix_dedup as sd


def brute(pairs, width, words):
    """(doc_id, text) left without repeated strings of ``width`` bytes and ``words`` words."""
    raws = [(t or "").encode() for _, t in pairs]
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", raw)) for raw in raws]
    seen = {}
    for raw, own in zip(raws, found, strict=True):
        for i in range(len(raw) - width + 1):
            seen[raw[i : i + width]] = seen.get(raw[i : i + width], 0) + 1
        for i in range(len(own) - words + 1):
            key = tuple(m[0] for m in own[i : i + words])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (doc_id, text), raw, own in zip(pairs, raws, found, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if seen[raw[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        for i in range(len(own) - words + 1):
            if seen[tuple(m[0] for m in own[i : i + words])] > 1:
                a = own[i].start() if i else 0
                b = own[i + words].start() if i + words < len(own) else len(raw)
                gone[a:b] = b"\1" * (b - a)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")
        if left or not raw:
            out.append((doc_id, left if any(gone) else text))
    return out


def told(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("divided", [False, True])
def test_same_as_counting_words_and_bytes(docs, messy, monkeypatch, divided):
    if divided:
        monkeypatch.setattr(sd, "BUCKET_BYTES", 3000)
        monkeypatch.setattr(sd, "GRAM_SHARE_BYTES", 1000)
    for width, words in ((400, 51), (60, 20)):
        # The same words with other blanks between them are the same passage.
        pairs = messy + [(900, messy[20][1].replace(" ", "\n ")), (901, " " + messy[13][1] + "\n")]
        found = sd.without_repeats(docs(pairs, extra=True), width, words)
        assert told(found) == sorted(brute(pairs, width, words), key=str), (width, words)


def test_stage_takes_out_passages_of_51_words(spark, docs):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 5)))
    some = lambda n: " ".join(word() for _ in range(n))
    pairs, wanted = [], {}
    for n in range(49, 64):
        passage = some(n)
        assert len(passage) < 400
        for _ in range(2):
            before, after = some(30), some(30)
            wanted[len(pairs)] = f"{before} {after}" if n > 50 else f"{before} {passage} {after}"
            pairs.append((len(pairs), f"{before} {passage} {after}"))
    found = corpus_pipeline.without_repeated_passages(spark, docs(pairs), "")
    assert {r["doc_id"]: r["text"] for r in found.collect()} == wanted
    assert {r["doc_id"]: r["n_chars"] for r in found.collect()} == {i: len(t) for i, t in wanted.items()}


def test_pipeline_is_the_same_as_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = qc.score_quality(docs, qc.fit_quality(docs, labels), ["doc_id", "text"])
    pairs = [(r["doc_id"], r["text"]) for r in scored.filter(F.col("score") >= 0.7).collect()]
    assert 0.6 * docs.count() < len(pairs) < docs.count()
    pairs = brute(first_of_groups(pairs), 400, 51)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contaminated(pairs, items) if r[4]}
    pairs = [p for p in pairs if p[0] not in bad]
    flat, bounds = sp.encode_texts([t for _, t in pairs], sp.Vocabulary.load(sp.MODEL))
    wanted = {i: flat[a:b].tolist() for (i, _), a, b in zip(pairs, bounds[:-1], bounds[1:], strict=True)}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == wanted and len(found) == len(wanted)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)
