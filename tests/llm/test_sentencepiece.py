import random

import pytest

from ledgerloom.llm import sentencepiece_viterbi as sp


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(sp.MODEL)


def best(word, v):
    """The best segmentation, by trying every piece at every place."""
    found = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece in v.ids:
                options.append((found[start][0] + v.scores[piece], [*found[start][1], v.ids[piece]]))
            elif end - start == 1:
                raw = sp._letter(piece)
                options.append((found[start][0] + v.byte_score * len(raw), [*found[start][1], *(v.byte_ids[b] for b in raw)]))
        found[end] = max(options, key=lambda o: o[0])  # the first, so the shortest, of equal ones
    return found[-1]


def test_same_as_trying_every_segmentation(vocabulary):
    draw = random.Random(6)
    words = {"".join(draw.choices("theringoasdé漢\x01", k=draw.randrange(1, 14))) for _ in range(400)}
    words |= {sp.MARK + w for w in words} | {sp.MARK * 3, "\n", sp._OWN_MARK + "a"}
    for word, ids in zip(sorted(words), sp.encode_words(sorted(words), vocabulary), strict=True):
        assert ids == best(word, vocabulary)[1], word


def test_encoding_of_texts_is_that_of_their_words(vocabulary):
    texts = ["", "the thing", "a\n\n b", "  two", "thing the"]
    flat, bounds = sp.encode_texts(texts, vocabulary)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert flat[a:b].tolist() == [i for w in sp.marked_words(text) for i in best(w, vocabulary)[1]]


def test_long_texts_go_in_pieces(vocabulary, monkeypatch):
    draw = random.Random(4)
    text = "".join(draw.choices(["the", " ", "  ", "\n", "thing", "▁", "é"], k=600)) + "x" * 200
    whole = sp.encode_texts([text, "a"], vocabulary)
    monkeypatch.setattr(sp, "SLICE_BYTES", 50)
    flat, bounds = sp.encode_texts([text], vocabulary)
    assert list(sp.text_pieces(text, 50))[1:] and flat.tolist() == whole[0][: whole[1][1]].tolist()
    assert bounds.tolist() == [0, len(flat)]


def test_texts_come_back(spark, docs, messy):
    made = docs(messy, extra=True)
    rows = sp.decode(sp.encode(made)).collect()
    assert len(rows) == len(messy) and all(r["decoded"] == r["text"] for r in rows)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(((i, t or "") for i, t in messy), key=str)
    assert all((r["ids"] == []) == (r["text"] == "") for r in rows)


def test_decoding_agrees_with_the_library(vocabulary):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    for text in ("The thing\nis  this", "ünï 漢字 \U0001f600", " lead", "a▁b"):
        ids = sp.encode_texts([text], vocabulary)[0].tolist()
        assert library.decode(ids) == text.replace("▁", "▁") == sp.decode_ids(ids, vocabulary)
        assert sp.decode_ids(library.encode(text), vocabulary) == library.decode(library.encode(text))
    assert sp.decode_ids([vocabulary.byte_ids[0xFF]], vocabulary) == "�"


def test_words_stay_whole(vocabulary):
    """Scores by rank give what a merging encoder gives for plain text."""
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp.MODEL)
    text = "the world of computers needs international cooperation and unbelievable results in mathematics"
    assert sp.encode_texts([text], vocabulary)[0].tolist() == library.encode(text)
    assert all(s < 0 for s in vocabulary.scores.values() if s is not None)


def test_null_ids_and_empty_tables(spark, docs):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], None)], "doc_id long, ids array<int>, decoded string")
    assert [r["decoded"] for r in sp.decode(rows).collect()] == ["", ""]
    assert sp.decode(sp.encode(docs([]))).count() == 0
