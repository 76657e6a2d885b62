import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with clashing extra columns on request."""

    def build(pairs, extra=False, lang="en", source="a"):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in pairs]
        made = spark.createDataFrame(rows, DOCS)
        if extra:
            clash = (
                "n", "digest", "row_id", "score", "spans", "token", "text_hash", "members", "words", "host",
                "found", "kept", "ids", "decoded", "low", "line", "__spans", "quality", "item_id", "k0", "t",
            )
            for name in clash:
                made = made.selectExpr("*", f"'x' AS `{name}`")
        return made

    return build


@pytest.fixture(scope="session")
def messy():
    """Null, empty, blank, short, repeated and very long texts; null and repeated ids."""
    word = random.Random(5)
    vocabulary = ["".join(word.choices("abcdefgh", k=word.randint(1, 6))) for _ in range(300)]
    base = [word.choices(vocabulary, k=120) for _ in range(6)]
    pairs = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One  two three"), (None, "one two three")]
    at = 10
    for words in base:
        for changes in (0, 0, 1, 3, 30):
            copy = list(words)
            for _ in range(changes):
                copy[word.randrange(len(copy))] = word.choice(vocabulary)
            pairs.append((at, " ".join(copy)))
            at += 1
    passage = " ".join(word.choices(vocabulary, k=140))
    for _ in range(4):
        own = [" ".join(word.choices(vocabulary, k=60)) for _ in range(2)]
        pairs.append((at, f"{own[0]}\n{passage}\n{own[1]} ÄÖ ñ 漢字"))
        at += 1
    pairs += [(at, "ab " * 2000), (at + 1, "x" * 3000), (at + 2, " ".join(word.choices(vocabulary, k=20000)))]
    pairs += [pairs[12], pairs[12], (None, pairs[20][1]), (at + 3, "\x00   ▁ ▁▁ \U0001f600 é")]
    return pairs
