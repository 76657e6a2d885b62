import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontamination as dc


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(pairs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    for doc_id, text in pairs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= {str(x) for x in windows[key] if x is not None}
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(messy):
    texts = [t for _, t in messy if t and len(t) > 400]
    draw = random.Random(9)
    made = []
    for i in range(30):
        w = words(draw.choice(texts))
        low = draw.randrange(max(1, len(w) - 40))
        made.append((i, " ".join(w[low : low + draw.randint(13, 40)]).upper() + "."))
    made += [(100, "ab ab ab"), (101, "漢字"), (102, None), (103, ""), (104, "..."), (None, made[0][1]), made[1], (105, made[2][1])]
    return made


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'y' AS fps")


def test_same_as_looking_for_every_window(spark, docs, messy, items):
    found = dc.decontaminate(docs(messy, extra=True), bench(spark, items)).drop("text_hash")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(messy, items)


def test_rows_that_stay(spark, docs, messy, items):
    made = docs(messy, extra=True)
    kept = dc.without_contaminated(made, bench(spark, items))
    assert kept.columns == made.columns
    wanted = sorted((r[0] for r in brute(messy, items) if not r[4]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == wanted


def test_empty_tables(spark, docs, messy, items):
    assert dc.decontaminate(docs([]), bench(spark, items)).count() == 0
    clean = dc.decontaminate(docs(messy), bench(spark, [])).collect()
    assert len(clean) == len(messy) and not any(r["contaminated"] or r["n_hit"] for r in clean)


def test_digest_of_items(spark, folder):
    from ledgerloom.llm.queries import QUERIES

    none = hashlib.sha256(b"").hexdigest()
    for r in QUERIES["op2_benchmark_decontamination"](spark, folder).collect():
        assert (r["n_items"] == 0) == (r["items_sha256"] == none)
