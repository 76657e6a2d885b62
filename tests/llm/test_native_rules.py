import re
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import license_scan, preferences, quality_rules
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_chat_formatting", "op10_license_scan"])
def test_no_python_in_the_plans(spark, folder, name):
    assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, folder)))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def lines_of(text):
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line.translate({**{c: c + 32 for c in range(65, 91)}, **{c: 48 for c in range(49, 58)}}))
        if words:
            yield " ".join(words), len(words)


def test_quality_rules(spark, docs, messy):
    prose = "Every page of ours says this much and some more words besides to be long enough, number {} of all the pages we have."
    extra = [(500 + i, "A common  line of 7 words\n" + prose.format(i) + "\na common line of 9 words\nown " + "xyz"[i % 3] * i) for i in range(9)]
    extra += [(600 + i, ("shared by many documents and long " * 1 + "a b c d e f g h i j k l m n o p q r s t u v w\n") * 1 + f"w{i}") for i in range(9)]
    pairs = messy + extra
    made = docs(pairs, extra=True)
    found = quality_rules.quality_rules(made, max_documents=5).collect()
    counts = Counter(line for _, t in pairs for line in {x for x, _ in lines_of(t)})
    wanted = []
    for i, t in pairs:
        told = base(t)
        gone = [n for line, n in lines_of(t) if counts[line] > 5]
        kept = not told[5] and told[0] - sum(gone) >= 0.5 * told[0]
        wanted.append((i, *told, kept, sum(gone), len(gone)))
    assert sorted((tuple(r) for r in found), key=str) == sorted(wanted, key=str)
    assert {r["doc_id"] for r in found if not r["base_failed"] and not r["kept"]} >= set(range(600, 609))


def test_lines_are_counted_per_host(spark, docs):
    prose = "a line that comes again\n"
    one, two = (docs([(i, f"{prose}own {chr(97 + i)}") for i in r], source=s) for r, s in ((range(4), "a"), (range(10, 13), None)))
    cut = quality_rules.without_frequent_lines(one.unionByName(two), max_documents=3)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {
        **{i: f"own {chr(97 + i)}" for i in range(4)}, **{i: f"{prose}own {chr(97 + i)}" for i in range(10, 13)}
    }
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_limit_is_a_share_of_the_host(spark, docs):
    """A line that a tenth of a host's documents have goes whatever their number; a twentieth may stay."""
    line = "menu home about contact terms and all the other words that every page has at its foot"
    own = lambda i: " ".join("".join(chr(97 + int(d)) for d in f"{i:04d}{j}") for j in range(10))
    lost = {}
    for n in (100, 400):
        pairs = [(i, f"{line} {kind}\n{own(i)}" if share else own(i) + " " + own(i + 5000)) for i in range(n)
                 for share, kind in [(i % 8 == 0, "a") if i % 2 == 0 else (i % 40 == 1, "b")]]
        found = quality_rules.quality_rules(docs(pairs), max_documents=5).collect()
        lost[n] = sum(r["removed_lines"] > 0 for r in found) / n
        assert all(not r["kept"] for r in found if r["removed_lines"] and not r["base_failed"])
        assert sum(r["removed_lines"] > 0 and not r["base_failed"] for r in found) == len(range(0, n, 8))
    assert lost[100] == pytest.approx(lost[400], abs=0.01)


TURNS = "pair_id long, turn long, role string, text string, side string, parting long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "s", 7) for r in rows], TURNS)


def test_preferences(spark):
    chosen = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "alone"),
        (4, 0, None, None), (4, 1, "assistant", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"),
        (None, 0, "user", "x"), (5, None, "user", "x"),
    ]
    rejected = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "other"), (1, 3, "assistant", "bad"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"),
        (4, 0, "", ""), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (4, 2, "assistant", "c"),
    ]
    found = preferences.format_preferences(turns(spark, chosen), turns(spark, rejected)).collect()
    told = sorted((r["pair_id"], r["section"], r["turn"], r["role"], r["rendered"], r["trained"]) for r in found)
    turn = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert told == sorted(
        [
            (1, "prompt", 0, "user", turn("user", "hi"), False), (1, "prompt", 1, "assistant", turn("assistant", "yes"), False),
            (1, "chosen", 2, "user", turn("user", "more"), False), (1, "chosen", 3, "assistant", turn("assistant", "good"), True),
            (1, "rejected", 2, "user", turn("user", "other"), False), (1, "rejected", 3, "assistant", turn("assistant", "bad"), True),
            (2, "prompt", 0, "user", turn("user", "same"), False), (2, "prompt", 1, "assistant", turn("assistant", "same"), False),
            (3, "chosen", 0, "user", turn("user", "alone"), False), (4, "prompt", 0, "", turn("", ""), False),
            (4, "prompt", 1, "assistant", turn("assistant", "a"), False), (4, "prompt", 1, "assistant", turn("assistant", "b"), False),
            (4, "rejected", 2, "assistant", turn("assistant", "c"), True),
        ]
    )
    assert preferences.format_preferences(turns(spark, []), turns(spark, [])).count() == 0


def test_stale_answers(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"),
        (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "user", "q"), (None, 0, "assistant", "a"),
    ]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = preferences.stale_answers(made)
    last = {r["pair_id"]: r["text"] for r in rejected.orderBy("turn").collect()}
    assert last == {1: "a", 2: "q", 3: "", 4: "q"}
    assert sorted(r["turn"] for r in chosen.filter("pair_id = 1").collect()) == [0, 1, 2, 3, 4]
    found = preferences.format_preferences(chosen, rejected).collect()
    told = {(r["pair_id"], r["section"], r["turn"]): r["trained"] for r in found}
    assert told[1, "chosen", 3] and told[1, "rejected", 3] and told[1, "chosen", 4] is False
    assert {k: v for k, v in told.items() if k[0] == 4} == {(4, "prompt", 0): False}
    # Every turn is there: in the prompt or on the chosen side.
    assert sum(r["section"] != "rejected" for r in found) == sum(r[0] is not None for r in rows)


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_scan(text):
    found = words(text)
    spaced = "".join(f" {w} " for w in found)
    at = lambda m: (spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2)
    hits = [
        (*at(m), priority, number, label)
        for number, priority, label, keyword, regex in license_scan.rules()
        if keyword in spaced
        for m in re.finditer(regex, spaced)
    ]
    kept = [
        x for x in hits
        if not any(
            y[0] <= x[0] and y[1] >= x[1]
            and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[1] - y[0] == x[1] - x[0] and y[3] < x[3]))
            for y in hits
        )
    ]
    starts, labels = [], set()
    for label, phrase in license_scan.BASE:
        w = phrase.split()
        places = [i for i in range(len(found)) if found[i : i + len(w)] == w]
        starts += places
        labels |= {label} if places else set()
    return (
        len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {x[4] for x in kept})), max([x[2] / 100 for x in kept] + [0.7 if starts else 0.0]), sorted(kept),
    )


def test_license_scan(docs, messy):
    texts = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "mit license mit license MIT-License",
        "This work is licensed under the GNU General Public License, version 3 or any later version",
        "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause", "license", "the GNU Lesser General Public License v2.1",
        "Copyright (c) 2020 Someone. All rights reserved. mit licensed", "KMIT License", "no general public here, license",
    ]
    pairs = messy + [(700 + i, t) for i, t in enumerate(texts)] + [(800, " ".join(texts * 40))]
    found = license_scan.scan_licenses(docs(pairs, extra=True)).collect()
    told = sorted(
        ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], [tuple(d) for d in r["detections"]]) for r in found),
        key=str,
    )
    assert told == sorted(((i, *brute_scan(t)) for i, t in pairs), key=str)
    by = {r["doc_id"]: r["labels"] for r in found}
    assert (by[700], by[701], by[704], by[707]) == ("mit", "apache", "cc-by-nc", "gpl,lgpl")
    assert len(license_scan.rules()) > 200
    assert license_scan.scan_licenses(docs([])).count() == 0


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op5_suffix_dedup"}))
def test_queries_agree_with_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    ours = QUERIES[name](spark, folder)
    theirs = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(str, (tuple(r) for r in ours.select(*names).collect()))) == sorted(map(str, theirs.fetchall()))
