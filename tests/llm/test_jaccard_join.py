import random
import re

import numpy as np
import pytest

from ledgerloom.llm import jaccard_join as jj


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return frozenset()
    width = min(words, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def brute(pairs, words, num, den):
    """(n, component, links) per row, by comparing all pairs."""
    sets = [shingles(t, words) for _, t in pairs]
    near = [
        [
            j
            for j, b in enumerate(sets)
            if j != i and a and b and den * len(a & b) >= num * len(a | b)
        ]
        for i, a in enumerate(sets)
    ]
    out = []
    for i, (doc_id, _) in enumerate(pairs):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [pairs[j][0] for j in seen if pairs[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.drop("text_hash").collect()), key=str)


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_same_as_comparing_all_pairs(docs, messy, words, num, den):
    found = jj.ngram_jaccard_join(docs(messy, extra=True), words, num, den)
    assert rows(found) == brute(messy, words, num, den)


def test_a_large_group_of_near_copies_is_divided_without_losing_links(docs, monkeypatch):
    monkeypatch.setattr(jj, "GROUP_SETS", 8)
    draw = random.Random(3)
    words = [f"w{draw.randrange(500)}" for _ in range(90)]
    pairs = []
    for i in range(80):
        copy = list(words)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = f"v{draw.randrange(99)}"
        pairs.append((i, " ".join(copy)))
    assert rows(jj.ngram_jaccard_join(docs(pairs), 4, 85, 100)) == brute(pairs, 4, 85, 100)


def test_chains_are_one_component(docs):
    words = [f"w{i}" for i in range(140)]
    pairs = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(26)]
    found = brute(pairs, 4, 85, 100)
    assert {c for _, _, c, _ in found} == {0}
    assert rows(jj.ngram_jaccard_join(docs(pairs), 4, 85, 100)) == found


def test_empty_table(docs):
    assert jj.ngram_jaccard_join(docs([])).count() == 0
    assert jj.one_of_each_group(docs([])).count() == 0


def test_one_of_each_group(docs, messy):
    kept = jj.one_of_each_group(docs(messy, extra=True))
    assert kept.columns == docs(messy, extra=True).columns
    wanted = {(i, t) for (i, t), (_, _, c, _) in zip(messy, unsorted(messy), strict=True) if i == c}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(wanted, key=str)


def unsorted(pairs):
    by = {}
    for row, pair in zip(brute_rows(pairs), pairs, strict=True):
        by[id(pair)] = row
    return [by[id(p)] for p in pairs]


def brute_rows(pairs):
    """Brute force in the order of ``pairs``."""
    marked = [((i, k), t) for k, (i, t) in enumerate(pairs)]
    ordered = []
    sets = [shingles(t, 5) for _, t in pairs]
    for k, _ in enumerate(marked):
        seen, todo = {k}, [k]
        while todo:
            a = sets[todo.pop()]
            for j, b in enumerate(sets):
                if j not in seen and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    seen.add(j)
                    todo.append(j)
        ids = [pairs[j][0] for j in seen if pairs[j][0] is not None]
        ordered.append((pairs[k][0], 0, min(ids) if ids else None, 0))
    return ordered


def test_linked_sets_share_a_token():
    draw = np.random.default_rng(1)
    levels = jj.SizeLevels(85, 100)
    for size in (6, 7, 9, 13, 14, 20, 33, 60, 140, 400, 1500):
        for _ in range(12):
            a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
            keep = len(a) - int(draw.integers(0, max(1, round(0.09 * size)) + 1))
            new = int(draw.integers(0, max(1, round(0.09 * size)) + 1))
            b = np.unique(np.concatenate([draw.permutation(a)[:keep], draw.integers(0, 2**63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(a) == both == len(b) or 100 * both < 85 * (len(a) + len(b) - both):
                continue
            assert len(np.intersect1d(jj.part_tokens(a, levels), jj.part_tokens(b, levels))), size


def test_linked_sets_share_the_rows_they_need():
    """Sets linked just so share at least as many rows of the matrix as each of them asks for."""
    draw, levels, asked = np.random.default_rng(5), jj.SizeLevels(80, 100), []
    for size in [3, 10, 30, 100, 400, 1500] * 5:
        one = draw.integers(0, 1 << 62, size).astype(np.uint64)
        differ = levels.difference(2 * size) // 2
        other = np.concatenate([one[differ:], draw.integers(0, 1 << 62, differ).astype(np.uint64)])
        shared = len(np.intersect1d(jj.part_tokens(one, levels), jj.part_tokens(other, levels)))
        need = [jj.least_shared(s, levels) for s in (one, other)]
        assert differ == 0 or shared >= max(need)
        asked += need
    assert max(asked) > 15
