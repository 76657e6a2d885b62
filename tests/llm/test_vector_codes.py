import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, q string, part string"


def brute(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error and the digest, by comparing every part with every entry."""
    kept = []
    for i, x, label in rows:
        if x is None or not x or len(x) % parts or any(v is None or not np.isfinite(v) for v in x):
            continue
        kept.append((i, [int(np.floor(vc.SCALE * float(v))) for v in x], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    own = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    books = [[list(v[p]) for v in own[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [nearest(v[p], books[p])[1] for v in own]
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(own, found, strict=True) if f == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(kept, own, strict=True):
        near = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=str)


def told(spark, rows):
    made = spark.createDataFrame([(i, x, label, "x", "x", "x") for i, x, label in rows], SCHEMA)
    found, books = vc.compress_vectors(made)
    return sorted(((r[0], r["code"], r["error"], r["label_error"], vc.codebooks_digest(books)) for r in found.collect()), key=str)


def test_tree_finds_the_nearest_and_the_lowest_of_ties():
    draw = np.random.default_rng(1)
    for entries, width, spread in ((64, 4, 200), (64, 2, 6), (7, 3, 3), (1, 1, 5), (256, 8, 1 << 26)):
        book = draw.integers(-spread, spread + 1, (entries, width))
        parts = draw.integers(-spread, spread + 1, (500, width))
        parts[:100] = book[draw.integers(0, entries, 100)]
        best, index = vc.nearest_entries(vc.Gnat(book, np.arange(entries)), parts)
        apart = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
        assert (best == apart.min(axis=1)).all() and (index == apart.argmin(axis=1)).all()


def test_tree_drops_subtrees():
    draw = np.random.default_rng(2)
    book = draw.integers(-200, 200, (64, 2))
    parts = book[draw.integers(0, 64, 1000)] + draw.integers(-5, 6, (1000, 2))
    best, index = np.full(1000, np.iinfo(np.int64).max), np.full(1000, 64)
    taken = vc.Gnat(book, np.arange(64)).search(parts, np.arange(1000), best, index)
    assert taken < 0.5 * 64 * 1000


def messy_vectors(n=150, dims=32):
    draw = random.Random(3)
    rows = [(i * 3, [draw.gauss(0, 0.2) for _ in range(dims)], draw.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [(1, rows[5][1], 0), (2, rows[5][1], None), (4, [0.0] * dims, 1), rows[7], (21, rows[9][1], 2)]
    rows += [(5, None, 1), (7, [], 1), (8, [1.0] * 31 + [None], 0), (10, [float("nan")] * dims, 0)]
    rows += [(11, [float("inf")] + [0.0] * 31, 2), (13, [0.5] * 16, 2), (14, [0.5] * 20, 2), (None, rows[3][1], 1)]
    return rows


def test_same_as_brute_force(spark):
    rows = messy_vectors()
    assert told(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(3, [0.1] * 16, None)], [(3, [0.1] * 16, 1)] * 3, messy_vectors(20, 16)])
def test_small_and_empty_tables(spark, rows):
    assert told(spark, rows) == brute(rows)


def test_components_out_of_range_are_left_out(spark):
    rows = [(1, [0.1] * 16, 0), (2, [1e30] * 16, 0), (3, [float(vc.LARGEST // vc.SCALE)] * 16, 0)]
    assert [r[0] for r in told(spark, rows)] == [1, 3]
