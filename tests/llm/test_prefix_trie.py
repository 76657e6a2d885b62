import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, place string, comp string"


def brute(rows):
    """The nodes, from sequences held as tuples."""
    own = {}
    order = sorted(
        ((c, (t is not None, t or 0), (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c is not None)
    )
    for c, _, role, text in order:
        own.setdefault(c, []).append((role, text))
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole = tuple(own.get(base, [])[:h]) + tuple(own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, len(whole) == d))
    found = {}
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(1 for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c, last in who if last)))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        row = (min(c for c, _ in who), len(node), parent, len(who), len(children), leaves, saved)
        found[row + (hashlib.sha256(ends.encode()).hexdigest(),)] = node
    assert len(found) == len(members)
    return sorted(found, key=str)


def told(spark, rows, **limits):
    made = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted(map(tuple, pt.prefix_trie(*pt.rebuilt_turns(made), **limits).collect()), key=str)


def messy_turns():
    draw = random.Random(6)
    texts = ["", "a", "b b", "ü ñ", "漢字\n" * 3, None, "x\0y"]
    rows = []
    for c in [*range(40), -3, -5, -9, 1000, 1003]:
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9, 12])):
            role = draw.choice(["user", "user", "assistant", None])
            rows.append((c, turn, role, draw.choice(texts[:2] if turn < 4 else texts)))
    rows += [(7, None, "user", "first"), (7, None, None, None), (7, 0, "user", "again"), rows[3], rows[3], (None, 1, "user", "lost")]
    # Many copies of one conversation, whose head comes from elsewhere as well.
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(10)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"task_weight": 3}, {"task_weight": 40}])
def test_same_as_brute_force(spark, limits):
    rows = messy_turns()
    assert told(spark, rows, **limits) == brute(rows)


def test_conversations_cut_over_tasks(spark, monkeypatch):
    """One conversation with most turns; ranges of a few rows, so that it spans many tasks."""
    draw = random.Random(7)
    rows = [(5, t, "user", draw.choice("ab")) for t in range(300)]
    rows += [(6, t, "user", draw.choice("ab")) for t in range(20)] + [(0, 0, "user", "a")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(pt, "BLOCK_ROWS", 20)
    monkeypatch.setattr(pt, "PIECE_IDS", 2)
    try:
        assert told(spark, rows, task_weight=30) == brute(rows)
        assert told(spark, messy_turns(), task_weight=30) == brute(messy_turns())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "a")], [(1, 0, "user", "a")], [(5, None, None, None)] * 3, [(4, 0, "a", "x" * 300000)]])
def test_small_and_empty_tables(spark, rows):
    assert told(spark, rows) == brute(rows)


def test_sums_of_a_forest():
    draw = np.random.default_rng(8)
    for n, reach in ((1, 1), (2000, 1), (2000, 3), (500, 500)):
        parent = np.array([-1 if i == 0 or draw.random() < 0.01 else draw.integers(max(0, i - reach), i) for i in range(n)])
        value = draw.integers(-5, 100, (n, 2))
        wanted, weight = value.copy(), draw.integers(1, 4, n)
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                wanted[parent[i]] += wanted[i]
                weight[parent[i]] += weight[i]
        assert (pt.component_sums(parent, weight, value, np.zeros((n, 2), np.int64)) == wanted).all()
