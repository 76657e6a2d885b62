"""Blocks that meet in pairs: how they are dealt, what they send, and the sums that come of it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_segments import COLUMNS, brute_silhouette

from ledgerloom.functions import block_pairs as bp
from ledgerloom.operators import segments

BLOCK = ["block", "at", "kind", "weight"]


def test_blocks_are_bounded_and_large_kinds_have_their_own():
    counts = [5, 300, 7, 90, 120, 100, 1, 99]
    dealt = bp.deal(counts, 100)
    held = {}
    for n, (first, parts) in zip(counts, dealt, strict=True):
        for block in range(first, first + parts):
            held.setdefault(block, []).append(n / parts)
    assert all(sum(rows) <= 100 for rows in held.values()) and sorted(held) == list(range(len(held)))
    assert [parts for _, parts in dealt] == [1, 3, 1, 1, 2, 1, 1, 1]
    assert len(held[dealt[1][0]]) == len(held[dealt[4][0] + 1]) == 1
    assert bp.deal([], 100) == []


def test_blocks_are_as_large_as_the_cores_allow():
    assert bp.rows_per_block(10**7, 131_072, 8) == 131_072
    blocks = 900_000 / bp.rows_per_block(900_000, 131_072, 8)
    assert blocks * (blocks + 1) / 2 >= 8 * bp.PAIRS_PER_CORE
    assert bp.rows_per_block(0, 131_072, 8) == bp.LEAST_ROWS and bp.rows_per_block(100, 7, 8) == 7


@pytest.mark.parametrize("kinds, slots", [(40, 60), (40, 4)])
def test_a_point_is_sent_a_number_per_kind_and_block(monkeypatch, kinds, slots):
    """And not one per slot and block."""
    monkeypatch.setattr(bp, "PIECE_ROWS", 64)
    draw = np.random.default_rng(slots)
    at, weight = draw.normal(size=(1200, 3)), draw.integers(1, 4, 1200).astype(float)
    kind = np.sort(draw.integers(0, kinds, 1200)).astype(np.int32)
    belongs = (draw.random((kinds, slots)) < 0.5).astype(float)
    parts = np.array_split(np.arange(1200), 6)
    rows = [(i, at[p].tobytes(), kind[p].tobytes(), weight[p].tobytes()) for i, p in enumerate(parts)]
    pairs = [rows[i] + rows[j] for i in range(6) for j in range(i, 6)]
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*pairs, strict=True)], [f"c{i}" for i in range(8)])
    sums, sent = np.zeros((1200, slots)), 0
    for told in bp._met(belongs, 3)(iter([batch])):
        for r in told.to_pylist():
            n = len(parts[r["block"]][r["piece"] * 64 : (r["piece"] + 1) * 64])
            values = np.frombuffer(r["sums"]).reshape(n, -1)
            sent += values.size
            of = slice(parts[r["block"]][0] + r["piece"] * 64, parts[r["block"]][0] + r["piece"] * 64 + n)
            sums[of] += values if r["kinds"] is None else values @ belongs[np.frombuffer(r["kinds"], np.int32)]
    distance = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    assert sums == pytest.approx(distance @ (belongs[kind] * weight[:, None]), rel=1e-11)
    assert sent <= 1200 * min(kinds + 6, slots * 6)


def table(spark, at, *labels):
    rows = [(i, *map(float, x), *map(int, own)) for i, (x, *own) in enumerate(zip(at, *labels, strict=True))]
    return spark.createDataFrame(rows, ["customer_id", *COLUMNS, *[f"l{i}" for i in range(len(labels))]])


def test_blocks_are_read_where_they_lie(spark):
    """Customers were copied once per block into the shuffle, and sums of all slots came back from each."""
    draw = np.random.default_rng(2)
    at, two, five = draw.normal(size=(400, 3)), draw.integers(0, 2, 400), draw.integers(0, 4, 400)
    scores = segments.silhouette(table(spark, at, two, five), {2: "l0", 5: "l1"}, block_rows=30)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "sequence(" not in plan
    for row, labels in zip(scores.orderBy("k").collect(), (two, five), strict=True):
        assert row["silhouette"] == pytest.approx(brute_silhouette(at, labels))


def test_identical_customers_are_spread_over_blocks(spark):
    """One place with one set of labels is dealt over several blocks, as customers are hashed by key."""
    at = np.concatenate([np.zeros((300, 3)), np.ones((20, 3))])
    labels = np.repeat([0, 1], [300, 20])
    df = table(spark, at, labels)
    assert segments.silhouette(df, {2: "l0"}, block_rows=25).first()["silhouette"] == pytest.approx(1.0)
    dealt = df.select("customer_id", *COLUMNS, F.pmod(F.xxhash64("customer_id"), F.lit(12)).cast("int").alias("block"))
    rows = bp.packed(dealt.withColumns({"kind": F.lit(0), "weight": F.lit(1)}), COLUMNS, 12).collect()
    assert len(rows) == 12 and max(len(r["kind"]) // 4 for r in rows) < 60
    assert sum(len(r["at"]) for r in rows) == 320 * 24


def test_no_and_few_customers(spark):
    df = table(spark, np.arange(9.0).reshape(3, 3), [0, 1, 1], [0, 0, 0])
    assert segments.silhouette(df.where("false"), {2: "l0"}).collect() == [(2, None)]
    wanted = brute_silhouette(np.arange(9.0).reshape(3, 3), [0, 1, 1])
    got = dict(segments.silhouette(df, {2: "l0", 3: "l1"}).collect())
    assert got[2] == pytest.approx(wanted) and got[3] == 0.0
