import numpy as np
import pytest

from ledgerloom.llm import lattice_join as lj

SCHEMA = "vec_id long, embedding array<double>, node string, ball string, at string, cell string"


def brute(rows):
    """(vec_id, n_links, component_id, kept), comparing all vectors."""
    rows = list({(i, None if x is None else tuple(x)): None for i, x in rows if i is not None})
    good = [x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x in rows]
    unit = [np.array(x) / max(map(abs, x)) if g else None for (_, x), g in zip(rows, good, strict=True)]
    unit = [x if x is None else x / np.linalg.norm(x) for x in unit]
    near = [
        [
            j
            for j in range(len(rows))
            if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
        ]
        for i in range(len(rows))
    ]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((vec_id, len(near[i]), low, low == vec_id))
    return sorted(out)


def told(spark, rows):
    made = spark.createDataFrame([(i, x, "x", "x", "x", "x") for i, x in rows], SCHEMA)
    return sorted(map(tuple, lj.near_vectors(made).collect()))


def tilted(draw, x, cosine):
    w = draw.normal(size=len(x))
    w -= (w @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def messy_vectors(dims=32):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, dims))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    at = 100
    for x in base[:20]:
        for cosine in (1.0, 0.999, 0.99, 0.97, 0.955, 0.945, 0.9):
            rows.append((at, (draw.uniform(0.1, 9) * tilted(draw, x, cosine)).tolist()))
            at += 1
    center = draw.normal(size=dims)
    rows += [(at + i, tilted(draw, center, draw.choice([0.995, 0.98, 0.96])).tolist()) for i in range(60)]
    rows += [(900 + i, base[30].tolist()) for i in range(30)]
    rows += [(2, None), (3000, None), (3001, []), (3002, [0.0] * dims), (3003, [1.0] * (dims - 1) + [None])]
    rows += [(3004, [float("nan")] * dims), (3005, [float("inf")] + [1.0] * (dims - 1)), (None, base[1].tolist())]
    rows += [(3006, [2.0] * 5), (3007, [1.0] * 5), (3008, [1e-200] * dims), (3009, [1e200] * dims), rows[4], rows[4]]
    return rows


@pytest.mark.parametrize("slices", [1024, 3])
def test_same_as_comparing_all(spark, monkeypatch, slices):
    monkeypatch.setattr(lj, "SLICE_ROWS", slices)
    rows = messy_vectors()
    assert told(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(4, [1.0, 2.0])], [(4, [1.0, 2.0])] * 2, [(4, [1.0]), (5, [2.0]), (6, [-1.0])]])
def test_small_and_empty_tables(spark, rows):
    assert told(spark, rows) == brute(rows)


def test_balls_are_gathered_again(spark, monkeypatch):
    """A group of near copies larger than a run of one cell ends as a few balls."""
    draw = np.random.default_rng(9)
    center = draw.normal(size=16)
    rows = [(i, tilted(draw, center, 0.999).tolist()) for i in range(400)]
    monkeypatch.setattr(lj, "SLICE_ROWS", 16)
    assert told(spark, rows) == [(i, 399, 0, i == 0) for i in range(400)]


def test_nearest_lattice_point():
    draw = np.random.default_rng(5)
    points = draw.normal(size=(2000, 8)) * 3
    found = lj.nearest_e8(points)
    assert ((2 * found).astype(int) == 2 * found).all() and (found.sum(axis=1) % 2 == 0).all()
    own = ((points - found) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9  # the covering radius of the lattice is 1
    for r in lj.ROOTS:
        assert (own <= ((points - found - r) ** 2).sum(axis=1) + 1e-9).all()


def test_pairs_at_the_limit_meet():
    draw = np.random.default_rng(6)
    one = draw.normal(size=(4000, 64))
    one /= np.linalg.norm(one, axis=1)[:, None]
    two = np.array([tilted(draw, x, 0.95) for x in one])
    a, b = lj.cells(one), lj.cells(two)
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() > 0.999
    apart = ((a[:, :, :1] == np.roll(b, 1, axis=0)).any(axis=2)).any(axis=1)
    assert apart.mean() < 0.01
