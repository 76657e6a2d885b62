"""A random forest with exact split points.

All trees grow together. A node of many rows is split by scans: each returns, for every open node and
feature, class weights and the smallest and largest value per bin. Splits between bins lie halfway
between neighbouring values of the node itself. A split inside a bin cannot gain more than the better
of the two ways to put the bin's classes on either side (the gain is convex in the counts), so only
bins that could hold a better split are divided again, by their own values, until none is left. Bins
are divided in 256 along the order of doubles, so no value takes more than eight rounds, however many
rows there are. Where many intervals are open they are divided in fewer, so a task counts in some
MOST_CELLS cells at most. A node of few rows goes to one task, which grows all that is below it by
sorting; its rows travel as packed columns, some thousands to a row of the shuffle.

Nothing depends on the layout of the rows: how often a row is in a tree's sample (Poisson, as drawing
with replacement gives) is a hash of its key and the tree, and which features a node looks at is a hash
of the tree and the node. Nodes are numbered as in a heap, 1 the root, 2i and 2i + 1 the children of i.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.forest import NODE_SCHEMA, Forest
from ledgerloom.session import stage

#: Weight from which a node is split by scans of all rows.
LOCAL_WEIGHT = 1 << 22
#: Weight of the nodes that a task should get, where several are left.
TASK_WEIGHT = 1 << 19
BINS = 256
#: Cells that open intervals are divided into together, as long as each gets a few.
MOST_CELLS = 1 << 20
#: Rows that a task walks down all trees at a time.
BLOCK_ROWS = 8192
#: Rows of a batch that a task returns.
BATCH_ROWS = 100_000
LEAST_GAIN = 1e-12
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = _mix(h * np.uint64(0xD1B54A32D192ED03) + np.asarray(part).astype(np.int64).view(np.uint64))
    return h


def sample_weights(keys: np.ndarray, tree: int | np.ndarray, seed: int) -> np.ndarray:
    """How often each key is in the sample of a tree."""
    chance = (_hash(seed, tree, keys) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, chance, side="right")


def feature_order(seed: int, tree: int, node: int, features: int) -> np.ndarray:
    """The order in which a node looks at the features."""
    return np.argsort(_hash(seed + 1, tree, node, np.arange(features)), kind="stable")


def gains(l0: np.ndarray, l1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Gini gain of splits that put class weights (l0, l1) of (n0, n1) below."""

    def pure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = a + b
        return (a * a + b * b) / np.where(total > 0, total, 1)

    l0, l1 = np.asarray(l0, float), np.asarray(l1, float)
    whole = n0 + n1
    return (pure(l0, l1) + pure(n0 - l0, n1 - l1) - (n0 * n0 + n1 * n1) / whole) / whole


def halfway(low: float, high: float) -> float:
    middle = low / 2 + high / 2
    return middle if low <= middle < high else low


def best_split(
    x: np.ndarray, label: np.ndarray, weight: np.ndarray, order: np.ndarray, looked_at: int
) -> tuple[float, int, float] | None:
    """(gain, feature, split) of a node by sorting its rows; at least ``looked_at`` features are tried.

    More are tried only while all so far are constant. Of equal gains the first feature in ``order``
    and the smallest split win.
    """
    return _best_split(lambda f: x[:, f], label, weight, order, looked_at)


def _best_split(
    column: Callable[[int], np.ndarray], label: np.ndarray, weight: np.ndarray, order: np.ndarray, looked_at: int
) -> tuple[float, int, float] | None:
    ones = weight * label
    n1 = float(ones.sum())
    n0 = float(weight.sum()) - n1
    best = None
    for tried, f in enumerate(order.tolist(), 1):
        values = column(f)
        line = np.argsort(values)  # sums at the cuts do not depend on the order of equal values
        values = values[line]
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if len(cuts):
            l1 = np.cumsum(ones[line])[cuts]
            l0 = np.cumsum(weight[line])[cuts] - l1
            found = gains(l0, l1, n0, n1)
            i = int(found.argmax())
            if best is None or found[i] > best[0]:
                best = float(found[i]), f, halfway(float(values[cuts[i]]), float(values[cuts[i] + 1]))
        if tried >= looked_at and best is not None:
            break
    return best


def _line(tree: int, node: int, best: tuple[float, int, float] | None, n0: float, n1: float) -> tuple:
    if best is None:
        return tree, node, None, None, None, None, None, float(n0), float(n1)
    gain, feature, split = best
    return tree, node, int(feature), float(split), 2 * node, 2 * node + 1, float(gain), float(n0), float(n1)


def grow_below(
    x: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, top: int, depth: int, looked_at: int, seed: int
) -> list[tuple]:
    """Rows of NODE_SCHEMA for node ``top`` and all below it, grown from the rows at ``top``."""
    columns = [np.ascontiguousarray(c) for c in x.T]
    lines, open_nodes = [], [(top, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        own, w = label[rows], weight[rows]
        n1 = float((w * own).sum())
        n0 = float(w.sum()) - n1
        best = None
        if node < 1 << depth and n0 > 0 and n1 > 0:
            order = feature_order(seed, tree, node, len(columns))
            best = _best_split(lambda f: columns[f][rows], own, w, order, looked_at)
            if best is not None and best[0] <= LEAST_GAIN:
                best = None
        lines.append(_line(tree, node, best, n0, n1))
        if best is not None:
            low = columns[best[1]][rows] <= best[2]
            open_nodes += [(2 * node + 1, rows[~low]), (2 * node, rows[low])]
    return lines


def _ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles ``x``."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


def walk(x: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node (rows x trees) that each row has come to; ``feature`` is -1 where a tree ends."""
    trees = np.arange(len(feature))[None]
    node = np.ones((len(x), len(feature)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(levels):
        f = feature[trees, node]
        below = x[rows, f] <= split[trees, node]
        node = np.where(f >= 0, 2 * node + ~below, node)
    return node


class _Growing:
    """The upper part of the trees, held on the driver and sent along with every scan."""

    def __init__(self, rows: DataFrame, key: str, label: str, features: Sequence[str], trees: int, depth: int, looked_at: int, seed: int):
        self.rows = rows.select(
            F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"),
            *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
        )
        self.width, self.trees, self.depth, self.looked_at, self.seed = len(features), trees, depth, looked_at, seed
        self.feature = np.full((trees, 2 << depth), -1, np.int8)
        self.split = np.zeros((trees, 2 << depth))
        self.lines: list[tuple] = []
        shares = [i / BINS for i in range(1, BINS)]
        edges = self.rows.agg(*[F.percentile_approx(f"x{i}", shares, 4 * BINS) for i in range(self.width)]).first()
        self.edges = [np.unique(np.asarray(e or [], float)) for e in edges]

    def met(self, level: int, wanted: np.ndarray):
        """For batches of rows: (x, label, tree, weight, number in ``wanted``) of rows at wanted nodes.

        ``wanted`` (trees x nodes) numbers the nodes, -1 for all others.
        """
        feature, split, trees, seed, width = self.feature, self.split, self.trees, self.seed, self.width

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(start, BLOCK_ROWS)
                    keys, label = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    x = np.stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
                    number = wanted[np.arange(trees)[None], walk(x, feature, split, level)]
                    row, tree = np.nonzero(number >= 0)
                    weight = sample_weights(keys[row], tree, seed)
                    some = weight > 0
                    row, tree, weight = row[some], tree[some], weight[some]
                    if len(row):
                        yield x, row, label[row], tree, weight, number[row, tree]

        return blocks

    def totals(self) -> np.ndarray:
        """Class weights of the trees' samples, trees x 2."""
        seed, trees = self.seed, self.trees

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((trees, 2), np.int64)
            for batch in batches:
                keys, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for t in range(trees):
                    total[t] += np.bincount(label, sample_weights(keys, t, seed), 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["tree", "n0", "n1"])

        found = self.rows.select("key", "label").mapInArrow(counted, "tree long, n0 long, n1 long")
        out = np.zeros((trees, 2))
        for r in found.groupBy("tree").agg(F.sum("n0"), F.sum("n1")).collect():
            out[r[0]] = r[1], r[2]
        return out

    def split_level(self, level: int, nodes: list[tuple[int, int, float, float]]) -> list[tuple[int, int, float, float]]:
        """Split ``nodes`` (tree, node, n0, n1) by scans; returns their children."""
        wanted = np.full(self.feature.shape, -1, np.int32)
        for j, (tree, node, _, _) in enumerate(nodes):
            wanted[tree, node] = j
        orders = [feature_order(self.seed, tree, node, self.width) for tree, node, _, _ in nodes]
        # First the features that every node looks at; nodes where those are constant look at all.
        looked = {j: order[: self.looked_at].tolist() for j, order in enumerate(orders)}
        best: dict[int, tuple] = {}
        # Open intervals: node, feature, smallest and largest value, class weights of the node below it.
        intervals: list[tuple] | None = None
        while intervals is None or intervals:
            found = self._scan(level, wanted, nodes, orders, best, intervals, looked).collect()
            if intervals is None:
                constant = [r["j"] for r in found if r["feature"] < 0]
                if constant:
                    looked = {j: orders[j].tolist() for j in constant}
                    bounds = self._bounds
                    found += self._scan(level, wanted, nodes, orders, best, None, looked).collect()
                    self._bounds |= bounds
            intervals = []
            for r in found:
                if r["feature"] < 0:
                    continue
                if r["open"]:
                    intervals.append((r["j"], r["feature"], r["low"], r["high"], r["l0"], r["l1"]))
                else:
                    place = orders[r["j"]].tolist().index(r["feature"])
                    new = (-r["gain"], place, r["low"], r["feature"], r["l0"], r["l1"])
                    best[r["j"]] = min(best.get(r["j"], new), new)
            # Bins left over from before the best split of this round was known.
            intervals = [i for i in intervals if self._worth(i, nodes, best)]
        children = []
        for j, (tree, node, n0, n1) in enumerate(nodes):
            gain, _, at, f, l0, l1 = best.get(j, (0.0,) * 6)
            if -gain <= LEAST_GAIN:
                self.lines.append(_line(tree, node, None, n0, n1))
                continue
            self.lines.append(_line(tree, node, (-gain, f, at), n0, n1))
            self.feature[tree, node], self.split[tree, node] = f, at
            children += [(tree, 2 * node, l0, l1), (tree, 2 * node + 1, n0 - l0, n1 - l1)]
        return children

    def _worth(self, interval: tuple, nodes: list[tuple], best: dict[int, tuple]) -> bool:
        return interval[0] not in best or self._bounds[interval[:3]] >= -best[interval[0]][0]

    def _scan(self, level, wanted, nodes, orders, best, intervals, looked) -> DataFrame:
        """One round over all rows: for each node its best split between bins and the bins to divide.

        Rows: j, open, feature, low, high, l0, l1, gain. A split has its place in ``low``; an open bin its
        ends, the weights below it and the most that a split inside could gain. Without ``intervals`` the
        features in ``looked`` (node -> features) are counted; a node where all of them are constant, while
        there are others, gives a row with feature -1.
        """
        met, width, edges, looked_at = self.met(level, wanted), self.width, self.edges, self.looked_at
        held: dict[tuple[int, int], list[tuple]] = {}
        for j, f, low, high, l0, l1 in intervals or []:
            held.setdefault((j, f), []).append((low, high, l0, l1))
        first = intervals is None
        # The cells that are counted: intervals of (node, feature), each in ``step`` bins.
        pairs = sorted((j, f) for j, fs in looked.items() for f in fs) if first else sorted(held)
        bins_of = BINS if first else max(4, min(BINS, MOST_CELLS // len(intervals)))
        step = bins_of + 1
        slot_of = np.full((len(nodes), width), -1, np.int64)
        for i, (j, f) in enumerate(pairs):
            slot_of[j, f] = i
        parts = [(j, f, i, *own) for j, f in pairs for i, own in enumerate([()] if first else sorted(held[j, f]))]
        part_slot = slot_of[[p[0] for p in parts], [p[1] for p in parts]] if parts else np.zeros(0, np.int64)
        part_feature = np.array([p[1] for p in parts], np.int64)
        part_number = np.array([p[2] for p in parts], np.int64)
        part_node = np.array([p[0] for p in parts], np.int64)
        if first:
            part_low = part_high = np.zeros(len(parts))
        else:
            part_low, part_high = (np.array([p[k] for p in parts], float) for k in (3, 4))
        start = _ordered(part_low).view(np.uint64)
        wide = (_ordered(part_high).view(np.uint64) - start) // np.uint64(bins_of) + np.uint64(1)
        # Intervals in the order of (node and feature, low), the lows as ranks among all of the feature.
        lows = [np.unique(part_low[part_feature == f]) for f in range(width)]
        most = max(map(len, lows), default=0) + 1
        rank = np.zeros(len(parts), np.int64)
        for f in range(width):
            own = part_feature == f
            rank[own] = np.searchsorted(lows[f], part_low[own], side="right")
        part_key = part_slot * most + rank

        def cells_of(x: np.ndarray, row: np.ndarray, slot: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
            """(which pairs of row and node count, their cells)."""
            values = x[:, f]
            if first:
                return np.arange(len(row)), slot * step + np.searchsorted(edges[f], values, side="left")[row]
            at = np.searchsorted(part_key, slot * most + np.searchsorted(lows[f], values, side="right")[row], side="right") - 1
            held_at = np.maximum(at, 0)
            inside = np.flatnonzero((at >= 0) & (part_slot[held_at] == slot) & (values[row] <= part_high[held_at]))
            at = at[inside]
            offset = (_ordered(values).view(np.uint64)[row[inside]] - start[at]) // wide[at]
            return inside, at * step + np.minimum(offset, np.uint64(bins_of)).astype(np.int64)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = len(parts) * step
            n0, n1 = np.zeros(cells), np.zeros(cells)  # sums of integers, exact in doubles
            low, high = np.full(cells, np.inf), np.full(cells, -np.inf)
            for x, row, label, _, weight, number in met(batches):
                for f in range(width):
                    slot = slot_of[number, f]
                    mine = np.flatnonzero(slot >= 0)
                    if not len(mine):
                        continue
                    inside, cell = cells_of(x, row[mine], slot[mine], f)
                    mine = mine[inside]
                    if not len(mine):
                        continue
                    # Weights of the pairs, by class; the cells of this feature only.
                    some, back = np.unique(cell, return_inverse=True) if len(mine) * 4 < cells else (None, cell)
                    size = cells if some is None else len(some)
                    ones = label[mine] * weight[mine]
                    for total, w in ((n1, ones), (n0, weight[mine] - ones)):
                        sums = np.bincount(back, w, size)
                        if some is None:
                            total += sums
                        else:
                            total[some] += sums
                    values = x[row[mine], f]
                    np.minimum.at(low, cell, values)
                    np.maximum.at(high, cell, values)
            met_cells = np.flatnonzero(low <= high)
            for a in range(0, len(met_cells), BATCH_ROWS):
                cell = met_cells[a : a + BATCH_ROWS]
                part, place = np.divmod(cell, step)
                columns = [part_node[part], part_feature[part], part_number[part] * step + place, n0[cell], n1[cell]]
                arrays = [pa.array(c.astype(np.int64)) for c in columns] + [pa.array(c[cell]) for c in (low, high)]
                yield pa.RecordBatch.from_arrays(arrays, ["j", "feature", "bin", "n0", "n1", "low", "high"])

        known = {j: (-b[0], b[1], b[2]) for j, b in best.items()}

        def decided(j: int, bins: dict[int, tuple]) -> Iterator[tuple]:
            """Lines of a node, from its bins by feature: bin, n0, n1, low, high."""
            _, _, n0, n1 = nodes[j]
            top, lines, opened, tried, varied = known.get(j, (-1.0, 0, 0.0))[0], [], [], 0, False
            for f in orders[j].tolist():
                tried += 1
                if f in bins:
                    number, w0, w1, low, high = bins[f]
                    own = sorted(held[j, f]) if not first else [(0.0, 0.0, 0.0, 0.0)]
                    part = np.zeros(len(number), np.int64) if first else number // step
                    for i, (_, _, b0, b1) in enumerate(own):
                        mine = np.flatnonzero(part == i)
                        if not len(mine):
                            continue
                        varied |= bool(low[mine[0]] < high[mine[-1]])
                        l0 = b0 + np.concatenate([[0], np.cumsum(w0[mine])])
                        l1 = b1 + np.concatenate([[0], np.cumsum(w1[mine])])
                        if len(mine) > 1:
                            found = gains(l0[1:-1], l1[1:-1], n0, n1)
                            k = int(found.argmax())
                            top = max(top, float(found[k]))
                            split = halfway(float(high[mine[k]]), float(low[mine[k + 1]]))
                            lines.append((j, False, f, split, 0.0, float(l0[k + 1]), float(l1[k + 1]), float(found[k])))
                        wide = np.flatnonzero(low[mine] < high[mine])
                        bound = np.maximum(gains(l0[wide + 1], l1[wide], n0, n1), gains(l0[wide], l1[wide + 1], n0, n1))
                        opened += [
                            (j, True, f, float(low[mine[k]]), float(high[mine[k]]), float(l0[k]), float(l1[k]), float(g))
                            for k, g in zip(wide.tolist(), bound.tolist(), strict=True)
                        ]
                if first and tried >= looked_at and varied:
                    break
            if first and not varied and len(looked[j]) < width:
                yield j, False, -1, 0.0, 0.0, 0.0, 0.0, 0.0
            yield from lines
            yield from (o for o in opened if o[-1] >= max(top, LEAST_GAIN))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def told(group: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
                j, f = int(columns[0][group[0]]), columns[1][group]
                bins = {int(g): tuple(c[group[f == g]] for c in columns[2:]) for g in np.unique(f)}
                return list(decided(j, bins))

            held_back: list[np.ndarray] | None = None
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if held_back is not None:
                    columns = [np.concatenate([a, b]) for a, b in zip(held_back, columns, strict=True)]
                if not len(columns[0]):
                    continue
                starts = np.flatnonzero(np.diff(columns[0], prepend=-1))
                lines = []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    lines += told(np.arange(a, b), columns)
                held_back = [c[starts[-1] :] for c in columns]
                yield from _batch(lines)
            if held_back is not None:
                yield from _batch(told(np.arange(len(held_back[0])), held_back))

        def _batch(lines: list[tuple]) -> Iterator[pa.RecordBatch]:
            if lines:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), *[pa.float64()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)],
                    ["j", "open", "feature", "low", "high", "l0", "l1", "gain"],
                )

        bins = (
            self.rows.mapInArrow(counted, "j long, feature long, bin long, n0 long, n1 long, low double, high double")
            .groupBy("j", "feature", "bin")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        found = (
            bins.repartition("j").sortWithinPartitions("j", "feature", "bin")
            .mapInArrow(chosen, "j long, open boolean, feature long, low double, high double, l0 double, l1 double, gain double")
        )
        found = stage(found, "splits")
        self._bounds = {
            (r["j"], r["feature"], r["low"]): r["gain"] for r in found.where("open").select("j", "feature", "low", "gain").collect()
        }
        return found

    def below(self, level: int, nodes: list[tuple[int, int, float]]) -> DataFrame:
        """All nodes at and below the small ``nodes`` (tree, node, weight), each grown by one task."""
        wanted = np.full(self.feature.shape, -1, np.int32)
        for j, (tree, node, _) in enumerate(nodes):
            wanted[tree, node] = j
        places = np.array([(tree, node) for tree, node, _ in nodes], np.int64)
        met, width = self.met(level, wanted), self.width
        depth, looked_at, seed = self.depth, self.looked_at, self.seed
        packed = ["label", "weight", *[f"x{i}" for i in range(width)]]
        few = np.int16 if len(nodes) < 1 << 15 else np.int32  # short numbers are sorted by radix

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, row, label, _, weight, number in met(batches):
                order = np.argsort(number.astype(few), kind="stable")
                number = number[order]
                starts = np.flatnonzero(np.diff(number, prepend=-1))
                ends = [*starts[1:].tolist(), len(order)]
                whole = [label[order].astype(np.uint8), weight[order].astype(np.uint8)]
                for column in x.T:
                    with np.errstate(invalid="ignore"):
                        short = column.astype(np.int32)  # half the bytes where it says the same
                    column = short if (short == column).all() else column
                    whole.append(column[row[order]])
                columns = [pa.array([c[a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)], pa.binary()) for c in whole]
                at = places[number[starts]]
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), *columns], ["tree", "node", *packed])

        names = [n.split()[0] for n in NODE_SCHEMA.split(", ")]
        kinds = [pa.int32() if " int" in n else pa.float64() for n in NODE_SCHEMA.split(", ")]

        def unpacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            label, weight, *x = ([v.as_buffer() for b in parts for v in b.column(c)] for c in packed)
            sizes = [v.size for v in label]
            values = np.empty((width, sum(sizes)))
            for own, column in zip(values, x, strict=True):
                at = 0
                for n, v in zip(sizes, column, strict=True):
                    own[at : at + n] = np.frombuffer(v, np.int32 if v.size == 4 * n else np.float64)
                    at += n
            return values.T, *(np.concatenate([np.frombuffer(v, np.uint8) for v in c]).astype(float) for c in (label, weight))

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
                tree, node = (parts[0].column(c)[0].as_py() for c in (0, 1))
                lines = grow_below(*unpacked(parts), tree, node, depth, looked_at, seed)
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names
                )

            parts, last = [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy() * (2 << depth) + batch.column(1).to_numpy()
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
                    if own[a] != last and parts:
                        yield one(parts)
                        parts = []
                    last = own[a]
                    parts.append(batch.slice(a, b - a))
            if parts:
                yield one(parts)

        schema = ", ".join(["tree long, node long", *[f"{c} binary" for c in packed]])
        # Tasks by the rows that they get, whatever the bytes look like to adaptive execution.
        total = sum(n for _, _, n in nodes)
        tasks = min(len(nodes), max(self.rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_WEIGHT)))
        return (
            self.rows.mapInArrow(dealt, schema)
            .repartition(tasks, "tree", "node")
            .sortWithinPartitions("tree", "node")
            .mapInArrow(grown, NODE_SCHEMA)
        )


def grow_forest(
    rows: DataFrame, key: str, label: str, features: Sequence[str], trees: int, depth: int, seed: int,
    looked_at: int | None = None,
) -> Forest:
    """A forest grown from ``rows``: long ``key``, ``label`` 0 or 1, ``features`` without nulls.

    A node looks at ``looked_at`` features, the root of their number by default, and is split where the
    Gini gain is largest; nodes of one class or at ``depth`` (at most 16) are leaves. ``rows`` is read
    once per round and should be staged. No rows give trees of one node without weight.
    """
    if not 0 <= depth <= 16:
        raise ValueError(f"depth {depth} is not within 0 to 16")
    growing = _Growing(rows, key, label, features, trees, depth, looked_at or max(1, int(math.sqrt(len(features)))), seed)
    spark = rows.sparkSession
    level, nodes, small = 0, [(t, 1, *n) for t, n in enumerate(growing.totals().tolist())], []
    while nodes:
        large = []
        for node in nodes:
            tree, place, n0, n1 = node
            if n0 + n1 <= LOCAL_WEIGHT and n0 + n1 > 0:
                small.append((tree, place, n0 + n1))
            elif level == depth or n0 == 0 or n1 == 0:
                growing.lines.append(_line(tree, place, None, n0, n1))
            else:
                large.append(node)
        nodes = growing.split_level(level, large) if large else []
        level += 1
    top = spark.createDataFrame(growing.lines, NODE_SCHEMA)
    nodes = top.union(growing.below(level, small)) if small else top
    return Forest(stage(nodes, "forest"), trees, depth, root=1)
