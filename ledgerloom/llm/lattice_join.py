"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to DIMS dimensions per table, eight at a time, and each eight are
decoded to the nearest point of the E8 lattice; the points of a table name its cell. A vector also
looks into neighbouring cells: those where one of its lattice points is replaced by one of the
PROBES nearest of the 240 around it. Two vectors meet if one is at home in a cell that the other has
or looks into, in any of TABLES tables; what meets is verified by its cosine in double precision.

Groups of near copies would meet as all pairs. So vectors are gathered to balls first: copies are one
vector with a size, and vectors of one cell that lie within half the wanted angle of a common center
are one ball, whose members are linked to each other by the triangle inequality. Balls meet in
place of vectors. From the angle of their centers and their radii a pair of balls is linked as a
whole, not at all, or opened and compared member by member. Links are counted and never listed:
a ball is connected in itself, so one link between two balls joins all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.skew import attach_per_key
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import mix
from ledgerloom.session import stage

COSINE = 0.95
#: A pair of cosine 0.95 meets in a table with a chance of 0.62, so it is missed with one of 6e-5.
TABLES = 10
BLOCKS = 2
PROBES = 4
#: Width of a lattice cell where projections have variance 1.
WIDTH = 2.0
#: Rows of one side of a block of comparisons.
SLICE_ROWS = 1024
#: Another round of gathering is made while it lowers the number of balls by this share.
WORTH = 0.05
#: More than double rounding of a cosine can move an angle near the wanted one.
EPSILON = 1e-7
_SEED = 8


def _roots() -> np.ndarray:
    """The 240 shortest points of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for one, two in itertools.product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = one, two
            found.append(row)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(found)


ROOTS = _roots()


def nearest_e8(points: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice point to each row of 8: integers of even sum, or those plus a half."""

    def even(x: np.ndarray) -> np.ndarray:
        whole = np.rint(x)
        gap = x - whole
        rows = np.flatnonzero(whole.sum(axis=1) % 2)
        worst = np.abs(gap[rows]).argmax(axis=1)
        whole[rows, worst] += np.where(gap[rows, worst] >= 0, 1.0, -1.0)
        return whole

    one, two = even(points), even(points - 0.5) + 0.5
    nearer = ((points - one) ** 2).sum(axis=1) <= ((points - two) ** 2).sum(axis=1)
    return np.where(nearer[:, None], one, two)


def projection(dims: int) -> np.ndarray:
    """The fixed random projection of vectors of ``dims`` components, dims x (TABLES x BLOCKS x 8)."""
    return np.random.default_rng([_SEED, dims]).standard_normal((dims, TABLES * BLOCKS * 8)) / WIDTH


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    """64 bits for each row of lattice coordinates."""
    with np.errstate(over="ignore"):
        h = np.full(len(points), np.uint64(salt + 1))
        for column in (2 * points).astype(np.int64).view(np.uint64).T:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def cells(units: np.ndarray) -> np.ndarray:
    """n x TABLES x (1 + BLOCKS * PROBES) cells of unit vectors (n x dims), the home cell first."""
    n, dims = units.shape
    at = (units @ projection(dims)).reshape(n, TABLES, BLOCKS, 8)
    out = np.zeros((n, TABLES, 1 + BLOCKS * PROBES), np.uint64)
    for t in range(TABLES):
        own, others = [], []
        for b in range(BLOCKS):
            salt = (dims << 16) + t * BLOCKS + b
            point = nearest_e8(at[:, t, b])
            # Of neighbours point + r the nearest are those with the largest product of rest and r.
            toward = np.argpartition(-((at[:, t, b] - point) @ ROOTS.T), PROBES, axis=1)[:, :PROBES]
            own.append(_name(point, salt))
            others.append([_name(point + ROOTS[toward[:, p]], salt) for p in range(PROBES)])
        with np.errstate(over="ignore"):
            total = sum(own)
            out[:, t, 0] = total
            for b in range(BLOCKS):
                for p in range(PROBES):
                    out[:, t, 1 + b * PROBES + p] = total - own[b] + others[b][p]
    return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(one @ two.T, -1.0, 1.0))


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, empty or zero, no null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches in which the lists of ``column`` have one length each."""
    for batch in batches:
        sizes = np.asarray(batch.column(column).value_lengths(), np.int64)
        for size in np.unique(sizes):
            yield batch.filter(pa.array(sizes == size))


def _unit_vectors(rows: DataFrame) -> DataFrame:
    """(node, at, size, smallest) of ``rows`` (node, x, vec_id): a row per different vector."""
    classes = rows.groupBy("node").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("smallest")
    )

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches, "x"):
            x = _matrix(batch.column("x"))
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            at = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            columns = [batch.column("node"), at, batch.column("size"), batch.column("smallest")]
            yield pa.RecordBatch.from_arrays(columns, ["node", "at", "size", "smallest"])

    return classes.mapInArrow(scaled, "node binary, at array<double>, size long, smallest long")


def _gathered(balls: DataFrame, reach: float) -> DataFrame:
    """(ball, into, center, spread): each ball (ball, at, radius) gets into one, possibly its own.

    Balls of one cell are laid side by side, in runs of SLICE_ROWS at most. In a run the first ball left
    takes those whose whole lies within ``reach`` of the mean of what lies within ``reach`` of it.
    """

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches, "at"):
            if batch.num_rows:
                home = pa.array(cells(_matrix(batch.column("at")))[:, 0, 0])
                yield pa.RecordBatch.from_arrays([home, *batch.columns], ["home", "ball", "at", "radius"])

    def taken(at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(at)
        into, center, spread = np.arange(n), at.copy(), radius.copy()
        left = np.ones(n, bool)
        while left.any():
            seed = int(left.argmax())
            rows = np.flatnonzero(left)
            near = rows[_angles(at[rows], at[seed : seed + 1])[:, 0] + radius[rows] <= reach]
            members, middle = np.array([seed]), at[seed]
            if len(near) > 1:
                mean = at[near].sum(axis=0)
                mean /= np.sqrt(mean @ mean)
                wide = _angles(at[near], mean[None])[:, 0] + radius[near] + EPSILON
                if wide[near == seed].max(initial=np.inf if seed not in near else 0.0) <= reach:
                    members, middle, width = near[wide <= reach], mean, wide[wide <= reach].max()
            if len(members) > 1:
                into[members], center[members], spread[members] = seed, middle, width
            left[members] = False
        return into, center, spread

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                home = part.column(0).to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
                ids, at_column, radii = part.column(1), part.column(2), part.column(3).to_numpy()
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    whole = at_column.slice(a, b - a)
                    if b - a == 1:
                        columns = [ids.slice(a, 1), ids.slice(a, 1), whole, part.column(3).slice(a, 1)]
                    else:
                        into, center, spread = taken(_matrix(whole), radii[a:b])
                        flat = pa.FixedSizeListArray.from_arrays(pa.array(center.ravel()), center.shape[1])
                        columns = [
                            ids.slice(a, b - a), ids.slice(a, b - a).take(pa.array(into)),
                            flat.cast(pa.list_(pa.float64())), pa.array(spread),
                        ]
                    yield pa.RecordBatch.from_arrays(columns, ["ball", "into", "center", "spread"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if len(held) == 1024:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    laid = (
        balls.select("ball", "at", "radius")
        .mapInArrow(homed, "home long, ball binary, at array<double>, radius double")
        .repartitionByRange("home", "ball")
        .sortWithinPartitions("home", "ball")
    )
    return laid.mapInArrow(
        lambda batches: merged(runs(batches)), "ball binary, into binary, center array<double>, spread double"
    )


def _balls(vectors: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """(members, balls) of ``vectors`` (node, at, ...): vectors with their ball, and (ball, at, radius)."""
    balls = vectors.select(F.col("node").alias("ball"), "at", F.lit(0.0).alias("radius"))
    members, count = vectors.withColumn("ball", F.col("node")), balls.count()
    while True:
        into = stage(_gathered(balls, reach), "gathered")
        found = into.filter("ball = into").select("ball", F.col("center").alias("at"), F.col("spread").alias("radius"))
        fewer = found.count()
        if fewer < count:
            members = members.join(into.select("ball", "into"), "ball").drop("ball").withColumnRenamed("into", "ball")
        if fewer >= count * (1 - WORTH):
            return stage(members, "members"), stage(found, "balls")
        balls, count = found, fewer


def _attach(rows: DataFrame, key: str, values: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the one row of ``values`` with the same ``key``; keys may be hot."""
    empty = [F.lit(None).cast(values.schema[c].dataType).alias(f"_{c}") for c in columns]
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != key]
    both = rows.select(*rows.columns, F.lit(True).alias("_own"), *empty).unionByName(
        values.select(key, *blank, F.lit(False).alias("_own"), *[F.col(c).alias(f"_{c}") for c in columns])
    )
    found = attach_per_key(both, key, {c: F.max(f"_{c}") for c in columns})
    return found.filter("_own").drop("_own", *[f"_{c}" for c in columns])


def _in_blocks(rows: DataFrame, key: list[str], size: Column, by: Column) -> DataFrame:
    """``rows`` of a key of ``size`` rows, dealt into slices, once for each pair of slices."""
    slices = F.ceil(size / SLICE_ROWS).cast("int")
    return (
        rows.withColumn("_slice", F.pmod(F.xxhash64(by, F.lit(7)), slices).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), slices - 1)))
        .withColumns({"one": F.least("_slice", "_other"), "two": F.greatest("_slice", "_other")})
        .withColumn("first", F.col("_slice") == F.col("one"))
        .drop("_other")
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = list(zip(*[batch.column(i).to_pylist() for i in range(keys)], strict=True))
        start = 0
        for i, name in enumerate(named):
            if name != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, start = [], name, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _meetings(members: DataFrame, balls: DataFrame, wanted: float) -> DataFrame:
    """(a, b, whole): pairs of balls that meet and may hold links; ``whole`` if all their pairs are links."""
    angle = float(np.arccos(wanted))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches, "at"):
            if not batch.num_rows:
                continue
            found = cells(_matrix(batch.column("at")))
            wide = found.shape[1] * found.shape[2]
            home = np.zeros(found.shape, bool)
            home[:, :, 0] = True
            ball = batch.column("ball").take(pa.array(np.repeat(np.arange(len(found)), wide)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel()), ball, pa.array(home.ravel())], ["cell", "ball", "home"]
            )

    seen = members.select("ball", "at").mapInArrow(entries, "cell long, ball binary, home boolean")
    seen = stage(seen.groupBy("cell", "ball").agg(F.max("home").alias("home")), "cells")
    met = attach_per_key(seen, "cell", {"balls": F.count(F.lit(1)), "homes": F.count_if("home")})
    dealt = _in_blocks(met.filter("balls > 1 AND homes > 0"), ["cell"], F.col("balls"), F.col("ball"))
    dealt = dealt.select("cell", "one", "two", "first", "home", "ball").join(balls, "ball")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for group in _whole_groups(batches, 3):
            first, home = (group.column(c).to_numpy(zero_copy_only=False) for c in ("first", "home"))
            same = group.column("one")[0] == group.column("two")[0]
            left = np.flatnonzero(first)
            right = left if same else np.flatnonzero(~first)
            if not len(left) or not len(right):
                continue
            at, radius = _matrix(group.column("at").combine_chunks()), group.column("radius").to_numpy()
            cosine = at[left] @ at[right].T
            apart = np.arccos(np.clip(cosine, -1.0, 1.0))
            spread = radius[left][:, None] + radius[right][None]
            single = spread == 0
            near = np.where(single, cosine >= wanted, apart <= angle + spread + EPSILON)
            near &= home[left][:, None] | home[right][None]
            if same:
                near &= np.tri(len(left), k=-1, dtype=bool)
            i, j = near.nonzero()
            if not len(i):
                continue
            whole = single[i, j] | (apart[i, j] + spread[i, j] <= angle - EPSILON)
            names = group.column("ball").combine_chunks()
            a, b = names.take(pa.array(left[i])).to_pylist(), names.take(pa.array(right[j])).to_pylist()
            ordered = [(x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True)]
            made.append(
                pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in ordered], pa.binary()), pa.array([p[1] for p in ordered], pa.binary()), pa.array(whole)],
                    ["a", "b", "whole"],
                )
            )
            if len(made) == 256:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made = []
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    blocks = ["cell", "one", "two"]
    return (
        dealt.repartition(*blocks)
        .sortWithinPartitions(*blocks)
        .select(*blocks, "first", "home", "ball", "at", "radius")
        .mapInArrow(compared, "a binary, b binary, whole boolean")
        .groupBy("a", "b")
        .agg(F.max("whole").alias("whole"))
    )


def _opened(pairs: DataFrame, members: DataFrame, sizes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, node, links) for vectors of ``pairs`` (a, b) of balls that have links in the other ball."""
    known = sizes.select("ball", "n")
    sided = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("ball")).join(known, "ball")
    # Slices of the larger ball set the number of blocks; both are dealt into as many.
    n = F.max("n")
    counted = sided.groupBy("a", "b").agg(n.alias("n"))
    dealt = _in_blocks(
        counted.select("a", "b", "n", F.explode(F.array("a", "b")).alias("ball")).join(
            members.select("ball", "node", "at", "size"), "ball"
        ),
        ["a", "b"], F.col("n"), F.col("node"),
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, 4):
            at, size = _matrix(group.column("at").combine_chunks()), group.column("size").to_numpy()
            of_a = np.array([x == y for x, y in zip(group.column("ball").to_pylist(), group.column("a").to_pylist(), strict=True)])
            first = group.column("first").to_numpy(zero_copy_only=False)
            if group.column("one")[0] == group.column("two")[0]:
                sides = [(of_a, ~of_a)]
            else:
                sides = [(of_a & first, ~of_a & ~first), (of_a & ~first, ~of_a & first)]
            links = np.zeros(len(at), np.int64)
            for left, right in sides:
                left, right = np.flatnonzero(left), np.flatnonzero(right)
                if len(left) and len(right):
                    near = at[left] @ at[right].T >= cosine
                    links[left] += near @ size[right]
                    links[right] += size[left] @ near
            hit = np.flatnonzero(links)
            if len(hit):
                columns = [group.column(c).combine_chunks().take(pa.array(hit)) for c in ("a", "b", "node")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(links[hit])], ["a", "b", "node", "links"])

    blocks = ["a", "b", "one", "two"]
    return (
        dealt.repartition(*blocks)
        .sortWithinPartitions(*blocks)
        .select(*blocks, "first", "ball", "node", "at", "size")
        .mapInArrow(compared, "a binary, b binary, node binary, links long")
    )


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors; vectors are linked from ``cosine`` on.

    n_links counts the other vectors linked directly, copies included; component_id is the smallest
    vec_id reachable by links; kept marks it. ``cosine`` is positive. A vector that is null, empty or
    zero or holds null or non-finite components links with nothing, nor do vectors of different
    lengths. Rows without vec_id go, repeated rows count once; an id with several vectors gives a row
    for each, and kept holds for all of them that have their own id as component. Other columns are ignored.
    """
    angle = float(np.arccos(cosine))
    plain = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")
    ).filter("vec_id IS NOT NULL")
    text = F.concat_ws(",", F.transform("x", lambda v: F.coalesce((v + F.lit(0.0)).cast("string"), F.lit("-"))))
    digest = F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("none")), 256), 1, 32))
    rows = stage(
        plain.select("vec_id", digest.alias("node"), F.when(usable(F.col("x")), F.col("x")).alias("x")).dropDuplicates(
            ["vec_id", "node"]
        ),
        "vectors",
    )
    units = stage(_unit_vectors(rows.filter("x IS NOT NULL")), "units")
    members, balls = _balls(units, angle / 2 - EPSILON)
    sizes = stage(
        members.groupBy("ball").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("smallest").alias("smallest")
        ),
        "sizes",
    )
    pairs = stage(_meetings(members, balls, cosine), "meetings")
    opened = stage(_opened(pairs.filter("NOT whole").select("a", "b"), members, sizes, cosine), "opened")
    joined = pairs.filter("whole").select("a", "b")
    both = joined.union(joined.select("b", "a")).toDF("ball", "other")
    known = sizes.select(F.col("ball").alias("other"), F.col("size").alias("there"))
    by_ball = both.join(known, "other").groupBy("ball").agg(F.sum("there").alias("whole_links"))
    by_node = opened.groupBy("node").agg(F.sum("links").alias("open_links"))
    links = joined.union(opened.select("a", "b").distinct())
    roots = connected_components(links, "a", "b").select(F.col("node").alias("ball"), "root")
    placed = sizes.join(by_ball, "ball", "left").join(roots, "ball", "left").select(
        "ball", "size", "smallest", F.coalesce("whole_links", F.lit(0)).alias("whole_links"),
        F.coalesce("root", "ball").alias("root"),
    )
    placed = attach_per_key(stage(placed, "placed"), "root", {"component_id": F.min("smallest")})
    known = _attach(members.select("node", "ball"), "ball", placed, ["size", "whole_links", "component_id"])
    known = known.join(by_node, "node", "left").select(
        "node", "component_id",
        (F.col("size") - 1 + F.col("whole_links") + F.coalesce("open_links", F.lit(0))).alias("n_links"),
    )
    found = _attach(rows.select("vec_id", "node"), "node", stage(known, "known"), ["component_id", "n_links"])
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )


OP11_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(b) AS component_id, min(b) = a AS kept
FROM r GROUP BY a
"""


@query("op11_lattice_join", OP11_SQL)
def _op11(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
