"""Product codes of integer vectors; nearest codebook entries are found with a GNAT.

A vector is cut into equal parts and each part is replaced by the index of its nearest codebook
entry. Codebooks are fixed in size (parts x entries x part width integers), so they go to every
task; vectors only ever stream through tasks, and what returns from a round is one row per part
and entry, summed up by Spark.

The entries of a codebook are held in a geometric near-neighbour access tree: a node has split
points, every other entry belongs to its nearest split point, and the node stores for each split
point i and child j the range of distances from i to what is in j. A query whose distance to i
and best distance so far show that nothing in j can be as near drops the whole child. Ranges and
distances are integers (squares); roots are rounded away from dropping and the comparison is
strict, so an entry as near as the best one always gets to the comparison by (distance, index).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.skew import attach_per_key
from ledgerloom.llm.registry import query, table
from ledgerloom.session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Larger integers could make squared distances leave 64 bits; such vectors are left out.
LARGEST = 1 << 26
#: Split points of a node, and entries below which a node is a plain list.
DEGREE = 6
LEAF = 4
_SLACK = 2.0**-48


def _below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - _SLACK)


def _above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + _SLACK)


def _squares(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``one`` (n x w) and ``two`` (m x w), n x m."""
    total = np.zeros((len(one), len(two)), np.int64)
    for d in range(one.shape[1]):
        gap = one[:, d, None] - two[None, :, d]
        total += gap * gap
    return total


@dataclass
class Gnat:
    """A tree over the rows ``own`` of ``entries`` (m x w integers)."""

    entries: np.ndarray
    own: np.ndarray
    splits: np.ndarray = field(init=False)
    children: list[Gnat | None] = field(init=False)
    #: Squared distances from split point i (row) to the nearest and farthest of child j (column).
    nearest_of: np.ndarray = field(init=False)
    farthest_of: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if len(self.own) <= max(LEAF, DEGREE):
            self.splits, self.children = self.own, []
            return
        # Split points far from each other: each is the farthest from those before.
        chosen = [0]
        away = _squares(self.entries[self.own], self.entries[self.own[:1]])[:, 0]
        while len(chosen) < DEGREE:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, _squares(self.entries[self.own], self.entries[self.own[chosen[-1:]]])[:, 0])
        chosen = sorted(set(chosen))
        self.splits = self.own[chosen]
        rest = np.delete(self.own, chosen)
        apart = _squares(self.entries[self.splits], self.entries[rest])
        home = apart.argmin(axis=0)
        k = len(chosen)
        self.children, self.nearest_of, self.farthest_of = [], np.zeros((k, k), np.int64), np.zeros((k, k), np.int64)
        for j in range(k):
            mine = home == j
            if not mine.any():
                self.children.append(None)
                continue
            self.nearest_of[:, j] = apart[:, mine].min(axis=1)
            self.farthest_of[:, j] = apart[:, mine].max(axis=1)
            self.children.append(Gnat(self.entries, rest[mine]))

    def search(self, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Lower ``best`` (squares) and ``index`` of ``rows`` of ``parts``; returns the distances taken."""
        apart = _squares(parts[rows], self.entries[self.splits])
        for j, entry in enumerate(self.splits):
            nearer = (apart[:, j] < best[rows]) | ((apart[:, j] == best[rows]) & (entry < index[rows]))
            best[rows[nearer]], index[rows[nearer]] = apart[nearer, j], entry
        taken = apart.size
        if not self.children:
            return taken
        low, high = _below(apart), _above(apart)
        home = apart.argmin(axis=1)
        # The child of the nearest split point first: a small best distance drops more of the others.
        for at_home in (True, False):
            for j, child in enumerate(self.children):
                if child is None:
                    continue
                open_rows = np.flatnonzero((home == j) == at_home)
                reach = _above(best[rows[open_rows]])[:, None]
                past = low[open_rows] > (_above(self.farthest_of[:, j])[None, :] + reach) * (1 + _SLACK)
                short = (high[open_rows] + reach) * (1 + _SLACK) < _below(self.nearest_of[:, j])[None, :]
                open_rows = open_rows[~(past | short).any(axis=1)]
                if len(open_rows):
                    taken += child.search(parts, rows[open_rows], best, index)
        return taken


def nearest_entries(tree: Gnat, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, index) of the nearest entry to each row; the lower index on ties."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(tree.entries), np.int64)
    if len(parts):
        tree.search(parts, np.arange(len(parts)), best, index)
    return best, index


def trees_of(codebooks: np.ndarray) -> list[Gnat]:
    return [Gnat(entries, np.arange(len(entries))) for entries in codebooks]


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int) -> DataFrame:
    """(vec_id, label, q) of the vectors that can be coded, q = floor(SCALE x) of each component.

    Left out: vectors that are null or empty, hold a null or non-finite component or one beyond
    LARGEST / SCALE, or have a length that ``parts`` does not divide.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(embedding).cast("array<double>").alias("x"),
    ).filter(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(lists.value_lengths(), np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            bad = ~(np.abs(x) <= LARGEST)  # also where x is NaN, as nulls are
            ends = np.cumsum(sizes)
            before = np.concatenate([[0], np.cumsum(bad)])
            good = before[ends] == before[ends - sizes]
            kept = np.repeat(good, sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            q = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[kept].astype(np.int32)))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), q], names)

    names = ["vec_id", "label", "q"]
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(floors, f"vec_id long, label {kind}, q array<int>")


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """n x parts x width integers of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def _sums(rows: DataFrame, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, componentwise sum) of the parts nearest to each entry."""
    parts, entries, width = codebooks.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = trees_of(codebooks)
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            own = _parts(batch.column(0), parts)
            for p, tree in enumerate(trees):
                _, index = nearest_entries(tree, own[:, p])
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, own[:, p])
        p, e = count.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    found = (
        rows.select("q")
        .mapInArrow(partial, "part long, entry long, n long, total array<long>")
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
        .collect()  # at most parts x entries rows
    )
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for r in found:
        count[r[0], r[1]], total[r[0], r[1]] = r[2], r[3:]
    return count, total


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of ``rows`` (vec_id, q), all q of one length.

    They start as the parts of the smallest vec_ids (then the smallest q, ids null last); each
    round replaces an entry by the floor of the mean of its parts. An entry without parts stays.
    """
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    codebooks = np.asarray([r["q"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        count, total = _sums(rows, codebooks)
        codebooks = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], codebooks)
    return codebooks


def encode_vectors(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``rows`` (vec_id, label, q): indexes in hex, summed squares."""
    parts = len(codebooks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = trees_of(codebooks)
        for batch in batches:
            own = _parts(batch.column(2), parts)
            error, codes = np.zeros(len(own), np.int64), np.zeros((len(own), parts), np.uint8)
            for p, tree in enumerate(trees):
                best, codes[:, p] = nearest_entries(tree, own[:, p])
                error += best
            text = codes.tobytes().hex()
            text = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "q").mapInArrow(
        coded, f"vec_id long, label {kind}, code string, error long"
    )


def compress_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of all vectors that can be coded, and the codebooks.

    ``entries`` is at most 256, two hex digits. ``label_error`` sums ``error`` over equal labels,
    nulls together. Vectors are left out as in ``integer_vectors``, and where their length is not
    that of the smallest id's. Rows with a null id are coded as well; repeated rows are coded each
    and count each. A table without such vectors gives no rows. Other columns are ignored.
    """
    rows = stage(integer_vectors(vectors, vec_id, embedding, label, parts), "integers")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "q").select(F.size("q")).first()
    rows = rows.filter(F.size("q") == (first[0] if first else 0))
    codebooks = fit_codebooks(rows, parts, entries, rounds) if first else np.zeros((parts, 0, 0), np.int64)
    coded = stage(encode_vectors(rows, codebooks), "codes")
    # Text, so that nulls and NaN are keys like others.
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    return attach_per_key(keyed, "key", {"label_error": F.sum("error")}).drop("key"), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """Every distance to every entry, in exact doubles."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding,
  lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, t.part, q[part * len(q) // {parts} + 1 : (part + 1) * len(q) // {parts}] AS v
  FROM k, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p
  QUALIFY e < {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS v, min(d) AS d, arg_min(e, d * {entries} + e) AS e
  FROM (SELECT p.vec_id, part, p.v AS x, b.e, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v)
    + list_inner_product(b.v, b.v) AS d FROM p JOIN b{i} b USING (part)) GROUP BY vec_id, part)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} AS (SELECT part, e, list(m ORDER BY i) AS v FROM (SELECT part, e, i, floor(sum(v[i]) / count(*)) AS m
  FROM a{i}, range(1, 1 + (SELECT max(len(v)) FROM p)) t(i) GROUP BY part, e, i) GROUP BY part, e),
b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (part, e))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ','
  ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY part) AS code,
  CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h"""
    )


OP12_SQL = _sql()


@query("op12_vector_codes", OP12_SQL)
def _op12(spark, folder):
    coded, codebooks = compress_vectors(table(spark, folder, "embeddings"))
    return coded.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
