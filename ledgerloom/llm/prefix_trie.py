"""Trie of conversation prefixes, with subtree sums by centroid decomposition.

A node is a distinct sequence of first turns. Its identity is a polynomial hash (modulo 2^127 - 1)
of 128-bit turn digests, so a prefix hash of a conversation that is cut over many tasks is put
together from the pieces of those tasks: no task needs to hold a conversation, however long.

Sums over subtrees are made on the forest of parent edges. Each component is split at its centroid:
the deepest node whose subtree, within the component, has more than half of its weight. As weights
count conversations passing through, a node's weight is known from one aggregate and the nodes
above half are exactly the path from the centroid to the component's top. The total below the
centroid is added along this path, then the centroid goes and what remains are components of half
the weight at most: one above, one per child. Which child a node is under is read from any
conversation passing through both. So depth does not matter: rounds grow with the logarithm of the
weight, and components of a bounded weight are finished in one task each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.skew import attach_per_key
from ledgerloom.llm.registry import query, table
from ledgerloom.session import stage

#: Every fifth conversation lends its first turns to itself and the four after it.
FAMILY = 5
#: The number of lent turns is a hash modulo this.
LENT = 9
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"turn").digest()[:15], "big")
_ROOT = 1
#: Components of less weight are finished by one task; at most MOST_OPEN heavier ones exist.
TASK_WEIGHT = 1 << 13
MOST_OPEN = 1 << 16
#: Rows of components that a task works on at a time, and ids hashed at a time.
BLOCK_ROWS = 1 << 15
PIECE_IDS = 1 << 13


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def typed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) typed, nulls of role and text empty; rows without conv_id go."""
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")


def _in_order(rows: DataFrame, deal: list, sort: list, kept: list[str]) -> DataFrame:
    """``rows`` range-partitioned so that any conversation may span tasks, with the place in its task.

    Returns ``kept`` (conv_id first), task, place (from 0 at each start of a conversation in a task)
    and, where ``kept`` has a digest ``t``, the hashes ``node`` and ``parent`` of the task's part of it.
    """
    chained = "t" in kept
    keep = [k for k in kept if k != "t"] if chained else kept

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, count, h = None, 0, _ROOT
        for batch in batches:
            conv = batch.column(0).to_numpy()
            n = len(conv)
            if not n:
                continue
            start = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            since = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            place = np.where(since < 0, count + np.arange(n), np.arange(n) - since)
            columns = [batch.column(k) for k in keep]
            columns += [pa.array(np.full(n, task, np.int64)), pa.array(place.astype(np.int64))]
            if chained:
                nodes, parents = [], []
                for fresh, t in zip(start.tolist(), batch.column("t").to_pylist(), strict=True):
                    h = _ROOT if fresh else h
                    parents.append(_bytes(h))
                    h = (h * _BASE + int.from_bytes(t, "big")) % _PRIME
                    nodes.append(_bytes(h))
                columns += [pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())]
            last, count = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = {k: kinds[k] for k in keep} | {"task": "bigint", "place": "bigint"}
    if chained:
        made |= {"node": "binary", "parent": "binary"}
    names = list(made)
    laid = rows.repartitionByRange(*deal).sortWithinPartitions(*sort).select(*kept)
    return laid.mapInArrow(placed, ", ".join(f"{k} {v}" for k, v in made.items()))


def _carried(staged: DataFrame, chained: bool) -> list[tuple]:
    """(task, conv_id, place, hash) with which a task's first conversation goes on; a row per task at most."""
    last = F.struct("conv_id", "place", "node") if chained else F.struct("conv_id", "place")
    ends = staged.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(last).alias("last")).collect()
    carries, conv, places, h = [], None, 0, _ROOT
    for r in sorted(ends, key=lambda r: r["task"]):
        own, place = r["last"]["conv_id"], r["last"]["place"] + 1
        own_hash = int.from_bytes(r["last"]["node"], "big") if chained else _ROOT
        if r["first"] == conv:
            carries.append((r["task"], conv, places, _bytes(h)))
            if own == conv:
                own_hash = (own_hash + (h - _ROOT) * pow(_BASE, place, _PRIME)) % _PRIME
                place += places
        conv, places, h = own, place, own_hash
    return carries


def _continued(staged: DataFrame, chained: bool) -> DataFrame:
    """``staged`` with places, and hashes where ``chained``, counted from the start of conversations."""
    carries = _carried(staged, chained)
    carry = staged.sparkSession.createDataFrame(carries, "task long, conv_id long, before long, h binary")
    rows = staged.join(F.broadcast(carry), ["task", "conv_id"], "left")
    if not chained:
        return rows.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("task", "before", "h")
    columns = [c for c in staged.columns if c != "task"]

    def gone_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.to_pydict()
            for name, turns in (("node", 1), ("parent", 0)):
                held[name] = [
                    _bytes(
                        (int.from_bytes(own, "big") + (int.from_bytes(h, "big") - _ROOT) * pow(_BASE, p + turns, _PRIME))
                        % _PRIME
                    )
                    for own, h, p in zip(held[name], held["h"], held["place"], strict=True)
                ]
            held["place"] = [p + b for p, b in zip(held["place"], held["before"], strict=True)]
            yield pa.RecordBatch.from_pydict({c: held[c] for c in columns}, batch.select(columns).schema)

    schema = staged.select(*columns).schema
    moved = rows.filter("before IS NOT NULL").select(*columns, "before", "h").mapInArrow(gone_on, schema)
    return rows.filter("before IS NULL").select(*columns).union(moved)


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation with its first turns taken from another one.

    Conversation c starts with the first h turns of conversation c - c % family, h = crc32(c) % lent;
    its own turns after its first h follow. Returns (conv_id, part, place, t, bytes) in which (part,
    place) is the order and t the digest of (role, text), and (conv_id) of all conversations.
    """
    rows = typed_turns(turns).select(
        "conv_id",
        "turn",
        F.concat("role", F.lit("\0"), "text").alias("said"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.octet_length("role").alias("split"),
    )
    digest = F.sha2(F.concat_ws(":", F.col("split").cast("string"), F.col("said")), 256)
    rows = rows.select("*", F.unhex(F.substring(digest, 1, 30)).alias("digest"), F.substring("said", 1, 64).alias("begins"))
    placed = stage(
        _in_order(rows, ["conv_id", "turn", "begins"], ["conv_id", "turn", "said"], ["conv_id", "digest", "bytes"]),
        "turns",
    )
    placed = stage(_continued(placed, False), "places")
    convs = stage(placed.groupBy("conv_id").count().select("conv_id"), "conversations")
    taken = F.crc32(F.col("conv_id").cast("string")) % lent
    heads = (
        convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), taken.alias("h"))
        .join(placed.filter(F.col("place") < lent - 1).withColumnRenamed("conv_id", "base"), "base")
        .filter("place < h")
        .select("conv_id", F.lit(0).alias("part"), "place", F.col("digest").alias("t"), "bytes")
    )
    tails = placed.filter(F.col("place") >= taken).select(
        "conv_id", F.lit(1).alias("part"), "place", F.col("digest").alias("t"), "bytes"
    )
    return heads.union(tails), convs


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rows) of the trie of ``turns`` (conv_id, part, place, t, bytes), order (part, place).

    rows: conv_id, depth, node, parent, bytes, length (turns of the conversation). nodes: node, parent,
    conv_id (smallest member), depth, n_convs, bytes of the last text, weight (its members' turns from
    here on). The root has depth 0 and no parent; it is there unless ``convs`` is empty.
    """
    order = ["conv_id", "part", "place"]
    chained = stage(_in_order(turns, order, order, ["conv_id", "bytes", "t"]), "chained")
    rows = stage(_continued(chained, True), "prefixes").withColumn("depth", F.col("place") + 1).drop("place")
    rows = stage(attach_per_key(rows, "conv_id", {"length": F.max("depth")}), "rows")
    lengths = rows.filter("depth = 1").select("conv_id", "length")
    root = (
        convs.join(lengths, "conv_id", "left")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.coalesce("length", F.lit(0)) + 1).alias("weight"),
        )
        .filter("n_convs > 0")
        .select(
            F.lit(_bytes(_ROOT)).alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id",
            F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"), "weight",
        )
    )
    nodes = rows.groupBy("node", "parent").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"),
        F.min("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    return stage(nodes.select(*root.columns).union(root), "nodes"), rows


def subtree_sums(
    nodes: DataFrame, rows: DataFrame, values: list[str],
    task_weight: int = TASK_WEIGHT, most_open: int = MOST_OPEN,
) -> DataFrame:
    """(node, one sum per value) over the node and all below it.

    ``nodes`` (node, parent, conv_id, depth, weight, long columns ``values``) is one tree, ``rows``
    (conv_id, node, parent) says which nodes a conversation passes through. Weights are subtree sums
    of positive numbers. Components weigh more than ``task_weight`` and a ``most_open``th of the tree
    as long as they are open, so there are fewer than ``most_open`` of them: their centroids and
    totals are broadcast.
    """
    top = nodes.filter("parent IS NULL").select("node", "weight").first()
    if top is None:
        return nodes.select("node", *values)
    whole = top["weight"]
    limit = max(task_weight, whole // most_open)
    sums = [f"{v}_below" for v in values]
    state = ["node", "parent", "conv_id", "depth", "weight", "comp", "total", *values, *sums]
    begun = {"comp": F.lit(top["node"]), "total": F.lit(whole), **{s: F.lit(0).cast("long") for s in sums}}
    work = nodes.withColumns(begun).select(*state)
    heavy = F.col("weight") * 2 > F.col("total")
    open_rows, closed, done = (work, [], []) if whole > limit else (None, [work], [])
    while open_rows is not None:
        centroid = F.max(F.struct("depth", "node", "weight"))
        heads = open_rows.filter(heavy).groupBy("comp").agg(centroid.alias("c"))
        heads = stage(
            heads.select("comp", F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")),
            "centroids",
        )
        # A node is under a centroid if the conversation that named it passes through both.
        below = rows.select("conv_id", F.col("node").alias("child"), F.col("parent").alias("c_node")).join(
            F.broadcast(heads.select("c_node")), "c_node"
        )
        marked = open_rows.join(F.broadcast(heads), "comp")
        deeper = marked.filter("depth > c_depth").join(below, ["conv_id", "c_node"], "left")
        level = marked.filter("depth <= c_depth").withColumn("child", F.lit(None).cast("binary"))
        marked = stage(deeper.unionByName(level), "split")
        counted = marked.filter("child IS NOT NULL OR node = c_node").groupBy("comp")
        counted = stage(counted.agg(*[F.sum(v).alias(f"{v}_c") for v in values]), "totals")
        added = marked.join(F.broadcast(counted), "comp").select(
            "node", "parent", "conv_id", "depth",
            (F.col("weight") - F.when(heavy, F.col("c_weight")).otherwise(0)).alias("weight"),
            F.coalesce("child", "comp").alias("comp"),
            (F.col("node") == F.col("c_node")).alias("is_centroid"),
            *values,
            *[(F.col(s) + F.when(heavy, F.col(f"{v}_c")).otherwise(0)).alias(s) for v, s in zip(values, sums)],
        )
        done.append(added.filter("is_centroid").select("node", *sums))
        rest = stage(added.filter("NOT is_centroid").drop("is_centroid"), "components")
        totals = stage(
            rest.groupBy("comp").agg(F.max("weight").alias("total")).filter(F.col("total") > limit), "open"
        )
        if totals.isEmpty():
            closed.append(rest.withColumn("total", F.lit(0).cast("long")).select(*state))
            break
        opened = rest.join(F.broadcast(totals), "comp", "left").select(*state)
        closed.append(opened.filter("total IS NULL"))
        open_rows = opened.filter("total IS NOT NULL")
    small = closed[0]
    for more in closed[1:]:
        small = small.union(more)
    found = _finished(small.select("comp", "node", "parent", "depth", "weight", *values, *sums), len(values))
    for more in done:
        found = found.union(more)
    return found.select("node", *[F.col(s).alias(v) for s, v in zip(sums, values)])


def component_sums(
    parent: np.ndarray, weight: np.ndarray, value: np.ndarray, below: np.ndarray
) -> np.ndarray:
    """Subtree sums (n x values) by centroid decomposition of a forest of n nodes, plus ``below``.

    ``parent`` is the place of the parent, -1 for tops, and smaller than the place of the node.
    All components are split at once, each at its own centroid, until no node is left.
    """
    n = len(parent)
    place = np.arange(n)
    below, weight = below.copy(), weight.copy()
    up = np.where(parent < 0, place, parent)

    def roots(link: np.ndarray) -> np.ndarray:
        while True:
            after = link[link]
            if np.array_equal(after, link):
                return link
            link = after

    comp = roots(up)
    left = np.ones(n, bool)
    while left.any():
        live = np.flatnonzero(left)
        heavy = live[2 * weight[live] > weight[comp[live]]]
        # Parents come before children, so the last of a component's path is its centroid.
        centroid = np.full(n, -1)
        np.maximum.at(centroid, comp[heavy], heavy)
        own = centroid[comp]
        own[~left] = -1
        # Cut the edges at centroids and to nodes that are gone: tops are then children or old tops.
        cut = ~left | (comp == place) | (place == own) | ((parent >= 0) & (parent == own))
        comp_after = roots(np.where(cut, place, up))
        child = left & (parent >= 0) & (parent == own)
        under = left & ((place == own) | child[comp_after])
        total = np.zeros((n, value.shape[1]), np.int64)
        np.add.at(total, comp[under], value[under])
        below[heavy] += total[comp[heavy]]
        path = heavy[heavy != own[heavy]]
        weight[path] -= weight[own[path]]
        left[centroid[centroid >= 0]] = False
        comp = comp_after
    return below


def _finished(rows: DataFrame, width: int) -> DataFrame:
    """Sums of whole components (comp, node, parent, depth, weight, values, sums so far)."""
    names = ["node", *rows.columns[-width:]]

    def worked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held)
        node = block.column("node").to_pylist()
        at = {name: i for i, name in enumerate(node)}
        comp = block.column("comp").to_pylist()
        parent = np.array(
            [-1 if c == name else at[p] for c, name, p in zip(comp, node, block.column("parent").to_pylist(), strict=True)],
            np.int64,
        )
        numbers = [block.column(i).to_numpy() for i in range(4, 5 + 2 * width)]
        value = np.stack(numbers[1 : 1 + width], axis=1).astype(np.int64)
        below = np.stack(numbers[1 + width :], axis=1).astype(np.int64)
        found = component_sums(parent, numbers[0].astype(np.int64), value, below)
        columns = [pa.array(node, pa.binary()), *[pa.array(found[:, i]) for i in range(width)]]
        return pa.RecordBatch.from_arrays(columns, names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < BLOCK_ROWS:
                continue
            comps = batch.column(0).to_pylist()
            last = next((i for i in range(len(comps) - 1, 0, -1) if comps[i] != comps[i - 1]), 0)
            if not last and held[:-1] and held[-2].column(0)[-1].as_py() == comps[0]:
                continue  # one component fills the batch and began before it
            ready = [*held[:-1], *([batch.slice(0, last)] if last else [])]
            if ready:
                yield worked(ready)
            held, size = [batch.slice(last)], batch.num_rows - last
        if held:
            yield worked(held)

    schema = ", ".join(["node binary", *[f"{s} long" for s in names[1:]]])
    return rows.repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(blocks, schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal conv_ids of ``ends`` (node, conv_id), ascending, comma-joined.

    Ids are joined to pieces where they are sorted; the hash of a node is a sequential function, so
    its pieces pass through one task as a stream, a piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            row = [[node], [ids[0]], [",".join(map(str, ids))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.binary()), pa.array(row[1]), pa.array(row[2])], ["node", "first", "ids"]
            )

        def runs() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        made = []
        for name, conv in runs():
            if ids and (name != node or len(ids) == PIECE_IDS):
                made.append(piece())
                ids = []
                if len(made) == 4096:
                    yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                    made = []
            node = name
            ids.append(conv)
        if ids:
            made.append(piece())
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, told = None, None
        for batch in batches:
            names, found = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == node:
                    told.update(b"," + ids.encode())
                    continue
                if told:
                    names.append(node)
                    found.append(told.hexdigest())
                node, told = name, hashlib.sha256(ids.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found)], ["node", "ends_sha256"])
        if told:
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([told.hexdigest()])], ["node", "ends_sha256"]
            )

    made = (
        ends.select("node", "conv_id")
        .repartitionByRange("node", "conv_id")
        .sortWithinPartitions("node", "conv_id")
        .mapInArrow(pieces, "node binary, first long, ids string")
    )
    return (
        made.repartition("node")
        .sortWithinPartitions("node", "first")
        .select("node", "ids")
        .mapInArrow(digests, "node binary, ends_sha256 string")
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, **limits: int) -> DataFrame:
    """The nodes of the prefix trie of conversations, one row each.

    ``turns`` (conv_id, part, place, t, bytes) are digests in the order (part, place), as from
    ``rebuilt_turns``; ``convs`` (conv_id) lists all conversations, those without
    turns end at the root. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (summed over the subtree, (n_convs - 1) times the bytes of a node's last
    text) and ends_sha256. The pair (conv_id, depth) names a node.

    Without conversations there is no node. Null roles and texts are empty; rows without conv_id go;
    null turns come first; turns of one number are ordered by role and text, and repeated rows are
    repeated turns. Other columns are ignored.
    """
    nodes, rows = prefix_nodes(turns, convs)
    children = nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(
        nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumns(
            {
                "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
                "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
                "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"),
            }
        ),
        "family",
    )
    # A parent's own row lies with its children under one key, however many there are.
    beside = nodes.select("node", F.col("parent").alias("key"), F.lit(None).cast("long").alias("own"))
    beside = beside.union(nodes.select(F.lit(None).cast("binary"), "node", "conv_id"))
    parents = attach_per_key(beside, "key", {"parent_conv_id": F.max("own")}).filter("node IS NOT NULL")
    sums = subtree_sums(nodes, rows, ["n_leaves", "saved_tokens"], **limits)
    ends = rows.filter("depth = length").select("node", "conv_id")
    silent = convs.join(rows.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = ends.union(silent.select(F.lit(_bytes(_ROOT)), "conv_id"))
    return (
        nodes.drop("n_leaves", "saved_tokens")
        .join(sums, "node")
        .join(parents.select("node", "parent_conv_id"), "node", "left")
        .join(ends_digests(ends), "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, c - c % {FAMILY} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, len(s) + 1), lambda i: ord(s[i:i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b),
  range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % {LENT} AS h
  FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
u AS (SELECT k.c, 0 AS part, place, role, text FROM k JOIN t ON t.c = k.base AND place < h
  UNION ALL SELECT k.c, 1, place, role, text FROM k JOIN t ON t.c = k.c AND place >= h),
o AS (SELECT c, row_number() OVER w AS depth, text, string_agg(md5(concat(len(role), ':', role, text)), '') OVER w AS key,
  count(*) OVER (PARTITION BY c) AS length FROM u WINDOW w AS (PARTITION BY c ORDER BY part, place)),
r AS MATERIALIZED (SELECT c, depth, strlen(text) AS bytes, md5(key) AS key, lag(md5(key), 1, '') OVER (PARTITION BY c ORDER BY depth)
  AS up, length FROM o
  UNION ALL SELECT k.c, 0, 0, '', NULL, coalesce(length, 0) FROM k LEFT JOIN (SELECT DISTINCT c, length FROM o) USING (c)),
n AS MATERIALIZED (SELECT key, any_value(up) AS up, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
  any_value(bytes) AS bytes, string_agg(CASE WHEN depth = length THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM r GROUP BY key),
f AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n x WHERE x.up = n.key) AS n_children FROM n),
s AS (SELECT r.key, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * f.bytes) AS saved FROM f
  JOIN r ON r.c = f.conv_id AND r.depth <= f.depth GROUP BY r.key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (key) LEFT JOIN n p ON p.key = f.up
"""


@query("op13_prefix_trie", OP13_SQL)
def _op13(spark, folder):
    return prefix_trie(*rebuilt_turns(table(spark, folder, "conversations")))
