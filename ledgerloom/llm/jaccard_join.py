"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two are linked when their Jaccard similarity reaches a
threshold. The join is exact and runs in these steps:

1. Documents with equal sets form a class, found by one aggregate; only classes go on.
2. A matrix of tokens by sets has parts of sets as its tokens: for sets of similar size the
   shingles are dealt to m parts by hash, where m is greater than the number of shingles in
   which two linked sets can differ. So linked sets agree in at least one whole part. A part
   is rarely shared by chance, even where sets share a passage, because all that falls in it
   must be the same.
3. Sets are partitioned into groups of similar ones: a set goes with the most frequent token
   that it has, so most near copies of a set meet in one group. Large groups are divided; a group
   has some thousand sets and a million shingles at most, or one set. The matrix of tokens by
   groups proposes pairs of groups. Parity sketches of 256 bits bound the difference of two
   sets from below, and a pair of groups goes on only if a pair of its sets, below that bound,
   shares a token. Linked sets agree in several parts, the more the larger they are, so a set
   goes on only if it shares as many tokens with the other group (its own, within a group).
4. A proposed pair of groups is one small task. It holds each group's token union, bounds the
   overlap of every set with the other group's union, and opens the group only for sets that
   can still reach the threshold: these are counted exactly by a product of incidence
   matrices. It returns per set the number of linked documents and a link to the smallest
   reachable set of the task, never all pairs.
5. Components of those links give every class, and so every document, its smallest linked
   document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bitmaps import bitmap, in_bitmap
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.frames import numbered
from ledgerloom.llm.registry import query, table
from ledgerloom.llm.wordhash import (
    LOWER,
    SPACED,
    constants,
    find_words,
    mix,
    text_slices,
    windows,
)
from ledgerloom.session import stage

GROUP_SETS = 1024
GROUP_SHINGLES = 1_000_000
#: Bits of the map of documents whose sets are fetched; a stray bit only costs a fetched set.
MAP_BITS = 1 << 24
_NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Per text its distinct hashed shingles, sorted; a shorter text is one shingle."""
    found = find_words(LOWER[data], offsets, SPACED)
    sets = []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        own = found.hashes[a:b]
        sets.append(np.unique(windows(own, min(words, len(own)))) if len(own) else own)
    return sets


def _digest(tokens: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    first = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    second = mix(tokens ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([first, second ^ np.uint64(len(tokens))], ">u8").tobytes()


def _class_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of 256 buckets of tokens, as four numbers."""
    bucket = (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(255)).astype(np.int64)
    parity = np.bincount(bucket, minlength=256) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _signs(words: int, num: int, den: int):
    """Per document: size of its set, digest, sketch and the matrix rows that a linked set shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = SizeLevels(num, den)
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                sketches = np.array([_sketch(s) for s in sets], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        *(pa.array(sketches[:, j]) for j in range(4)),
                        pa.array([least_shared(s, levels) for s in sets], pa.int64()),
                    ],
                    ["doc_id", "text_hash", "n", "digest", "p0", "p1", "p2", "p3", "need"],
                )

    return run


_SIGNS = "doc_id long, text_hash long, n long, digest binary, p0 long, p1 long, p2 long, p3 long, need long"


class SizeLevels:
    """Ranges of set sizes such that linked sets lie in one range or in two next to each other."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]

    def level(self, n: int) -> int:
        while self.bounds[-1] <= n:
            low = self.bounds[-1]
            self.bounds.append(max(low + 1, low * self.den // self.num + 1))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def difference(self, total: int) -> int:
        """Shingles in which linked sets of ``total`` shingles together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def parts(self, level: int) -> tuple[int, int]:
        """(parts, parts that agree at least) for pairs of ``level`` or of it and the one below."""
        if level + 1 >= len(self.bounds):
            self.level(self.bounds[-1] + 1)
        most = self.difference(2 * (self.bounds[level + 1] - 1))
        agree = 2 + most // 12
        return (most + agree, agree) if most else (0, 0)


def part_tokens(tokens: np.ndarray, levels: SizeLevels) -> np.ndarray:
    """The rows of the matrix for one set: its parts at both levels where it can meet others.

    Empty parts are left out; they count only for a set with so many of them that agreement
    in empty parts alone is possible.
    """
    own = levels.level(len(tokens))
    rows = []
    for level in (own, own + 1):
        m, agree = levels.parts(level)
        if not m:
            continue  # linked sets are equal here
        seed = constants(2, 100 + level)
        part = (mix(tokens ^ seed[0]) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mix(tokens ^ seed[1]))
        filled = np.bincount(part, minlength=m) > 0
        if m - filled.sum() >= agree:
            filled[:] = True
        at = np.flatnonzero(filled)
        rows.append(mix(sums[at] + at.astype(np.uint64) * seed[0] + seed[1]))
    return np.concatenate(rows) if rows else np.zeros(0, np.uint64)


def least_shared(tokens: np.ndarray, levels: SizeLevels) -> int:
    """Rows of the matrix that any other set linked with this one has in common with it, at least.

    Linked sets agree in ``agree`` parts; those that are empty in both may be left out, and there are
    no more of them than this set has empty ones, nor than ``agree - 1`` where a set leaves them out.
    """
    if not len(tokens):
        return 0
    own = levels.level(len(tokens))
    least = []
    for level in (own, own + 1):
        m, agree = levels.parts(level)
        if m:
            part = (mix(tokens ^ constants(2, 100 + level)[0]) % np.uint64(m)).astype(np.int64)
            least.append(max(1, agree - m + np.count_nonzero(np.bincount(part, minlength=m))))
    return min(least, default=1)


def _parts(words: int, num: int, den: int):
    """Per set its matrix rows; sets that come again in the same batch are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = SizeLevels(num, den)
        for batch in batches:
            seen: set[bytes] = set()
            for _, _, data, offsets in text_slices(batch.column(0)):
                tokens, owners = [], []
                for s in shingle_sets(data, offsets, words):
                    if not len(s) or (digest := _digest(s)) in seen:
                        continue
                    seen.add(digest)
                    tokens.append(part_tokens(s, levels))
                    owners.append(np.full(len(tokens[-1]), _class_id(digest), np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(tokens).view(np.int64)),
                            pa.array(np.concatenate(owners)),
                        ],
                        ["token", "class_id"],
                    )

    return run


def _wanted_rows(wanted):
    """Rows of documents in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bitmap(wanted.value, ids)))

    return run


def _compare(words: int, num: int, den: int):
    """Links within one proposed pair of groups (or within one group)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["digest", "side"]).sort_values("digest")
        rows["shingles"] = _sets_of(rows["text"], words)
        alone = rows["group_a"].iloc[0] == rows["group_b"].iloc[0]
        left = rows if alone else rows[rows["side"] == 0]
        right = rows if alone else rows[rows["side"] == 1]
        links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            links = linked_pairs(list(left["shingles"]), list(right["shingles"]), num, den, alone)
        a, b = links
        if alone:
            a, b = a[a != b], b[a != b]  # both directions are there
            counts = np.zeros(len(left), np.int64)
            np.add.at(counts, a, left["members"].to_numpy()[b])
            nodes, root = left, _local_roots(len(left), a, b)
        else:
            counts = np.zeros(len(left) + len(right), np.int64)
            np.add.at(counts, a, right["members"].to_numpy()[b])
            np.add.at(counts, len(left) + b, left["members"].to_numpy()[a])
            nodes = pd.concat([left, right])
            root = _local_roots(len(nodes), a, len(left) + b)
        digest = nodes["digest"].to_numpy()
        hit = counts > 0
        return pd.DataFrame(
            {"digest": digest[hit], "near": digest[root][hit], "links": counts[hit]}
        )

    return run


def _sets_of(texts: pd.Series, words: int) -> list[np.ndarray]:
    return [
        s
        for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()))
        for s in shingle_sets(data, offsets, words)
    ]


_LINKS = "digest binary, near binary, links long"


def linked_pairs(
    left: list[np.ndarray], right: list[np.ndarray], num: int, den: int, alone: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all linked pairs of sorted sets, by bound and then by exact overlap.

    ``alone``: both sides are the same sets, so a set is held against the tokens that another one
    has too, and pairs of a set with itself mean nothing.
    """
    unions = [np.unique(np.concatenate(side), return_counts=True) for side in (left, right)]
    unions = [tokens[counts > 1] if alone else tokens for tokens, counts in unions]
    if not all(map(len, unions)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    kept = []
    for side, own, other in ((left, 0, 1), (right, 1, 0)):
        tokens = np.concatenate(side)
        at = np.minimum(np.searchsorted(unions[other], tokens), len(unions[other]) - 1)
        shared = np.concatenate([[0], np.cumsum(unions[other][at] == tokens)])
        ends = np.concatenate([[0], np.cumsum(sizes[own])])
        overlap = shared[ends[1:]] - shared[ends[:-1]]
        kept.append(np.flatnonzero(den * overlap >= num * sizes[own]))
    rows, columns = kept
    if not len(rows) or not len(columns):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    common = np.intersect1d(*unions, assume_unique=True)
    both = np.zeros((len(rows), len(columns)), np.float64)
    step = max(1, (1 << 22) // (len(rows) + len(columns)))
    for low in range(0, len(common), step):
        part = common[low : low + step]
        both += _incidence(left, rows, part) @ _incidence(right, columns, part).T
    total = sizes[0][rows][:, None] + sizes[1][columns][None, :]
    a, b = np.nonzero(den * both >= num * (total - both))
    return rows[a], columns[b]


def _incidence(sets: list[np.ndarray], chosen: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    cells = np.zeros((len(chosen), len(tokens)), np.float32)
    for row, i in enumerate(chosen):
        low, high = np.searchsorted(sets[i], tokens[[0, -1]])
        own = sets[i][low : high + 1]
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        cells[row, at[tokens[at] == own]] = 1
    return cells


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): text_hash, n_shingles, component_id, n_links.

    Linked are documents with ``den * |intersection| >= num * |union|`` of their distinct
    ``words``-word shingles; words are runs of other than ASCII white space, A-Z lower-cased; a
    text of fewer words is one shingle. ``n_links`` counts linked documents, copies included.
    ``component_id`` is the smallest doc_id that links reach, the document's own included.
    ``text_hash`` is Spark's xxhash64 of the text, for joins with rows whose ids repeat.

    Null and blank texts have no shingles and no links. Rows with a null doc_id take part;
    they are never the smallest, and their component_id is null if they reach no other.
    Repeated rows are copies of each other. Other columns are ignored.
    """
    return _joined(docs, words, num, den).drop("first")


def _joined(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``ngram_jaccard_join``, and whether a row is the ``first`` of its component.

    That is the one with the smallest (doc_id, text_hash), null ids last; equal rows are alike.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    keyed = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    spark = docs.sparkSession
    signs = stage(source.mapInArrow(_signs(words, num, den), _SIGNS), "signs")
    classes = (
        signs.filter("n > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("smallest"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep_id"), "text_hash")).alias("rep"),
            F.count(F.lit(1)).alias("members"),
            *(F.min(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3", "need")),
        )
        .withColumn(
            "class_id", F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
        )
    )

    # The matrix, without the tokens that one set alone has.
    matrix = keyed.select("text").mapInArrow(_parts(words, num, den), "token long, class_id long")
    matrix = stage(
        matrix.selectExpr(
            "token", "class_id",
            "min(class_id) OVER (PARTITION BY token) AS low",
            "max(class_id) OVER (PARTITION BY token) AS high",
            "count(*) OVER (PARTITION BY token) AS n",
        ).filter("low < high").select("token", "class_id", "n"),
        "matrix",
    )
    leaders = matrix.groupBy("class_id").agg(F.max(F.struct("n", "token"))["token"].alias("leader"))
    classes = stage(
        classes.join(leaders, "class_id", "left")
        .withColumn("leader", F.coalesce("leader", "class_id")),
        "classes",
    )
    divided = classes.groupBy("leader").agg(
        F.ceil(
            F.greatest(
                F.count(F.lit(1)) / F.lit(GROUP_SETS), F.sum("n") / F.lit(GROUP_SHINGLES)
            )
        ).alias("shares")
    )
    classes = stage(
        classes.join(stage(divided, "divided"), "leader").select(
            "digest", "class_id",
            F.xxhash64("leader", F.pmod(F.xxhash64("digest"), "shares")).alias("group_id"),
            "smallest", "rep.rep_id", "rep.text_hash", "members", "n", "p0", "p1", "p2", "p3", "need",
        ),
        "grouped",
    )
    # Tokens that lie in one group alone have done their work; the others get the sketches.
    placed = matrix.select("token", "class_id").join(classes.select("class_id", "group_id"), "class_id")
    placed = stage(
        placed.selectExpr(
            "token", "class_id", "group_id",
            "min(group_id) OVER (PARTITION BY token) AS low", "max(group_id) OVER (PARTITION BY token) AS high",
            "min(class_id) OVER (PARTITION BY token, group_id) < max(class_id) OVER (PARTITION BY token, group_id) AS mates",
        ).filter("low < high OR mates"),
        "placed",
    )
    astride = placed.filter("low < high").select("token", "class_id", "group_id")
    members = (
        astride.join(classes.select("class_id", "n", "p0", "p1", "p2", "p3"), "class_id")
        .groupBy("token", "group_id")
        .agg(F.collect_set(F.struct("class_id", "n", "p0", "p1", "p2", "p3")).alias("sets"))
    )
    members = stage(members, "members")

    def near(one: str, other: str, more: str = "") -> str:
        """Ids of sets of ``one`` that a set of ``other`` may be linked with."""
        differ = " + ".join(f"bit_count(x.p{j} ^ y.p{j})" for j in range(4))
        close = (
            f"{differ} <= (x.n + y.n) * {den - num} div {den + num}"
            f" AND x.n * {num} <= y.n * {den} AND y.n * {num} <= x.n * {den}"
        )
        return f"transform(filter({one}, x -> exists({other}, y -> {close} {more})), x -> x.class_id)"

    # Pairs of groups, with the sets of either that have a token and a sketch near the other's.
    proposed = (
        members.alias("a")
        .join(
            members.alias("b"),
            F.expr(f"a.token = b.token AND a.group_id < b.group_id AND size({near('a.sets', 'b.sets')}) > 0"),
        )
        .select(
            F.col("a.group_id").alias("group_a"), F.col("b.group_id").alias("group_b"),
            F.expr(near("a.sets", "b.sets")).alias("left"), F.expr(near("b.sets", "a.sets")).alias("right"),
        )
    )
    sides = F.array(
        *(F.struct(F.lit(i).alias("side"), F.col(c).alias("ids")) for i, c in enumerate(("left", "right")))
    )
    # ``shared`` counts the tokens that a set has in common with sets near it.
    proposed = (
        proposed.select("group_a", "group_b", F.inline(sides))
        .select("group_a", "group_b", "side", F.explode("ids").alias("class_id"))
        .groupBy("group_a", "group_b", "side", "class_id")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    # Within a group, the sets that have another one near by their sketches.
    within = (
        classes.groupBy("group_id")
        .agg(F.collect_list(F.struct("class_id", "n", "p0", "p1", "p2", "p3")).alias("sets"))
        .filter("size(sets) > 1")
        .select("group_id", F.expr(near("sets", "sets", "AND x.class_id != y.class_id")).alias("ids"))
        .select(
            F.col("group_id").alias("group_a"), F.col("group_id").alias("group_b"), F.lit(0).alias("side"),
            F.explode("ids").alias("class_id"),
        )
        .join(placed.filter("mates").groupBy("class_id").agg(F.count_distinct("token").alias("shared")), "class_id")
        .select("group_a", "group_b", "side", "class_id", "shared")
    )

    # Open the proposed pairs of groups, for sets that share as many tokens as a link takes.
    opened = proposed.union(within).join(
        classes.select("class_id", "digest", "rep_id", "text_hash", "members", "need"), "class_id"
    )
    opened = stage(opened.filter("shared >= need").drop("class_id", "shared", "need"), "opened")
    wanted = spark.sparkContext.broadcast(bitmap(opened.select("rep_id"), MAP_BITS))
    texts = keyed.select("doc_id", "text", "text_hash").mapInArrow(
        _wanted_rows(wanted), "rep_id long, text string, text_hash long"
    )
    links = stage(
        texts.join(opened, ["rep_id", "text_hash"])
        .select("group_a", "group_b", "side", "digest", "members", "text")
        .groupBy("group_a", "group_b")
        .applyInPandas(_compare(words, num, den), _LINKS),
        "set_links",
    )
    roots = connected_components(links.filter("digest != near"), "digest", "near")
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    placed = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", "smallest", "members", F.coalesce("root", "digest").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("smallest").alias("lowest"))
    per_class = (
        placed.join(lowest, "root")
        .join(counted, "digest", "left")
        .select(
            "digest", "lowest",
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        )
    )
    first = F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("text_hash") == F.col("lowest.text_hash"))
    return signs.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(
        per_class, "digest", "left"
    ).select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, first).otherwise(F.lit(True)).alias("first"),
    )


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)])
    END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = s.doc_id), s.doc_id)) AS component_id,
  (SELECT count(*) FROM links l WHERE l.x = s.doc_id) AS n_links
FROM s
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def _op1(spark, folder):
    docs = table(spark, folder, "documents")
    return ngram_jaccard_join(docs, words=4, num=85, den=100).drop("text_hash")


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest doc_id.

    Rows without an id stay only where their group has none with an id. Of rows of a group with
    equal ids, or all without one, that with the smallest hash of its text stays. Rows without
    words are groups of their own; equal ones of those stay once.
    """
    links = _joined(docs, words, num, den)
    key = [F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text_hash"]
    told = stage(
        links.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.bool_and("first").alias("kept")),
        "kept",
    )
    # Most rows stay and come once. The others are looked up; a map of them tells which those are.
    special = told.filter("rows > 1 OR NOT kept")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(special.select("text_hash"), MAP_BITS))

    @F.pandas_udf("boolean")
    def looked_up(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(held.value, hashes.to_numpy(np.int64)))

    rows, names = numbered(docs)
    rows = rows.withColumns(
        {
            "id": F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(_NO_ID)),
            "text_hash": F.xxhash64(F.col(names["text"]).cast("string")),
        }
    )
    sure = rows.filter(~looked_up("text_hash"))
    others = rows.filter(looked_up("text_hash")).join(
        told.filter("kept").select("id", "text_hash"), ["id", "text_hash"], "left_semi"
    )
    return sure.unionByName(others.dropDuplicates(["id", "text_hash"])).select(*names.values()).toDF(*docs.columns)
