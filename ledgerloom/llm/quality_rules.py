"""Quality rules with cross-document line frequency, in DataFrame functions.

One pass over the texts gives each document its counts and the hashes of its normalised lines,
distinct within the document. Counting those per host gives the number of distinct documents of
each line. Lines above the limit are removed, and a document that loses most of its words to
that is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import numbered
from ledgerloom.llm.registry import query, table
from ledgerloom.session import stage

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
#: A line that more documents of a host have, by number and by share of the host's, is removed there.
MAX_DOCUMENTS = 5
MAX_SHARE = 0.05
#: Hosts whose counts are small enough to broadcast.
_FEW_HOSTS = 1 << 16
#: Share of its words that a document must keep.
MIN_KEPT_SHARE = 0.5


def spaced_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _normalised(line: Column) -> Column:
    """Words of a line, A-Z lower-cased and every digit a zero."""
    return spaced_words(F.translate(line, UPPER + "123456789", LOWERED + "0" * 9))


def _pairs(hashes: str, step: int) -> Column:
    """Hash of each element with the one ``step`` later."""
    whole = F.col(hashes)
    return F.transform(whole, lambda x, i: F.xxhash64(x, F.get(whole, i + step)))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """n_repeat_words from ``words``: words in 8-word windows that come twice or more."""
    rows = rows.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        rows = rows.withColumn(f"h{2 * step}", _pairs(f"h{step}", step))
    rows = rows.withColumn(
        "whole", F.slice("h8", F.lit(1), F.greatest(F.size("h8") - WINDOW + 1, F.lit(0)))
    )
    again = F.size(F.array_distinct("whole")) < F.size("whole")
    rows = rows.withColumn(
        "ranked",
        F.when(
            again,
            F.sort_array(F.transform("whole", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    ranked = F.col("ranked")

    def beside(x: Column, i: Column) -> Column:
        other = lambda j: F.coalesce(F.get(ranked, j)["h"] == x["h"], F.lit(False))
        return other(i - 1) | other(i + 1)

    rows = rows.withColumn(
        "places", F.sort_array(F.transform(F.filter(ranked, beside), lambda x: x["i"]))
    )
    places = F.col("places")
    covered = F.transform(
        places,
        lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))),
    )
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))


def text_counts(docs: DataFrame) -> DataFrame:
    """Per row of (row_id, doc_id, source, text) its counts and its lines as (hash, words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "row_id", F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("text"),
    )
    rows = rows.withColumn("words", spaced_words(F.col("text")))
    rows = _with_repeats(rows)
    rows = rows.withColumn(
        "raw", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    return rows.select(
        "row_id",
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            F.transform("raw", _normalised),
            lambda a: F.struct(
                F.xxhash64(F.array_join(a, " ")).alias("line"), F.size(a).alias("words")
            ),
        ).alias("lines"),
    )


def frequent_lines(counted: DataFrame, max_documents: int, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line) of lines in more documents than ``max_documents`` and ``max_share`` of their host."""
    hosts = stage(counted.groupBy("host").agg(F.count(F.lit(1)).alias("of_host")), "hosts")
    several = (
        counted.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") > max_documents)
    )
    return (
        several.join(F.broadcast(hosts) if hosts.count() <= _FEW_HOSTS else hosts, "host")
        .filter(F.col("n_docs") > F.col("of_host") * max_share)
        .select("host", "line")
    )


def quality_rules(
    docs: DataFrame,
    max_documents: int = MAX_DOCUMENTS,
    min_kept_share: float = MIN_KEPT_SHARE,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text) with its counts and the verdict.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows.
    ``kept``: the base passes and at least ``min_kept_share`` of the words are in lines that few
    documents of the same source have: at most ``max_documents`` of them, or ``max_share`` of all the
    source has, which keeps the verdict level however large it is. Lines count as equal when
    their words are, A-Z lower-cased and digits alike; blank lines do not count.

    A null text has no words and fails; a null source is a host like the empty one. Repeated
    rows are documents of their own. Other columns are ignored.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", "text")
    counted = stage(text_counts(keyed), "text_counts")
    frequent = stage(frequent_lines(counted, max_documents, max_share), "frequent_lines")
    lines = counted.select("row_id", "host", F.explode("lines").alias("l")).select(
        "row_id", "host", "l.line", "l.words"
    )
    removed = (
        lines.join(frequent, ["host", "line"], "left_semi")
        .groupBy("row_id")
        .agg(F.sum("words").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"))
    )
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    enough = F.col("n_words") - gone >= min_kept_share * F.col("n_words")
    return counted.join(removed, "row_id", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & enough).alias("kept"),
        gone.alias("removed_words"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
    )


def without_frequent_lines(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The columns of ``docs``, with lines above the limits taken out of ``text``.

    Null texts and texts without such lines stay as they are; a null source is a host like the empty
    one. Equal texts of a source are worked on once and repeated rows all stay; a text may end empty.
    """
    rows, names = numbered(docs)
    text = F.col(names["text"])
    host = F.coalesce(F.col(names["source"]).cast("string"), F.lit(""))
    keyed = rows.withColumns({"host": host, "text_hash": F.xxhash64(text)})
    counted = text_counts(
        docs.select(F.xxhash64(F.col("text")).alias("row_id"), "doc_id", "source", "text")
    ).withColumnRenamed("row_id", "text_hash")
    counted = stage(counted, "text_counts")
    frequent = stage(frequent_lines(counted, max_documents), "frequent_lines")
    gone = (
        counted.select("text_hash", "host", F.explode("lines.line").alias("line"))
        .join(frequent, ["host", "line"], "left_semi")
        .groupBy("host", "text_hash")
        .agg(F.collect_set("line").alias("gone"))
    )
    kept = F.filter(
        F.split(text, "\n"),
        lambda x: ~F.array_contains("gone", F.xxhash64(F.array_join(_normalised(x), " "))),
    )
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    done = keyed.join(gone, ["host", "text_hash"], "left").withColumn(names["text"], left)
    return done.select(*rows.columns).toDF(*docs.columns)


_WORDS = "[x FOR x IN string_split_regex({}, '[\\x20\\x09-\\x0D]+') IF x <> '']"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS words,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS raw FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS pos,
  unnest([array_to_string(words[k:k + 7], ' ') FOR k IN range(1, len(words) - 6)]) AS win FROM w WHERE len(words) >= 8),
rep AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS word FROM
  (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, host, {_WORDS.format("translate(line, '" + UPPER + "123456789', '" + LOWERED + "000000000')")} AS lw
  FROM (SELECT doc_id, host, unnest(raw) AS line FROM w)),
keyed AS (SELECT doc_id, host, array_to_string(lw, ' ') AS line, len(lw) AS words FROM lines),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT host, line FROM keyed JOIN hosts USING (host) GROUP BY host, line, docs
  HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS} AND count(DISTINCT doc_id) > docs * {MAX_SHARE}),
gone AS (SELECT doc_id, sum(words) AS words, count(*) AS lines FROM keyed JOIN freq USING (host, line) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
  CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words, coalesce(gone.lines, 0) AS removed_lines
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words - removed_words >= {MIN_KEPT_SHARE} * n_words AS kept FROM f
"""


@query("op7_quality_rules", OP7_SQL)
def _op7(spark, folder):
    return quality_rules(table(spark, folder, "documents"))
