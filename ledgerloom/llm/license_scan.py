"""License scans by ordered signature rules, in DataFrame functions.

A text becomes its words, each between two blanks. Rules are regexes over that, a keyword and a
priority each. Texts without a license stem are done at once; of the others, a rule reads
only texts that hold its keyword. Both are in every match, so they spare work only. Where detections overlap, one that lies within another is
dropped if the other has the higher priority, or the same and is longer, or comes from an
earlier rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters outside of words
_OUTSIDE = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: label, keyword, name as words
NAMES = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("mit", "x11", "mit x11"),
    ("mit-0", "attribution", "mit no attribution"),
    ("apache", "apache", "apache"),
    ("apache", "apache", "apache software"),
    ("apache", "asl", "asl"),
    ("gpl", "general", "(gnu )?general public"),
    ("gpl", "gpl", "(gnu )?gpl"),
    ("gpl", "gplv2", "gplv2"),
    ("gpl", "gplv3", "gplv3"),
    ("lgpl", "lesser", "(gnu )?lesser general public"),
    ("lgpl", "library", "(gnu )?library general public"),
    ("lgpl", "lgpl", "(gnu )?lgpl"),
    ("agpl", "affero", "(gnu )?affero general public"),
    ("agpl", "agpl", "(gnu )?agpl"),
    ("gfdl", "documentation", "(gnu )?free documentation"),
    ("bsd", "bsd", "bsd"),
    ("bsd-2-clause", "bsd", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", "(bsd 4 clause|4 clause bsd|original bsd)"),
    ("isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "development", "common development and distribution"),
    ("eupl", "union", "european union public"),
    ("artistic", "artistic", "(perl )?artistic"),
    ("zlib", "zlib", "zlib( libpng)?"),
    ("boost", "boost", "boost software"),
    ("python", "python", "python software foundation"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("unlicense", "unlicense", "(the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "font", "sil open font"),
    ("odbl", "database", "open database"),
    ("cc0", "cc0", "(cc0|creative commons zero)( 1 0)?( universal)?"),
    ("cc-by", "cc", "cc by"),
    ("cc-by-sa", "cc", "cc by sa"),
    ("cc-by-nd", "cc", "cc by nd"),
    ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-nc-sa", "cc", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", "cc by nc nd"),
    ("cc-by", "attribution", "creative commons attribution"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"),
    ("cc-by-nc-sa", "noncommercial", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "noncommercial", "creative commons attribution noncommercial noderivatives"),
]
_VERSION = "( (version|v))?( v?[0-9]+( [0-9]+)?)?( (or|and) (any )?later)?"
#: priority, form; N is a name and V a version
FORMS = [
    (95, "spdx licen[cs]e identifier NV"),
    (90, "licen[cs]ed under (the )?(terms of (the )?)?N( (public )?licen[cs]e)?V"),
    (85, "(released|distributed|published|available|provided) under (the )?(terms of (the )?)?N( licen[cs]e)?V"),
    (80, "(subject to|in accordance with|terms of|permitted by) (the )?N licen[cs]eV"),
    (75, "licen[cs]e (is )?(the )?NV"),
    (70, "N licen[cs]eV"),
]
#: Rules of their own: priority, label, keyword, form
OTHERS = [
    (65, "public-domain", "domain", "(dedicated to|released into|placed in|in) the public domain"),
    (60, "mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    (60, "bsd", "redistribution", "redistribution and use in source and binary forms"),
    (60, "gpl", "free", "this program is free software you can redistribute it"),
    (60, "isc", "permission", "permission to use copy modify and or distribute this software"),
    (60, "zlib", "warranty", "this software is provided as is without any express or implied warranty"),
    (50, "proprietary", "reserved", "all rights reserved"),
    (50, "proprietary", "confidential", "proprietary and confidential"),
    (40, "copyright", "copyright", "copyright( c)?( [0-9]+)+"),
]
#: A text without any of these has no detection: every rule but those of priority 85 has one of
#: the first list in each of its matches, and those begin with one of the second.
STEMS = ["licen", "spdx", "public domain", "permission", "redistribut", "warrant", "reserved", "confidential", "copyright"]
UNDER = ["released under", "distributed under", "published under", "available under", "provided under"]
#: Keywords of names that have alternatives without the word itself: a part that all have.
PARTS = {"bsd-2-clause": "bsd ", "cc0": " c"}
BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def _pattern(form: str) -> str:
    """A form as a regex over words that stand between two blanks each."""
    return " " + form.replace(" ", "  ") + " "


def rules() -> list[tuple[int, int, str, str, str]]:
    """(number, priority, label, keyword, regex), highest priority first.

    Every match of a regex holds the keyword, blanks included.
    """
    found = [
        (priority, label, keyword, form.replace("N", name).replace("V", _VERSION))
        for priority, form in FORMS
        for label, keyword, name in NAMES
    ] + OTHERS
    found.sort(key=lambda r: -r[0])
    return [
        (n, p, label, PARTS.get(label, f" {key} "), _pattern(form)) for n, (p, label, key, form) in enumerate(found)
    ]


def _n_words(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(text: Column, pattern: Column) -> Column:
    """(low, high) in words of each match of ``pattern``."""
    between = F.transform(F.split(text, pattern, -1), _n_words)
    matched = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), _n_words)
    sizes = F.zip_with(between, matched, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<low:int,high:int>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        low = state["at"] + x["b"]
        high = low + F.coalesce(x["m"], F.lit(0))
        place = F.array(F.struct(low.alias("low"), high.alias("high")))
        found = F.when(x["m"].isNull(), state["found"]).otherwise(F.concat(state["found"], place))
        return F.struct(high.alias("at"), found.alias("found"))

    return F.aggregate(sizes, start, step, lambda state: state["found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): detections and base phrases.

    Words are runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased. ``detections`` are
    what overlap leaves of the rules' matches: low and high word, priority, rule number, label.
    ``labels`` are theirs and the base phrases', distinct and sorted. ``score`` is the highest
    priority over 100, and 0.7 at least with a base phrase; 0 without either.

    Null and empty texts have no words. Repeated rows stay. Other columns are ignored.
    """
    table_of_rules = F.array(
        *(
            F.struct(
                F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"),
                F.lit(key).alias("keyword"), F.lit(regex).alias("regex"),
            )
            for n, p, label, key, regex in rules()
        )
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.translate(text, UPPER + _OUTSIDE, LOWERED + " " * len(_OUTSIDE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("plain"))
    rows = rows.select("doc_id", F.array_remove(F.split("plain", " "), "").alias("words"))
    spaced = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), spaced.alias("spaced"))
    gate = F.lit(False)
    for stem in STEMS + UNDER:
        gate = gate | F.col("spaced").contains(stem.replace(" ", "  "))
    rows = rows.select("doc_id", "n_words", F.when(gate, F.col("spaced")).alias("spaced"))
    spaced = F.col("spaced")

    found = F.flatten(
        F.transform(
            F.filter(table_of_rules, lambda r: spaced.contains(r["keyword"])),
            lambda r: F.transform(
                _places(spaced, r["regex"]),
                lambda p: F.struct(
                    p["low"].alias("low"), p["high"].alias("high"), r["priority"].alias("priority"),
                    r["rule"].alias("rule"), r["label"].alias("label"),
                ),
            ),
        )
    )
    rows = rows.withColumn("found", F.when(spaced.isNotNull(), found))
    every = F.col("found")

    def hidden(x: Column) -> Column:
        def by(y: Column) -> Column:
            longer = y["high"] - y["low"] - (x["high"] - x["low"])
            return (
                (y["low"] <= x["low"])
                & (y["high"] >= x["high"])
                & (
                    (y["priority"] > x["priority"])
                    | (
                        (y["priority"] == x["priority"])
                        & ((longer > 0) | ((longer == 0) & (y["rule"] < x["rule"])))
                    )
                )
            )

        return F.exists(every, by)

    empty = F.array().cast("array<struct<low:int,high:int,priority:int,rule:int,label:string>>")
    rows = rows.withColumn(
        "detections", F.coalesce(F.sort_array(F.filter(every, lambda x: ~hidden(x))), empty)
    )
    for label, phrase in BASE:
        places = _places(spaced, F.lit(_pattern(phrase)))
        rows = rows.withColumn(
            f"at_{label}", F.when(spaced.contains(phrase.replace(" ", "  ")), places)
        )
    starts = F.flatten(
        F.array(*(F.coalesce(F.col(f"at_{label}")["low"], F.array().cast("array<int>")) for label, _ in BASE))
    )
    base = F.array_compact(
        F.array(*(F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label, _ in BASE))
    )
    rows = rows.withColumns({"starts": starts, "base": F.sort_array(base)})
    top = F.array_max(F.transform("detections", lambda d: d["priority"])) / 100
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(
            F.sort_array(F.array_distinct(F.concat("base", F.col("detections")["label"]))), ","
        ).alias("labels"),
        F.greatest(F.coalesce(top, F.lit(0.0)), F.when(F.size("starts") > 0, 0.7).otherwise(0.0))
        .cast("double").alias("score"),
        "detections",
    )


def _sql() -> str:
    """The scan in SQL from the rules alone, without gates."""
    listed = ",\n".join("({}, {}, '{}', '{}')".format(n, p, label, regex) for n, p, label, _, regex in rules())
    base = ", ".join(f"('{label}', '{_pattern(phrase)}')" for label, phrase in BASE)
    size = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS INTEGER)"
    places = f"""
      SELECT *, coalesce(list_sum([{size.format("x")} FOR x IN string_split_regex(s, regex)[1:k]]), 0)
        + coalesce(list_sum([{size.format("x")} FOR x IN regexp_extract_all(s, regex)[1:k - 1]]), 0) AS low,
        {size.format("regexp_extract_all(s, regex)[k]")} AS n FROM"""
    return rf"""
WITH rules(rule, priority, label, regex) AS (VALUES {listed}),
base(label, regex) AS (VALUES {base}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
d AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS s FROM w),
b AS ({places} (SELECT *, unnest(range(1, len(regexp_extract_all(s, regex)) + 1)) AS k FROM d, base)),
bb AS (SELECT doc_id, count(*) AS n, min(low) AS first, max(low) AS last FROM b GROUP BY doc_id),
f AS ({places} (SELECT *, unnest(range(1, len(regexp_extract_all(s, regex)) + 1)) AS k FROM d, rules)),
kept AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.low <= x.low
  AND y.low + y.n >= x.low + x.n AND (y.priority > x.priority OR (y.priority = x.priority
  AND (y.n > x.n OR (y.n = x.n AND y.rule < x.rule)))))),
bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM kept) GROUP BY doc_id),
top AS (SELECT doc_id, max(priority) / 100 AS score, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, n_words, coalesce(bb.n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
  greatest(coalesce(top.score, 0.0::DOUBLE), CASE WHEN bb.n > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  coalesce(top.n, 0) AS n_detections
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN top USING (doc_id)
"""


@query("op10_license_scan", _sql())
def _op10(spark, folder):
    found = scan_licenses(table(spark, folder, "documents"))
    return found.withColumn("n_detections", F.size("detections").cast("long")).drop("detections")
