import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id as li
from ledgerloom.llm import quality_classifier as qc
from ledgerloom.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def test_interactions_are_the_sum_over_pairs():
    draw = np.random.default_rng(4)
    machine = qc.FactorisationMachine(0.5, np.zeros((1, 1)), 0.3, draw.normal(size=12), draw.normal(size=(12, 3)))
    x = draw.random((5, 12))
    pairs = [
        0.3 + row @ machine.linear
        + sum(row[i] * row[j] * (machine.vectors[i] @ machine.vectors[j]) for i in range(12) for j in range(i))
        for row in x
    ]
    assert np.allclose(machine.margins(x), pairs)


def test_quality_of_held_out_documents(spark):
    scored = QUERIES["op3_quality_classifier"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    good, bad = (rows.loc[rows["quality"] == q, "score"] for q in (1, 0))
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97
    assert scored.count() == 1000 and scored.filter("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0


def test_same_fit_whatever_the_partitions(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    one = qc.fit_quality(docs.coalesce(1), labels)
    two = qc.fit_quality(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(one.linear, two.linear) and np.array_equal(one.vectors, two.vectors)


def test_quality_of_messy_rows(spark, docs, messy):
    made = docs(messy, extra=True)
    labels = [(i, k % 2, 0) for k, (i, _) in enumerate(messy)] + [(1, None, 0), (4, 0, 0), (999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = qc.fit_quality(made, labels)
    found = qc.score_quality(made, machine, made.columns, score="__score")
    assert found.columns == [*made.columns, "__score"]
    rows = found.collect()
    assert len(rows) == len(messy) and all(0 <= r["__score"] <= 1 for r in rows)
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=str) == sorted(messy, key=str)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["text"]), set()).add(r["__score"])
    assert all(len(s) == 1 for s in by.values())


@pytest.mark.parametrize(("kinds", "score"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_labels_of_one_kind(spark, docs, kinds, score):
    made = docs([(0, "a"), (1, None), (4, "b c")])
    ids = [i for i in range(40) if spark.range(1).select(qc.learned_from(F.lit(i))).first()[0]]
    made = docs([(i, "a b") for i in ids[:3]])
    labels = spark.createDataFrame(list(zip(ids, kinds, strict=False)), "doc_id long, quality int")
    rows = qc.score_quality(made, qc.fit_quality(made, labels), ["doc_id"]).collect()
    assert [r["score"] for r in rows] == [score] * 3
    assert qc.score_quality(docs([]), qc.fit_quality(docs([]), labels), ["doc_id"]).count() == 0


def test_language_of_held_out_documents(spark):
    found = QUERIES["op6_language_id"](spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.filter("held_out").join(docs, "doc_id").filter("length(text) > 30").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.97
    assert found.count() == 1000 and found.filter("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0


def test_kernel_counts_common_grams():
    texts = ["abcab", "abd", "", "xyz", "ABCAB", "да нет да", "漢字かな漢字", "é\U0001f600ñ"]
    raw = [t.encode() for t in texts]
    points, offsets = li.code_points(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert points.tolist() == [ord(c) for t in texts for c in t.lower()]
    there = li.presences(points, offsets)
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    assert there.sum(axis=1).tolist() == [len(g) for g in grams]
    common = there @ there.T
    assert common[0, 1] == len(grams[0] & grams[1]) and common[0, 3] == 0 and common[0, 4] == len(grams[0])
    values = li._unit(there) @ li._unit(there).T
    assert np.isclose(values[0, 1], common[0, 1] / np.sqrt(len(grams[0]) * len(grams[1])))


def test_language_of_very_long_held_out_texts(spark, docs):
    given = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = li.fit_languages(given)
    held = given.filter(~li.learned_from(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 200))
    rows, pairs = held.toPandas(), []
    for i, (_, group) in enumerate(rows.groupby("lang")):
        text = "\n".join(group["text"])
        pairs.append((i, (text + "\n") * (3_000_000 // len(text) + 1)))
    found = li.identify_languages(docs(pairs), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in found] == sorted(rows["lang"].unique())
    assert min(r["score"] for r in found) > 0.7


def test_every_language_is_learned(spark, docs):
    draw = np.random.default_rng(3)
    pairs, langs = [], []
    for j in range(200):
        words = ["".join(chr(97 + c) for c in draw.integers(0, 26, 4)) for _ in range(12)]
        for _ in range(1 if j == 0 else 12):
            langs.append(f"x{j:03d}")
            pairs.append((len(pairs), " ".join(draw.choice(words, 40))))
    made = spark.createDataFrame([(i, t, lang) for (i, t), lang in zip(pairs, langs, strict=True)], "doc_id long, text string, lang string")
    model = li.fit_languages(made, texts=1000)
    learned = {r["lang"] for r in made.filter(li.learned_from(F.col("doc_id"))).collect()}
    assert model.languages == sorted(learned) and len(learned) > 195
    found = li.identify_languages(made, model).join(made.select("doc_id", "lang"), "doc_id").toPandas()
    found = found[found["lang"].isin(learned)]
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97


def test_languages_of_messy_rows(spark, docs, messy):
    made = docs(messy, extra=True).unionByName(docs([(7, "123 456"), (8, "ñandú")], extra=True, lang=None))
    found = li.identify_languages(made, li.fit_languages(made)).collect()
    assert len(found) == len(messy) + 2
    by = {r["doc_id"]: r for r in found}
    for i in (1, 2, 3, 7):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in found} == {"und", "en"}
    nothing = li.fit_languages(docs([(1, "a b")], lang=None))
    assert {r["lang_pred"] for r in li.identify_languages(made, nothing).collect()} == {"und"}
    assert li.identify_languages(docs([]), li.fit_languages(docs([]))).count() == 0
