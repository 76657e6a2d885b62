import sys
from pathlib import Path

from test_jaccard_join import shingles

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def test_every_operator_has_a_query():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def first_of_groups(pairs):
    sets = [shingles(t, 5) for _, t in pairs]
    kept = []
    for i, (doc_id, text) in enumerate(pairs):
        seen, todo = {i}, [i]
        while todo:
            a = sets[todo.pop()]
            for j, b in enumerate(sets):
                if j not in seen and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    seen.add(j)
                    todo.append(j)
        if doc_id == min(pairs[j][0] for j in seen):
            kept.append((doc_id, text))
    return kept


def test_stages_take_messy_and_empty_tables(spark, docs, messy, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    items = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (messy, []):
        made = docs(rows, extra=True)
        columns = made.columns
        for i, (_, apply) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(rows)}-{i}")
            apply(spark, made, str(tmp_path)).write.parquet(path)
            made = spark.read.parquet(path)
            assert made.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        assert made.count() <= len(rows)
