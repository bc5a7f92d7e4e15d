"""The pipeline's stages one by one, and the registered queries."""

import os
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm_joins import brute_join, brute_remove
from test_llm_trained import brute_quality

import __spark_entry__
from starfold.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    known = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(known)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def folder(spark, odd, toxic_labels_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic_labels_rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def toxic_labels_rows(odd_rows):
    return [(r[0], 1, int("the " in (r[1] or ""))) for r in odd_rows if r[0] is not None]


def test_stages_do_their_work(spark, folder, odd, odd_rows):
    by_name = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = by_name["quality rules"](spark, docs, folder)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, w in zip(odd_rows, brute_quality(odd_rows, 50)) if w[-1])
    single = by_name["n-gram Jaccard join"](spark, docs, folder)
    assert {c for _, n, c in brute_join(odd_rows, 5, 80) if n and c is not None} <= {r["doc_id"] for r in single.collect()}
    cut = by_name["substring dedup"](spark, docs, folder)
    want = Counter((r[0], r[1] if not gone else text) for r, (_, _, gone, text) in zip(odd_rows, brute_remove(odd_rows, 20)))
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == want
    assert cut.where((F.char_length("text") != F.col("n_chars")) & F.col("doc_id").isNotNull()).count() == 0
    for name in ("toxicity", "quality rules", "n-gram Jaccard join", "substring dedup"):
        assert by_name[name](spark, docs, folder).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_run(spark):
    result = corpus_pipeline.run(spark, FOLDER)
    found = result.collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found and {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    filled = Counter()
    for r in found:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048


def test_run_on_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
