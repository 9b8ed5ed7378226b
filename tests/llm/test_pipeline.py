"""The pipeline's stages on planted documents, and its queries."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline


@pytest.fixture
def folder(spark, docs_of, words, tmp_path):
    made = random.Random(8)
    clean = [" ".join(made.choices(words, k=120)) for _ in range(8)]
    passage = " ".join(made.choices(words, k=60))
    item = " ".join(made.choices(words, k=30))
    near = clean[0].split()
    near[60] = "changed"
    texts = [*clean, " ".join(near), clean[1], f"{clean[2][:200]} {passage}", f"{clean[3][:300]} {passage} end"]
    texts += [f"{clean[4][:100]} {item}", "123 !!", None, ""]
    path = str(tmp_path)
    docs = docs_of(texts)
    docs = docs.unionByName(docs.where("doc_id = 5"))  # a repeated row
    docs.drop("score", "kept", "key", "spans", "class", "mark", "node", "start").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_each_stage(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    language, near, passages, leaks = kept
    assert set(language) == set(range(13))
    assert set(near) == set(range(13)) - {8, 9}
    assert docs.count() == len(leaks)
    assert set(passages) == set(near) and set(leaks) == set(near) - {12}
    assert passages[10].text == texts[10]
    assert passages[11].text.endswith(" end") and len(passages[11].text) < 320
    assert all(r.n_chars == len(r.text) for r in passages.values())
    assert all(leaks[i].text == texts[i] for i in range(8))
    packed = corpus_pipeline.run(spark, path).toPandas()
    assert sorted(packed["doc_id"]) == sorted(leaks)


def test_leaks_without_ids_and_of_shared_ids_go(spark, folder, docs_of):
    path, _ = folder
    item = spark.read.parquet(f"{path}/benchmark.parquet").first()["text"]
    rows = [(None, item), (None, "clean"), (1, f"x {item}"), (1, f"{item} y"), (1, "clean"), (None, None)]
    docs = docs_of(rows).withColumnRenamed("mark", "text_hash")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, path)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, "clean"), (1, "clean"), (None, None)], key=str)


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_registered():
    names = [n for n in contract.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_texts_with_letters_stay_where_no_language_is_learned(spark, docs_of):
    docs = docs_of(["some words here", "é", "12 34", "", None]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


def test_stages_hand_rows_to_python_in_small_batches(spark, docs_of):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    docs = docs_of(["a b"])
    try:
        for value, then in (("64m", f"{4 << 20}b"), ("1m", "1m")):
            spark.conf.set(name, value)
            corpus_pipeline.best_fit_packing(spark, docs, "")
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, held)
