"""The pipeline's stages on odd tables, one after the other, against what each must keep."""

import numpy as np
import pytest

import corpus_pipeline
from selfsim.llm import pii, queries, sentencepiece_fst

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], COLUMNS)


def folder(spark, tmp_path, rows, bench):
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def prose(seed, n=80, words=("the", "thing", "and", "house", "of", "water", "under", "light", "morning", "stone", "river", "paper")):
    return " ".join(str(w) for w in np.random.default_rng(seed).choice(words, n)) + "."


def test_every_stage_on_odd_rows(spark, tmp_path):
    item = " ".join(f"answer{k}" for k in range(20))
    rows = [(k, prose(k), "en" if k % 3 else "fr") for k in range(30)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 456", "en"), (None, prose(200), None), (None, prose(200), None), (103, prose(3), "en"), (3, prose(300), "en"), (104, prose(104) + " " + item + " " + prose(105), "en"), (105, prose(105) + " write to bob@mail.example.com", None), (106, "x" * 30_000 + " the thing", "en")]
    sf_dir = folder(spark, tmp_path, rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    ids = [r.doc_id for r in kept.collect()]
    assert not {100, 101, 102} & set(ids) and ids.count(None) == 2
    # repeats go, another text under the same id stays, a row without an id stays once
    one = corpus_pipeline.near_dedup(spark, docs.where("text is not null"), sf_dir).collect()
    assert sum(r.doc_id is None for r in one) == 1 and 103 not in {r.doc_id for r in one} and sum(r.doc_id == 3 for r in one) == 2
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()}
    assert 104 not in clean and {3, 100, 101, None} <= clean
    hidden = {r.doc_id: r for r in corpus_pipeline.pseudonymise(spark, docs, sf_dir).collect()}
    assert "bob@" not in hidden[105].text and hidden[105].n_chars == len(hidden[105].text) and hidden[100].text is None
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(final) == {*range(30), None, 105, 106} | (set(final) & {102}) and all(r.round_trip for r in final.values())


def test_without_labels_nothing_is_lost(spark, tmp_path):
    rows = [(k, prose(k), None) for k in range(10)]
    sf_dir = folder(spark, tmp_path, rows, [(1, "nothing of the kind, at all, anywhere")])
    assert corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).count() == 10


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_tables_without_documents(spark, tmp_path, rows):
    sf_dir = folder(spark, tmp_path, rows, [(1, "some item of words")])
    assert corpus_pipeline.run(spark, sf_dir).where("n_tokens > 0").count() == 0


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    want = {r.doc_id: sentencepiece_fst.compiled(queries.model_file()).encode(r.text) for r in docs.collect()}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and all(pii.pseudonymise(r.text, corpus_pipeline.PII_KEY) for r in docs.collect())
