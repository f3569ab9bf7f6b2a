import corpus_pipeline as pipeline
import pytest

import __spark_entry__ as entry
from weir.llm.common import written

FOLDER = "/root/testdata/sf0.01"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids, last = {r.doc_id for r in docs.select("doc_id").collect()}, None
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, FOLDER), f"test-{name}")
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        if name == "language_id":
            assert docs.count() == before.count()  # all of them have a language
        if name == "secret_scan":
            assert docs.count() == before.count() and docs.where("text like '%[secret]%'").count() > 0
            assert docs.where("text rlike 'AKIA[0-9A-Z]{16}'").count() == 0
        if name == "mixing":
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}
        last = before
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in last.collect()} <= ids


@pytest.mark.parametrize("table", ["odd_docs", "no_docs"])
def test_stages_on_odd_rows(spark, request, table):
    docs = request.getfixturevalue(table).select(*pipeline.COLUMNS)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), f"odd-{name}")
    found = {r.doc_id for r in docs.collect()}
    assert found == ({None, 1, 6, 10, 12} if table == "odd_docs" else set())


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()


def test_texts_under_one_id_are_told_apart(spark):
    """Ids may repeat with different texts: each text is kept or goes with its own group."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "ay"}
    rows = [(0, text["a"]), (1, text["a"] + " tail"), (1, text["y"]), (5, text["y"] + " more"), (5, text["y"] + " more"), (7, ""), (None, text["a"])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.deduplicate(spark, docs, FOLDER).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(0, text["a"]), (1, text["y"]), (7, ""), (None, text["a"])], key=repr)
