import itertools

import numpy as np
from pyspark.sql import functions as F

from weir.llm import language
from weir.llm.queries import op1_language


def test_marginals_equal_enumeration():
    pick = np.random.default_rng(2)
    for n, cuts in ((1, [0]), (5, [0, 3]), (7, [0, 1, 6])):
        scores, moves, start = pick.normal(size=(n, 3)), pick.normal(size=(3, 3)), pick.normal(size=3)
        first = np.zeros(n, bool)
        first[cuts] = True
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            s = sum(scores[i, y] + (start[y] if first[i] else moves[path[i - 1], y]) for i, y in enumerate(path))
            total += np.exp(s)
            for i, y in enumerate(path):
                want[i, y] += np.exp(s)
        for step in (2, 256):
            assert np.allclose(language.marginals(scores, first, moves, start, step)[3], want / total)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in op1_language(spark, folder).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_code_switched_text(spark, small):
    model = language.train(small)
    part = {lang: " ".join(small.where(F.col("lang") == lang).orderBy(F.desc("n_chars")).first().text.split()[:60]) for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, part["en"] + " " + part["de"])], "doc_id long, text string")
    labels = [r.lang for r in language.label_words(mixed, model).orderBy("position").collect()]
    half = len(labels) // 2
    assert labels[:half].count("en") > 0.9 * half and labels[half:].count("de") > 0.8 * half


def test_odd_rows(odd_docs, no_docs, small):
    model = language.train(small)
    rows = {(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(odd_docs, model, keep=["doc_id", "kept"]).collect()}
    assert {(3, "und", False), (4, "und", False), (5, "und", False), (11, "und", False)} <= rows
    assert language.predict(odd_docs, model, keep=["doc_id"]).count() == odd_docs.count()
    assert language.predict(no_docs, model, keep=["doc_id"]).count() == 0
    nothing = language.train(no_docs)
    assert {r.lang_pred for r in language.predict(odd_docs, nothing, keep=["doc_id"]).collect()} == {"und"}


def test_batch_is_handed_on_in_pieces():
    """A task holds the words and the probabilities of some rows, not those of a batch: what comes out does so piece by piece."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Rows:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
        select = lambda self, *names: self
        mapInArrow = lambda self, label, out: label

    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else "der hund und das haus" if i % 2 else "the dog and the house" for i in range(1050)]
    model = language.fit([("en", "the dog and the cat of the house".split())] * 5 + [("de", "der hund und die katze in das haus".split())] * 5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1050), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = list(language.predict(Rows(), model, keep=["doc_id", "text"])(iter([batch])))
    assert max(b.num_rows for b in got) <= language.ROWS_AT_ONCE < 1050
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == list(enumerate(texts))
    assert [r["lang_pred"] for r in rows] == ["und" if not t else t[:2].replace("th", "en") for t in texts]


def test_probabilities_without_the_parts():
    pick = np.random.default_rng(3)
    scores, first, moves, start = pick.normal(size=(600, 3)), pick.random(600) < 0.02, pick.normal(size=(3, 3)), pick.normal(size=3)
    first[0] = True
    assert (language.marginals(scores, first, moves, start, whole=False) == language.marginals(scores, first, moves, start)[3]).all()
