import random

import pytest
from pyspark.sql import functions as F

from weir.llm.queries import op7_token_counts
from weir.llm.token_counts import VOCABULARY, Counter, Tree, apply_edits, replacements, with_trees

COUNT = Counter(VOCABULARY)


def encoded(text):
    return len(COUNT.encoding.encode_ordinary(text))


def check(tree, text):
    assert tree.total() == encoded(text) and int(tree.chars[1]) == len(text)
    for heap in (tree.chars, tree.tokens):
        assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for i in range(1, tree.size))


@pytest.mark.parametrize("seed", range(8))
def test_random_edits_equal_full_encoding(seed):
    pick = random.Random(seed)
    letters = "ab é1\n  '.s<"
    text = "".join(pick.choice(letters) for _ in range(pick.choice([0, 5, 300, 4000])))
    tree = Tree.build(text, COUNT)
    check(tree, text)
    for _ in range(60):
        start = pick.randint(0, len(text))
        end = min(len(text), start + pick.choice([0, 0, 1, 3, 40, 400]))
        new = "".join(pick.choice(letters) for _ in range(pick.choice([0, 1, 2, 30, 300])))
        want = text[:start] + new + text[end:]
        text, _ = tree.edit(text, start, end, new, COUNT)
        assert text == want
        check(tree, text)


def test_only_the_edited_region_is_encoded():
    text = "some plain words and numbers 12345 " * 5000
    tree = Tree.build(text, COUNT)
    _, pieces = tree.edit(text, 90_000, 90_004, "other", COUNT)
    assert 0 < pieces < 200


def test_query_equals_full_encoding(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    import re

    rows = op7_token_counts(spark, folder).collect()
    assert len(rows) == len(docs) and any(r.n_edits for r in rows)
    for r in rows:
        masked, n = re.subn(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]|[0-9]{6,}", "[masked]", docs[r.doc_id])
        assert (r.n_tokens_before, r.n_edits, r.n_tokens, r.n_chars) == (encoded(docs[r.doc_id]), n, encoded(masked), len(masked))


def test_odd_rows(odd_docs, no_docs):
    trees = with_trees(odd_docs).withColumn("edits", replacements(F.col("text"), "word4[0-9]", "x 1"))
    rows = apply_edits(trees).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.n_tokens == encoded(r.text or "") and "word41" not in (r.text or "")
    assert apply_edits(with_trees(no_docs).withColumn("edits", replacements(F.col("text"), "x", ""))).count() == 0
    long = trees.where("doc_id = 1").withColumn("edits", F.expr("array(named_struct('start', 2, 'end', 6, 'new', 'a'), named_struct('start', 4, 'end', 8, 'new', 'b'))"))
    with pytest.raises(Exception, match="overlaps"):
        apply_edits(long).collect()
