import re
from collections import Counter

import pytest

from weir.llm.line_rules import quality, without_lines


def repeat_words(words):
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)})


@pytest.mark.parametrize("table", ["small", "odd_docs"])
def test_base_equals_brute_force(table, request):
    df = request.getfixturevalue(table)
    want = []
    for r in df.collect():
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(words)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_frequent_lines(spark):
    own = lambda i, n: "\n".join(" ".join(f"d{i}x{k}y{j}" for j in range(10)) for k in range(n))
    rows = [(i, f"Share this  PAGE\n{own(i, 6)}", "a") for i in range(20)] + [(i, "share this page", "b") for i in range(100, 104)]
    rows += [(50, "\n".join(["share this page"] * 30) + "\n" + own(50, 1), "a"), (51, None, "a"), (51, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert got[3].lines_cut == 1 and got[3].words_cut == 3 and got[3].kept and not got[3].base_failed
    assert got[100].lines_cut == 0
    assert got[50].lines_cut == 30 and not got[50].kept
    text = df.where("doc_id = 3").select(without_lines(df.text, __import__("pyspark").sql.functions.lit(got[3].cut_hashes)).alias("t")).first().t
    assert text == own(3, 6)


@pytest.mark.parametrize("n, cut", [(10, 0), (11, 1), (50, 1), (51, 1), (400, 1)])
def test_the_limit_is_the_same_on_every_host(spark, n, cut):
    """More than ten documents, whether the host has eleven or hundreds."""
    rows = [(i, "read more here\n" + " ".join(f"d{i}x{j}" for j in range(60)), "h") for i in range(n)]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.lines_cut, r.kept) for r in got} == {(cut, True)}


def test_documents_are_counted_not_rows(spark):
    """Rows that repeat an id are one document, each cut by its own lines; rows without an id count as none."""
    own = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b\n" + own, None)] * 30 + [(None, "a b\n" + own, None)] * 30 + [(i, "a b", None) for i in range(2, 4)]
    schema = "doc_id long, text string, source string"
    few = quality(spark.createDataFrame(rows, schema)).collect()
    assert len(few) == 62 and {r.lines_cut for r in few} == {0}
    some = quality(spark.createDataFrame(rows + [(4, "A  b", None)], schema), max_docs=3).collect()
    assert {(r.doc_id, r.lines_cut, r.words_cut, r.kept) for r in some if r.n_words > 50} == {(1, 1, 2, True), (None, 1, 2, True)}


def test_lines_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("\n\n",), ("One line",), ("one LINE\nother",)], "text string")
    line = __import__("pyspark").sql.functions
    cut = line.array(line.xxhash64(line.lit("one line")))
    assert [r[0] for r in df.select(without_lines(df.text, cut)).collect()] == [None, "", "\n\n", "", "other"]


def test_empty(no_docs):
    assert quality(no_docs).count() == 0
