import re

import numpy as np
import pytest

from weir.llm.substrings import without_repeats


def brute(rows, window=13):
    """Index of row -> kept words, by comparing every window."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def check(df, rows, **more):
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in without_repeats(df, **more).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_shared_passages(spark):
    pick = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in pick.integers(0, 3000, n)]
    passages = [words(int(n)) for n in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(300):
        text = words(int(pick.integers(0, 80)))
        for p in pick.integers(0, len(passages), 2):
            text += passages[p][int(pick.integers(0, 8)):] + words(int(pick.integers(0, 20)))
        rows.append((int(pick.integers(0, 10 ** 9)), " ".join(text)))
    rows += [(10 ** 9 + i, rows[0][1]) for i in range(30)] + [(5, " ".join(["same"] * 40)), (7, " ".join(["same"] * 50))]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, bucket_words=2000)


@pytest.mark.parametrize("repeat", [1, 3])
def test_odd_rows(odd_docs, repeat):
    df = odd_docs
    for _ in range(repeat - 1):
        df = df.union(odd_docs)
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_spans(spark):
    a = [f"a{i}" for i in range(30)]
    rows = [(1, " ".join(a)), (2, " ".join(["x", "y", *a[5:25], "z"]))]
    row = without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first()
    assert [(s["first"], s["words"]) for s in row.repeats] == [(2, 20)] and row.text == "x y z"


def test_empty(no_docs):
    assert without_repeats(no_docs).count() == 0
