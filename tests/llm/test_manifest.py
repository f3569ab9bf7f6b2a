"""Merkle manifest: against a plain tree of lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weir.llm import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in COLUMNS)])


def levels(nodes, fanout=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree, at, fanout=3):
    out = []
    for nodes in tree[:-1]:
        run = at // fanout * fanout
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])))
        at //= fanout
    return out


def expected(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    top = levels([trees[s][-1][0] for s in names], fanout)
    out = []
    for g, s in enumerate(names):
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            out.append((x[3], s, x[2], trees[s][-1][0], top[-1][0], siblings(trees[s], i, fanout) + siblings(top, g, fanout)))
    return sorted(out, key=repr)


def got(found):
    return sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in found.collect()], key=repr)


def test_odd_rows_equal_plain_trees(odd_docs):
    """NULLs in every column, repeated rows and ids, a lone leaf, clashing extra columns."""
    assert got(manifest.manifest(odd_docs, COLUMNS)) == expected([r.asDict() for r in odd_docs.collect()])


@pytest.mark.parametrize("fanout, stride", [(3, 3), (2, 1), (3, 2)])
def test_many_leaves_of_one_group(spark, fanout, stride):
    """One group holds nearly all rows; sizes around the edges of a stored subtree."""
    sizes = {"hot": 800, "edge": 27, "over": 28, "": 3, None: 9, "one": 1, "two": 2}
    rows = [(100 * i + j * 7919 % n, s, None if j % 5 else "en", j, f"text {j}\n") for i, (s, n) in enumerate(sizes.items()) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = manifest.manifest(docs, COLUMNS, fanout=fanout, stride=stride)
    assert got(found) == expected([r.asDict() for r in docs.collect()], fanout)


def test_one_group_and_one_row(spark):
    docs = spark.createDataFrame([(7, "s", "en", 4, "text")], "doc_id long, source string, lang string, n_chars long, text string")
    row = manifest.manifest(docs, COLUMNS).first()
    assert row.leaf == row.subroot == row.root and row.path == []


def test_fold_tells_changed_leaves(small):
    other = {"other": manifest.leaf(*[F.col(c) for c in COLUMNS[:-1]], F.upper("text"))}
    found = manifest.manifest(small, COLUMNS, extra=other).withColumns({
        "same": manifest.folded(F.col("leaf"), F.col("path")) == F.col("root"),
        "changed": manifest.folded(F.col("other"), F.col("path")) == F.col("root")})
    rows = found.collect()
    assert len(rows) == small.count() and all(r.same for r in rows)
    assert all(r.changed == (r.other == r.leaf) for r in rows) and not all(r.changed for r in rows)


def test_no_rows(no_docs):
    assert manifest.manifest(no_docs, COLUMNS).count() == 0
