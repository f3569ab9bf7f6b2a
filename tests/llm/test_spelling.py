"""Spelling variants: against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from weir.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(seed, n, symbols="abcé"):
    r = random.Random(seed)
    words = {"".join(r.choice(symbols) for _ in range(r.randrange(2, 10))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        i = r.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "ÿ" + w[i:], w[:i] + r.choice(symbols) + w[i + 1:], w + w[-1], w[0] + w}
    return sorted(w for w in words if len(w) >= 2)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"crowd": 5, "shard_words": 50}), (3, {"crowd": 1, "shard_words": 10_000})])
def test_pairs_equal_brute_force(spark, seed, options):
    """Runs of one letter, words of two letters, accents; halves that are split into parts."""
    words = some_words(seed, 150) + ["aaaaaaa" + "a" * i for i in range(5)]
    words = sorted(set(words))
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r.word, r.near, r.near_n) for r in spelling.pairs(df, **options).collect())
    assert got == sorted((a, b, words.index(b) + 1) for a in words for b in words if one_edit(a, b))


def expected(rows, spoil=None, factor=10, min_chars=7, min_n=2):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if spoil and doc_id is not None and h % spoil == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= min_n and len(w) >= min_chars}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out, key=repr)


def got(found):
    return sorted([(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()], key=repr)


@pytest.mark.parametrize("spoil", [None, 2])
def test_variants_equal_brute_force(spark, spoil):
    """Chains of forms, ties, upper case with and without accents, texts without words."""
    chain = ["election"] * 250 + ["elections"] * 24 + ["selections"] * 2 + ["elektion"] * 3 + ["Überall"] * 30 + ["überall"] * 3 + ["ÜBERALL"] * 2
    tie = ["variantA"] * 20 + ["variantB"] * 20 + ["variant"] * 2
    rows = [(i, " ".join(chain[i::40] + tie[i::40]) + ", x1y2\n") for i in range(40)]
    rows += [(1, "Selections selections"), (None, "election election."), (50, None), (51, ""), (52, "123 --- 漢字")]
    docs = spark.createDataFrame([(a, b, 9, "z", "r") for a, b in rows], "doc_id long, text string, n long, word string, root string").repartition(3)
    assert got(spelling.variants(docs, spoil=spoil)) == expected(rows, spoil)


def test_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in small.limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling.variants(docs, spoil=31, crowd=40, shard_words=500)) == expected(rows, 31)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(spelling.variants(odd_docs, min_chars=4)) == expected(rows, min_chars=4)
    assert got(spelling.variants(no_docs)) == []
