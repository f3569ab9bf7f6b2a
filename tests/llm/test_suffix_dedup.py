"""Suffix-array dedup: the suffix order and the removal, each against brute force."""

import random

import numpy as np
import pytest

from weir.llm import induced, suffix_dedup


def plain_order(strings):
    out, at = [], 0
    for s in strings:
        out += [(s[i:], at + i) for i in range(len(s) + 1)]
        at += len(s) + 1
    out.sort()
    low = [0]
    for (x, _), (y, _) in zip(out, out[1:]):
        low.append(min(induced.CAP, next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))))
    return out, low


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    """Few and many symbols, NUL bytes, runs, copies and empty strings; memory for 4 suffixes to all of them."""
    r = random.Random(seed)
    symbols, shift = r.choice([1, 2, 2, 3, 26, 256]), r.choice([0, 0, 97])
    strings = [bytes((r.randrange(symbols) + shift) % 256 for _ in range(r.choice([0, 1, 2, 7, 60, 300]))) for _ in range(r.randrange(1, 8))]
    strings += [r.choice(strings)[r.randrange(3):] for _ in range(r.randrange(4))]
    pos, low, _ = induced.suffix_order(strings, r.choice([4, 9, 50, 1 << 20]))
    want, common = plain_order(strings)
    at = {p: s for s, p in want}
    assert [at[p] for p in pos.tolist()] == [s for s, _ in want] and len(set(pos.tolist())) == len(want)
    assert low.tolist() == common


def test_queue_keeps_symbol_then_arrival(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    queue, r = induced.Queue(induced.Scratch(10)), np.random.default_rng(1)
    pushed, taken, n = [], [], 0
    for below in range(1, 30):
        for _ in range(3):
            s = np.sort(r.integers(below - 1, 40, 7))
            queue.push(s, np.arange(n, n + 7), np.zeros(7, np.uint8))
            pushed += list(zip(s.tolist(), range(n, n + 7)))
            n += 7
        taken.append(list(zip(*[x.tolist() for x in queue.take(below)[:2]])))
    assert queue.on_disk and not list(tmp_path.iterdir())  # runs on disk have no name
    left = pushed
    for below, got in zip(range(1, 30), taken):
        assert sorted(got) == got and all(s < below for s, _ in got)
    assert sorted(x for t in taken for x in t) == sorted(x for x in left if x in {y for t in taken for y in t})


def plain_removal(rows, window):
    first, out = {}, []
    for d, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1 if d is not None else 0):
            key = data[i:i + window]
            first[key] = min(first.get(key, (d, i)), (d, i))
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1 if d is not None else 0):
            if first[data[i:i + window]] < (d, i):
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def removal(docs, **options):
    found = suffix_dedup.without_repeats(docs, **options)
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()], key=repr)


@pytest.mark.parametrize("window, options", [(100, {}), (40, {"shard_bytes": 2000, "sort_rows": 64}), (33, {"shard_bytes": 500, "sort_rows": 500})])
def test_equals_brute_force(spark, window, options):
    """Shared passages at any place, overlaps, periodic texts, letters of two bytes, ids with several texts, repeated rows."""
    r = random.Random(window)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(4)] + ["-" * 150, "ab" * 90, "xyz" * 40]
    rows = []
    for i in range(60):
        parts = [r.choice(passages)[r.randrange(20):] if r.random() < 0.4 else " ".join(word() for _ in range(r.randrange(20))) for _ in range(r.randrange(6))]
        rows.append((i % 50, "".join(parts)))
    rows += [(5, rows[5][1]), (None, passages[0]), (70, None), (71, ""), (72, "short"), (73, passages[0] * 3), (74, rows[3][1])]
    docs = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], "doc_id long, text string, start long, name string, n int").repartition(3)
    assert removal(docs, window=window, **options) == plain_removal(rows, window)


def test_one_passage_in_a_third_of_all_documents(spark):
    passage = " ".join(f"term{i}" for i in range(40))
    rows = [(i, f"{i} unlike {i * 7919 % 1009} " * 3 + (passage if i % 3 == 0 else "") + f" tail {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert removal(docs, shard_bytes=20_000) == plain_removal(rows, 100)


def test_long_text_over_slices(spark, monkeypatch):
    """A text of many slices, and one that ends with its beginning."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, text + text[:1500]), (2, "x" + text[3000:4200]), (3, None)]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string")) == plain_removal(rows, 100)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    short = [(d, t) for d, t in rows if len(t or "") < 100_000]
    assert removal(odd_docs.where("length(text) < 100000 or text is null")) == plain_removal(short, 100)
    assert len(removal(odd_docs)) == len(rows)
    assert removal(no_docs) == []


def test_window_out_of_range(no_docs):
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(no_docs, window=20)
