import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weir.llm import near_duplicates as module
from weir.llm.near_duplicates import near_duplicates


def brute(rows, percent=85):
    """doc_id -> (n_shingles, component_id) by exact sets and union-find."""
    sets = {}
    for i, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top, holders, common = {i: i for i in sets}, defaultdict(list), defaultdict(int)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sorted(sets.items()):
        common.clear()
        for g in s:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, c in want.values()}) < len(want)


def test_odd_rows(odd_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_docs).collect()}
    assert {(1, 76, 1, True), (2, 76, 1, False), (8, 76, 1, False), (9, 76, 1, False), (13, 77, 1, False), (3, 0, 3, True), (4, 0, 4, True),
            (5, 0, 5, True), (None, 76, None, True), (10, 1, 10, True), (11, 1, 11, True)} <= got
    assert near_duplicates(odd_docs).count() == odd_docs.count()


def test_chain_and_hub(spark):
    """A hub with copies that are far from each other, and a chain: components follow links, not pairs with one leader."""
    base = [f"b{i}" for i in range(400)]
    rows = [(100 + k, " ".join(base[:k * 9] + [f"new{k}"] + base[k * 9 + 1:])) for k in range(40)] + [(7, " ".join(base))]
    chain = [(500 + k, " ".join([f"c{i}" for i in range(k * 8, k * 8 + 200)])) for k in range(20)]
    got = near_duplicates(spark.createDataFrame(rows + chain, "doc_id long, text string"))
    want = brute(rows + chain)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert len({c for _, c in want.values()}) == 2


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_repeated_rows_are_one_text(spark, monkeypatch):
    """Two near copies, each row repeated 2,000 times, and a third text: a few pairs are checked, not millions."""
    base = [f"b{i}" for i in range(100)]
    copies = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"]))] * 2000
    checked = []

    def confirmed(pairs, texts, *rest):
        checked.append(texts.join(pairs, texts.node == pairs.a).count())
        return plain(pairs, texts, *rest)

    plain = module.confirmed
    monkeypatch.setattr(module, "confirmed", confirmed)
    docs = spark.createDataFrame(copies + [(3, "quite another text of its own")], "doc_id long, text string").repartition(8)
    got = near_duplicates(docs).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 2000), (2, 1, 2000), (3, 3, 1)} and sum(checked) <= 1


def test_sets_of_a_batch():
    """Shingle sets of many texts at once: words split at ASCII white space only, A-Z as a-z, other letters as they are."""
    from weir.llm.shingles import shingle_sets

    texts = [b"", None, b"  ", b"a b c d e f", b"A\tB\nC\x0bd  e\x0cF ", "\u00c9 b c d e".encode(), "\u00e9 b c d e".encode(), b"one two", b"two one", b"one two", b"a b c d e a b c d e a b"]
    values, edges, words = shingle_sets(texts)
    sets = [values[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert words.tolist() == [0, 0, 0, 6, 6, 5, 5, 2, 2, 2, 12] and [len(s) for s in sets] == [0, 0, 0, 2, 2, 1, 1, 1, 1, 1, 5]
    assert sets[3] == sets[4] and sets[7] == sets[9] != sets[8] and sets[5] != sets[6] and all(s == sorted(s) for s in sets)


@pytest.mark.parametrize("own", [14, 16])
def test_crowd_of_one_template(spark, own):
    """Texts that share all but ``own`` words: 84 to 86 % alike, so the limit runs between them; some copies among them."""
    shared = [f"s{i}" for i in range(164)]
    rows = [(i, " ".join(shared + [f"o{i // 2 if i < 20 else i}x{j}" for j in range(own)])) for i in range(150)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)


def test_a_crowd_around_one_text_makes_few_pairs(spark, monkeypatch):
    """Copies with one, two or three changed words, within the limit of their source but not of each other: linked through it, not pair by pair."""
    pick, base = random.Random(4), [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        words, at = list(base), pick.randrange(5, 140)
        for j, place in enumerate([at, pick.randrange(5, 140)][:1 + i % 2] if i % 3 else [at, at + 1, at + 2]):
            words[place] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    tried = []

    def counted(*args):
        tried.append(module.written(plain(*args), "tried"))
        return tried[-1]

    plain = module.shingle_pairs
    monkeypatch.setattr(module, "shingle_pairs", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert sum(t.count() for t in tried) < 4 * len(rows)


def test_counting_takes_many_signatures_at_a_time():
    """One pass over the counters for a batch, not one for each signature."""
    sigs = pa.array([np.arange(64, dtype=np.uint32).tobytes()] * 5000)
    assert [len(x) for x in module._all_coordinates(sigs)] == [4096 * 64, 904 * 64]


def test_likely_rows_hold_all_wanted(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 7 = 0, null, id * 3) as h", "'t' as text")
    wanted = spark.range(0, 20_000, 40).selectExpr("id", "id * 3 as h", "1 as node")
    got = module.likely(rows, wanted, ["id", "h"])
    assert got.columns == rows.columns and got.count() < 700
    assert got.join(wanted, ["id", "h"]).count() == rows.join(wanted, ["id", "h"]).count()
    assert module.likely(rows, wanted.where("false"), ["id", "h"]).count() == 0


def test_only_texts_of_pairs_are_shuffled_to_be_confirmed(spark):
    texts = spark.range(5000).selectExpr("id as node", "cast(concat_ws(' ', 'a b c d e', if(id < 3, 'x', string(id))) as binary) as text")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    got = module.confirmed(pairs, texts, 85, 5)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (1, 2)]
    assert "__cell" in got._jdf.queryExecution().executedPlan().toString()


def test_texts_are_fetched_for_pairs_that_agree_only(spark, monkeypatch):
    """Two texts that share half of their words meet in lists, but their signatures differ: no text of theirs is kept aside."""
    rows = [(i, " ".join([f"s{i // 2}x{j}" for j in range(60)] + [f"o{i}x{j}" for j in range(60)])) for i in range(60)]
    rows += [(100, " ".join(f"c{j}" for j in range(100))), (101, " ".join(f"c{j}" for j in range(101)))]
    aside, plain = [], module.written

    def counted(df, label):
        made = plain(df, label)
        aside.append(made.count() if "text" in made.columns else 0)
        return made

    monkeypatch.setattr(module, "written", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert sum(aside) <= 2


def test_counters_reach_the_driver_as_columns(spark, monkeypatch):
    """A quarter of a million counters: no Python object for each."""
    def collect(df):
        raise AssertionError("rows as Python objects")

    values = spark.createDataFrame([(np.arange(i, i + 64, dtype=np.uint32).tobytes(),) for i in range(40)], "sig binary")
    monkeypatch.setattr(type(values), "collect", collect)
    table = module.frequencies(values, module._all_coordinates)
    assert len(table) == module.CELLS and table.sum() == 40 * 64
    assert module.frequencies(values.where("false"), module._all_coordinates).sum() == 0


def test_few_links_take_few_tasks(spark):
    """Small results are written and read by few tasks, however many partitions a shuffle has."""
    held = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = module.written(spark.range(1, 10).selectExpr("id as a", "id + 1 as b"), "chain")
    context = spark.sparkContext
    for k, v in held.items():
        spark.conf.set(k, v)
    context.setJobGroup("chain", "components of a chain")
    try:
        labels = module.components(links).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("chain") for s in tracker.getJobInfo(j).stageIds]
    assert {(r.node, r.label) for r in labels} == {(i, 1) for i in range(1, 11)}
    assert sum(s.numCompletedTasks for s in stages if s) < 1000
