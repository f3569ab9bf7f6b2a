import math

import numpy as np

from weir.llm import exact_search
from weir.llm.exact_search import blocks, grouped, scores, top_k


def brute(rows, k, each=50):
    floor = lambda v: [math.floor(256 * x) for x in v]
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = min(good.get(i, v), v)
    out = set()
    for q, v in good.items():
        if q % each == 0:
            dots = sorted((-sum(a * b for a, b in zip(floor(v), floor(w))), i) for i, w in good.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(dots[:k])}
    return out


def check(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, v string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, "vec_id % 50 = 0", k=k, **sizes).collect()}
    assert got == brute(rows, k)


def test_ties_and_many_blocks(spark):
    pick = np.random.default_rng(1)
    rows = [(i, pick.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)] + [(i, [1.0, 1.0, 0.5, 0.0]) for i in range(1000, 1300)]
    check(spark, rows, query_rows=3, candidate_rows=50)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (100, []), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (5, [3.0, -1.0, 2.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [0.0, 9.0])]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])


def test_large_numbers_are_exact():
    a = np.array([[2.0 ** 40, 3.0]])
    assert scores(a, np.array([[2.0 ** 15, 1.0]]))[0, 0] == 2 ** 55 + 3
    assert scores(a, np.array([[2.0 ** 60, 1.0]]))[0, 0] == 1 << 61


def test_huge_components(spark):
    """Finite components whose products are beyond all doubles: scores are held at 2**61, ties go to the smaller id."""
    rows = [(0, [1e307, 0.0]), (1, [1e308, 1.0]), (2, [-1e307, 0.0]), (3, [0.5, 0.5]), (4, [float("inf"), 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1 << 61), (3, 1 << 61), (2, -(1 << 61))]


def test_blocks_are_not_broadcast(spark):
    """Files of blocks are small where vectors are alike; their copies for the other side are not."""
    rows = spark.range(3000).selectExpr("id as vec_id", "array(1.0D, 2.0D, 3.0D) as embedding")
    plan = top_k(rows, "vec_id % 5 = 0", query_rows=8, candidate_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_groups_are_few_and_bounded(spark, monkeypatch):
    rows = spark.range(2000).selectExpr("id", "array(double(id % 7), 2.0D) as v")
    few, many = blocks(rows.where("id % 10 = 0"), 50, 256), blocks(rows, 40, 256)  # 4 and 50 rows a block, four bytes each
    assert grouped(few, many, 50, 40) == (1, 10)  # a copy of the candidates, and ten of the queries that weigh as much
    most = many.selectExpr("max(length(flat))").first()[0]
    monkeypatch.setattr(exact_search, "CANDIDATE_BYTES", 2 * most)
    assert grouped(few, many, 50, 40) == (1, 20)
    monkeypatch.setattr(exact_search, "QUERY_BYTES", 1)
    assert grouped(few, many, 50, 40) == (50, 40)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_search, "QUERY_BYTES", 40)
    monkeypatch.setattr(exact_search, "CANDIDATE_BYTES", 300)
    pick = np.random.default_rng(2)
    rows = [(i, pick.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(i, [1.0, 1.0, 0.5]) for i in range(1000, 1200)]
    check(spark, rows, query_rows=2, candidate_rows=20)


def test_components_keep_their_values_in_every_number_type(spark):
    pick = np.random.default_rng(3)
    rows = [(i, (pick.normal(size=3) * 10.0 ** (i % 6)).tolist()) for i in range(200)]
    check(spark, rows, query_rows=3, candidate_rows=7)
    rows = spark.createDataFrame([(0, [127.0, -127.0]), (1, [128.0, -128.0]), (2, [-32768.0]), (3, [2.0 ** 31]), (4, [])], "id long, v array<double>")
    found = {r.ids[0]: (r.kind, np.frombuffer(r.flat, r.kind).tolist()) for i in range(5) for r in blocks(rows.where(f"id = {i}"), 1, 1).collect()}
    assert found == {0: ("<i1", [127, -127]), 1: ("<i2", [128, -128]), 2: ("<i4", [-32768]), 3: ("<f8", [2.0 ** 31]), 4: ("<i1", [0])}
