import math

from weir.llm.mixing import exponent, mix


def shares(spark, tokens):
    total = sum(tokens)
    return spark.createDataFrame([(t / total,) for t in tokens], "p double")


def entropy(tokens, a):
    w = [(t / sum(tokens)) ** a for t in tokens]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def test_exponent_meets_entropy(spark):
    tokens = [5000, 300, 200, 100, 40]
    a = exponent(shares(spark, tokens), target_entropy=0.9)
    assert abs(entropy(tokens, a) - 0.9 * math.log(5)) < 1e-6


def test_exponent_meets_repetition(spark):
    tokens = [5000, 300, 200, 100, 40]
    a = exponent(shares(spark, tokens), max_repeat=3, budget=1.0)
    z = sum((t / 5640) ** a for t in tokens)
    assert abs((40 / 5640) ** (a - 1) / z - 3) < 1e-5
    assert exponent(shares(spark, tokens), max_repeat=1e9, budget=1.0) == 0.0
    assert exponent(shares(spark, [7]), target_entropy=0.5) == 1.0


def test_budget_and_passes(small):
    rows = mix(small, block_docs=3).collect()
    assert len(rows) == small.count()
    used, budget, tokens, longest = {}, {}, {}, {}
    for r in rows:
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
        budget[r.source], tokens[r.source] = r.source_budget, r.source_tokens
        longest[r.source] = max(longest.get(r.source, 0), r.n_tokens)
    for s in used:
        assert budget[s] - longest[s] < used[s] <= budget[s]
        own = sorted((r.before, r.n_tokens) for r in rows if r.source == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_every_document_once_without_budget(small):
    rows = mix(small, target_entropy=None, max_repeat=2.0, budget=None).collect()
    assert min(r.copies for r in rows) >= 1 and max(r.copies for r in rows) <= 3


def test_odd_rows(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert mix(no_docs).count() == 0 and mix(odd_docs.where("text is null")).first().copies == 1
