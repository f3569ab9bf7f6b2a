from collections import defaultdict

import numpy as np

from weir.llm.packing import best_fit, pack, with_lengths


def slow_pack(items, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, s, c in items:
        fits = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= length and b["free"] > 0
                and (s < 0 or b["s"].get(s, 0) < per_source) and (c < 0 or c not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"free": capacity, "s": {}, "c": set()})
        b = bins[i]
        out.append((i, capacity - b["free"]))
        b["free"] -= length
        b["s"][s] = b["s"].get(s, 0) + 1
        b["c"].add(c)
    return out


def test_pack_equals_slow_search():
    pick = np.random.default_rng(3)
    for _ in range(20):
        items = [(int(pick.integers(0, 101)), int(pick.integers(-1, 5)), int(pick.integers(-1, 40))) for _ in range(300)]
        assert pack(items, 100, 2) == slow_pack(items, 100, 2)


def check(rows, docs, capacity, per_source):
    total, spans, bins = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.length))
        bins[r.shard, r.bin].append(r)
    for d, n, source, cluster in docs:
        assert sum(length for _, length in spans[d]) == n
        assert sorted(s for s, _ in spans[d]) == [i * capacity for i in range(len(spans[d]))]
    by = {d: (s, c) for d, _, s, c in docs}
    for members in bins.values():
        ends = sorted((r.offset, r.offset + r.length) for r in members)
        assert ends[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        short = [r for r in members if r.length < capacity]
        assert len({by[r.doc_id][1] for r in short}) == len(short)
        for s in {by[r.doc_id][0] for r in short}:
            assert sum(by[r.doc_id][0] == s for r in short) <= per_source
    return total


def test_whole_table(small):
    docs = with_lengths(small)
    rows = best_fit(docs, capacity=512, shard_rows=50).collect()
    check(rows, [(r.doc_id, r.n_tokens, r.source, r.cluster) for r in docs.collect()], 512, 4)


def test_odd_rows(odd_docs, no_docs):
    rows = best_fit(with_lengths(odd_docs), capacity=512).collect()
    n = {}
    for r in rows:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    assert n[6] == 30_000 and n[2] == 160 and n[3] == n[4] == n[5] == 0 and n[None] == 80
    assert best_fit(with_lengths(no_docs)).count() == 0


def test_near_copies_share_no_bin(spark, tmp_path):
    from weir.llm.queries import op8_packing

    base = [f"word{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base).upper(), "  ".join(base), " ".join(base[:-1] + ["other"]), "", "", None, "another text of its own"]
    texts += [" ".join(base)]  # without an id
    docs = spark.createDataFrame([(i if i < 8 else None, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_packing(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and len({(r.shard, r.bin) for r in rows if r.doc_id is None or r.doc_id < 4}) == 5
    assert len({(r.shard, r.bin) for r in rows if r.doc_id in (4, 5)}) == 2
