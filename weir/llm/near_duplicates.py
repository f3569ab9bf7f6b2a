"""Near duplicates: MinHash signatures joined through an inverted list per coordinate-value pair.

1. Documents with one and the same shingle set form a class; everything below works on classes.
2. Each class is posted under the rarest of its coordinate-value pairs only. Two signatures that
   agree in at least ``matches`` of ``k`` coordinates share a pair among the first
   ``k - matches + 1`` of any common order (prefix). The order is by frequency, taken from a
   table of ``CELLS`` counters, so that long lists are skipped wherever shorter ones decide.
3. Every list first links its members to one leader, the member met most often; members that are
   connected this way need no pair of their own. Members of lists that still hold several
   components are posted once more, under the rarest of their shingles. Crowded lists of these have a leader
   again, so that copies of one text are linked through it; then members of different components are joined by
   prefix, position and shared count: a text with too many shingles of its own meets nobody, so that a crowd of
   copies below the limit does not become a crowd of pairs.
4. A pair with a leader is dropped if the signatures agree in fewer than ``matches`` places; all
   other pairs are confirmed on the full shingle sets.

A pair at the limit of 85 % agrees in fewer than 40 of 64 places with probability below 1e-5.
Classes and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.common import few, parts, written
from weir.llm.shingles import Signer, overlap, shingle_sets, tokens

CELLS = 1 << 18

#: Bytes of text that a task takes apart at a time; it needs about 60 times that.
TEXT_AT_ONCE = 1 << 20

#: Pairs (their texts or signatures), or texts, that a task takes at least, however many partitions a shuffle has.
TEXTS_A_TASK = 500

#: A list with more members than this is crowded: a leader goes first there.
CROWD = 8


def _sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, hashes, edges and numbers of words of some rows at a time (about TEXT_AT_ONCE bytes)."""
    length = np.array(pa.compute.binary_length(texts).fill_null(0), np.int64)
    part = np.cumsum(length) // TEXT_AT_ONCE
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
    for a, b in zip(edges.tolist(), np.r_[edges[1:], len(part)].tolist()):
        yield a, *shingle_sets(texts.slice(a, b - a).to_pylist(), size)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int = 64, size: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, text_hash (NULL if the text is), ``keep``, n_words, n_shingles, node (class of equal sets, NULL if empty),
    sig (binary, NULL if empty)."""
    named = [F.col(c).alias(f"keep_{c}") for c in keep or []]
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.when(F.col(text).isNotNull(), F.xxhash64(text)).alias("text_hash"), *named)
    fields = [f for f in rows.schema.fields if f.name != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k)
        for batch in batches:
            words, n, node, sig = [], [], [], []
            for _, values, edges, n_words in _sets(batch.column(0), size):
                signed = signer(values, edges)
                words += n_words.tolist()
                n += np.diff(edges).tolist()
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    node.append(xxhash.xxh3_64_intdigest(values[a:b]) - (1 << 63) if b > a else None)
                    sig.append(signed[i].tobytes() if b > a else None)
            made = [pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], [*batch.schema.names[1:], "n_words", "n_shingles", "node", "sig"])

    made = T.StructType([*fields, *T._parse_datatype_string("n_words long, n_shingles long, node long, sig binary").fields])
    return rows.mapInArrow(sign, made)


def frequencies(values: DataFrame, tokens_of: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How many tokens of all ``values`` (one binary column) fall into each of ``CELLS`` counters: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for found in tokens_of(batch.column(0)):
                total += np.bincount((found % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = values.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).coalesce(parts(CELLS, 1 << 14))
    table, found = np.zeros(CELLS, np.int64), rows.toArrow()  # at most CELLS rows, whatever the input; as columns, not as Python objects
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    return table


def _rarest(t: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` tokens by frequency, then by value: an order common to all rows."""
    return t[np.lexsort((t, count[(t % np.uint64(CELLS)).astype(np.int64)]))[:size]]


def _coordinates(sig: bytes) -> np.ndarray:
    return tokens(np.frombuffer(sig, np.uint32))


def _all_coordinates(sigs: pa.Array) -> Iterator[np.ndarray]:
    """Coordinates of many signatures at a time: counting them takes a pass over all counters."""
    for at in range(0, len(sigs), 4096):
        yield np.concatenate([_coordinates(x.as_py()) for x in sigs.slice(at, 4096)])


def postings(classes: DataFrame, table: np.ndarray, matches: int) -> DataFrame:
    """(token, node, n): each class under the rarest k - matches + 1 of its coordinate-value pairs."""
    shared = classes.sparkSession.sparkContext.broadcast(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            out = []
            for value in batch.column(2):
                t = _coordinates(value.as_py())
                out.append(_rarest(t, count, len(t) - matches + 1).view(np.int64))
            if out:
                each = np.repeat(np.arange(len(out)), [len(x) for x in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out)), batch.column(0).take(pa.array(each)), batch.column(1).take(pa.array(each))], ["token", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(post, "token long, node long, n long")


def fetched(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of ``source``, once a node, for the nodes of ``wanted`` and few others. However often a text is
    repeated, a task passes it on once."""
    return likely(source, wanted, ["node"]).dropDuplicates(["node"])


def prefixes(texts: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, part, n, rare) of texts (node, part, text): size of the shingle set, and the rarest ``100 - percent`` % of it."""
    rows = texts.select("node", "part", "text")
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(rows.select("text"), lambda texts: (values for _, values, _, _ in _sets(texts, size))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            sets = [values[a:b] for _, values, edges, _ in _sets(batch.column(2), size) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            rare = [_rarest(t, count, len(t) + percent * len(t) // -100 + 1).view(np.int64) for t in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(t) for t in sets], pa.int64()), pa.array(rare, pa.list_(pa.int64()))], ["node", "part", "n", "rare"])

    return written(rows.mapInArrow(first, "node long, part long, n long, rare array<long>"), "prefixes")


def rare_lists(rare: DataFrame) -> DataFrame:
    """(token, at, node, part, n, met) of ``prefixes``: their shingles that members of different parts share, the place in
    the prefix and the length of the list. Most rare shingles are of one text or one part: they make no pair."""
    token = Window.partitionBy("token")
    posted = rare.select("node", "part", "n", F.posexplode("rare").alias("at", "token")).withColumns(
        {"met": F.count("*").over(token), "x": F.min("part").over(token), "y": F.max("part").over(token)})
    most = rare.agg(F.sum(F.size("rare"))).first()[0] or 0
    return written(few(posted.where("x <> y").select("token", "at", "node", "part", "n", "met"), most), "shared")


def crowd_leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different parts: in every crowded list of a rare shingle (``rare_lists``), the member with most
    such lists against all others. A text that others were made of has no shingles of its own, so it is in most lists."""
    crowded = lists.where(F.col("met") > CROWD).withColumn("degree", F.count("*").over(Window.partitionBy("node")))
    led = crowded.withColumn("lead", F.max(F.struct("degree", "node", "n", "part")).over(Window.partitionBy("token")))
    close = 100 * F.least("lead.n", "n") >= percent * F.greatest("lead.n", "n")
    return led.where(close & (F.col("lead.part") != F.col("part"))).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()


def shingle_pairs(lists: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different parts that can reach ``percent``: they share a shingle among their
    rarest (``lists``: ``rare_lists`` of ``rare``), at places that leave enough to share, and
    enough of these rare shingles altogether. No pair that reaches it is left out."""
    # The smaller text of a pair shares at least what two texts of its size must: it is indexed under fewer shingles. So
    # texts of one template that stay below the limit, each with enough of its own, do not meet under the template's shingles.
    left = lists.where(F.expr(f"at <= n * {100 - percent} div {100 + percent}")).select(
        "token", F.col("at").alias("at_a"), F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"))
    close = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    reach = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= percent * (F.col("n_a") + F.col("n"))
    smaller = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("a") < F.col("node")))
    met = lists.join(left, "token").where(smaller & (F.col("part_a") != F.col("part")) & close & reach).select("a", F.col("node").alias("b")).distinct()
    met = written(met, "met")
    # What both prefixes share and all that lies behind one of them is the most that two sets can share.
    rare = rare.select("node", "n", "rare")
    sides = [likely(rare, met.select(F.col(x).alias("node")), ["node"]).toDF(x, f"n_{x}", f"rare_{x}") for x in ("a", "b")]
    both = met.join(sides[0], "a").join(sides[1], "b")
    behind = F.greatest(F.col("n_a") - F.size("rare_a"), F.col("n_b") - F.size("rare_b"))
    most = F.size(F.array_intersect("rare_a", "rare_b")) + behind
    return written(few(both.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), met.count(), 5_000), "near")


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Those of ``rows`` whose keys may be in ``wanted``, before they are shuffled: all that are, and a share of the others that
    grows with ``wanted`` (a quarter at five million). The bits stand in a table of at most ``CELLS`` rows."""
    place = F.pmod(F.xxhash64(*keys), F.lit(CELLS * 64))
    at = {"__cell": F.shiftright(place, 6), "__bit": place.bitwiseAND(63).cast("int")}
    cells = wanted.withColumns(at).groupBy("__cell").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")).coalesce(parts(CELLS, 1 << 14))
    return rows.withColumns(at).join(F.broadcast(cells), "__cell").where(F.getbit("__bits", F.col("__bit")) == 1).select(*rows.columns)


def agreeing(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``matches`` places."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [int((np.frombuffer(x.as_py(), np.uint32) == np.frombuffer(y.as_py(), np.uint32)).sum()) >= matches
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sig = classes.select("node", "sig")
    sides = [likely(sig, pairs.select(F.col(x).alias("node")), ["node"]).toDF(x, f"sig_{x}") for x in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(test, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full shingle sets. ``pairs`` are read four times."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.array(batch.column(0))
            lead = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []  # rows of one leader often come together
            left = [values[x:y] for _, values, edges, _ in _sets(batch.column(2).take(pa.array(lead, pa.int64())), size)
                    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
            which = np.cumsum(np.isin(np.arange(len(a)), lead)) - 1
            keep = []
            for row, values, edges, _ in _sets(batch.column(3), size):
                for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    one = left[which[row + i]]
                    common = overlap(one, values[x:y])
                    keep.append(100 * common >= percent * (len(one) + y - x - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select("a").union(pairs.select("b")).toDF("node")
    t = likely(texts.select("node", "text"), ids, ["node"])
    both = pairs.join(t.toDF("b", "text_b"), "b").join(t.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(test, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable over ``links`` (a, b); nodes without links are absent.

    Labels spread to neighbours, then each label is replaced by its own label, until nothing
    changes; every round is written to the shared folder.
    """
    edges = written(few(links.union(links.select("b", "a")).toDF("node", "other").where("node <> other").distinct(), 2 * links.count()), "edges")
    rows = edges.count()
    labels = edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label"))
    while True:
        near = edges.join(labels.toDF("other", "l"), "other").groupBy("node").agg(F.min("l").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.toDF("new", "jump")
        after = written(few(spread.join(jump, "new").select("node", "label", F.least("new", "jump").alias("new")), rows), "labels")
        changed = after.where("new <> label").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, size: int = 5,
                    k: int = 64, matches: int = 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents without words are linked with nothing. Rows with a NULL doc_id are not linked: their
    component_id is NULL and they are kept. Rows that repeat a doc_id are one document each.
    Only the two named columns are read.
    """
    known = F.col("doc_id").isNotNull()
    found = linked(docs, doc_id, text, percent, size, k, matches)
    return found.select("doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, size: int = 5, k: int = 64, matches: int = 40,
           keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, ``keep`` (as keep_...), n_words, n_shingles, component_id, leads.

    ``component_id`` is that of the text, also in rows without an id; NULL where no row with an id has the same
    words. ``leads``: the row is (one of the equal rows that are) the first document of its component.
    """
    all_rows = written(signatures(docs, doc_id, text, k, size, keep), "signatures")
    some = all_rows.where("node is not null and doc_id is not null")
    # From here on a class is named by its first document: a name that every row of ``docs`` can tell, so texts are fetched by it.
    classes = written(few(some.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig")).select(
        F.col("node").alias("class"), F.xxhash64("first.doc_id", "first.text_hash").alias("node"), "first", "n", "sig"), some.count(), 5_000), "classes")
    source = docs.where(F.col(doc_id).cast("long").isNotNull()).select(
        F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("node"), F.col(text).cast("binary").alias("text"))
    token = Window.partitionBy("token")
    posted = postings(classes, frequencies(classes.select("sig"), _all_coordinates), matches)
    lists = written(few(posted.withColumn("met", F.count("*").over(token)).where("met > 1"), classes.count() * (k - matches + 1)), "lists")
    n_listed = lists.count()
    degree = lists.withColumn("degree", F.sum("met").over(Window.partitionBy("node")))
    led = written(few(degree.withColumn("lead", F.max(F.struct("degree", "node", "n")).over(token)).where(F.col("lead.node") != F.col("node")).select(
        "token", "met", "node", "n", F.col("lead.node").alias("a"), F.col("lead.n").alias("n_a")), n_listed), "led")
    close = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    star = written(few(led.where(close).select("a", F.col("node").alias("b")).distinct(), n_listed), "star")
    agreed = written(few(agreeing(star, classes, matches), star.count(), TEXTS_A_TASK), "agreed")
    texts = fetched(source, agreed.select("a").union(agreed.select("b")).toDF("node"))
    links = written(few(confirmed(agreed, texts, percent, size), agreed.count(), TEXTS_A_TASK), "links")
    found = components(links)
    # The leader has met every member of its list; what is left are pairs of other members.
    member = led.where("met > 2").join(found, "node", "left").select("token", "node", F.coalesce("label", "node").alias("part"))
    mixed = member.withColumns({"x": F.min("part").over(token), "y": F.max("part").over(token)}).where("x <> y")
    members = written(few(mixed.select("node", "part").distinct(), n_listed), "mixed")
    texts = written(few(fetched(source, members).join(members, "node").select("node", "part", "text"), members.count(), TEXTS_A_TASK), "members")
    rare = prefixes(texts, percent, size)
    shared = rare_lists(rare)
    crowd = written(few(crowd_leaders(shared, percent), shared.count()), "crowd")
    links = links.union(written(few(confirmed(crowd, texts, percent, size), crowd.count(), TEXTS_A_TASK), "links"))
    found = components(links)
    shared = shared.drop("part").join(found, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
    tried = star.union(crowd)
    rest = shingle_pairs(shared, rare, percent)
    n_near = rest.count()
    rest = rest.join(tried.toDF("b", "a"), ["a", "b"], "left_anti").join(tried, ["a", "b"], "left_anti")
    rest = written(few(rest, n_near), "pairs")
    more = written(few(confirmed(rest, texts, percent, size), rest.count(), TEXTS_A_TASK), "links")
    found = components(links.union(more))
    firsts = classes.select("class", "node", "first")
    smallest = likely(firsts, found, ["node"]).join(found, "node").groupBy("label").agg(F.min("first").alias("lead"))
    by_node = firsts.join(found.join(smallest, "label").select("node", "lead"), "node", "left").withColumn("lead", F.coalesce("lead", "first")).select(
        F.col("class").alias("node"), F.col("lead.doc_id").alias("component_id"), F.col("lead.text_hash").alias("lead_hash"))
    return all_rows.drop("sig").join(by_node, "node", "left").withColumn(
        "leads", F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("lead_hash")), F.lit(False))).drop("lead_hash", "node")
