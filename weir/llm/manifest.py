"""Merkle manifest of a dataset: a hash tree per group, and one tree over the groups' roots.

Checkpoint and recompute. Only every ``stride``-th level of a tree is stored; a node of a stored
level stands for an aligned subtree of ``fanout ** stride`` nodes of the stored level below.
Proofs go from the roots down: each aligned subtree regenerates its interior nodes from the stored
nodes below it, hands every one of them its siblings, and drops them again. So a proof costs one
grouping of bounded size (27 nodes) and one join per stored level, whatever the size of a group:
a group that holds a third of all rows is split into as many subtrees as it has nodes / 27.

Texts are hashed where they are read; only digests and keys travel. Positions inside a group come
from a range partitioning of (group, id), numbered part by part, so no group passes through one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import written

PATH = "array<struct<before:string,after:string>>"
_ROW_BITS = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as text behind its UTF-8 byte count and a colon, NULL as ``-``."""
    text = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


@dataclass
class Tree:
    """Stored levels of all trees, leaves first: (tree, pos, digest, n), n nodes being on that level of the tree."""

    levels: list[DataFrame]
    fanout: int
    stride: int

    @property
    def roots(self) -> DataFrame:
        """(tree, digest): one row per tree."""
        found = [x.where("n = 1").select("tree", "digest") for x in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, key, digest, ...) with pos, their place (from 0) in their tree by key and digest, and n, the tree's size."""
    order = ["tree", "key", "digest", "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    dealt = written(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))}), "leaves")
    # One row for each part and tree in it: no more than parts plus trees.
    heads = dealt.groupBy("tree", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("tree").orderBy("__part")
    heads = heads.select(F.col("tree").alias("__t"), F.col("__part").alias("__p"), "__first", F.sum("__n").over(Window.partitionBy("tree")).alias("n"),
                         (F.sum("__n").over(before) - F.col("__n")).alias("__ahead"))
    both = dealt.join(heads, (F.col("__part") == F.col("__p")) & F.col("tree").eqNullSafe(F.col("__t")))
    return both.withColumn("pos", F.col("__ahead") + F.col("__row") - F.col("__first")).drop("__part", "__row", "__t", "__p", "__first", "__ahead", "key")


def _lifted(nodes: Column, fanout: int) -> Column:
    """The level above ``nodes`` (digests, left to right)."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), ""), 256))


def _subtrees(level: DataFrame, fanout: int, stride: int, *payload: str) -> DataFrame:
    """One row per aligned subtree: tree, n, block, items (pos, digest, payload), and its interior levels l0 (stored), l1, ..."""
    items = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    grouped = level.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {fanout ** stride}").alias("block")).agg(items.alias("items"))
    grouped = grouped.withColumn("l0", F.col("items")["digest"])
    for i in range(stride):  # a tree that ends inside this stride has its root on the last level that it reaches
        below = F.col(f"l{i}")
        grouped = grouped.withColumn(f"l{i + 1}", F.when(F.col("n") > fanout ** i, _lifted(below, fanout)))
    return grouped


def build(rows: DataFrame, fanout: int = 3, stride: int = 3) -> Tree:
    """Trees over ``rows`` (tree, key, digest, ...), ordered by key; other columns stay with the leaves.

    NULL trees are one tree, NULL keys come first, equal keys go by digest. Every ``fanout``
    consecutive nodes (the last run: fewer) make one above until one remains; a lone leaf is its root.
    """
    levels, size = [placed(rows)], fanout ** stride
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tops = F.coalesce(*[F.col(f"l{i}") for i in range(stride, 0, -1)])
        up = _subtrees(levels[-1].select("tree", "pos", "digest", "n"), fanout, stride).select(
            "tree", F.col("block").alias("pos"), tops[0].alias("digest"), F.ceil(F.col("n") / size).alias("n"))
        levels.append(written(up, "level"))
    return Tree(levels, fanout, stride)


def _siblings(nodes: Column, at: Column, fanout: int) -> Column:
    """The others of the run that holds place ``at`` of ``nodes``: those before it and those after it."""
    inside = F.pmod(at, F.lit(fanout))
    cut = lambda start, n: F.array_join(F.slice(nodes, start, n), "")
    return F.struct(cut((at - inside + 1).cast("int"), inside.cast("int")).alias("before"), cut((at + 2).cast("int"), (fanout - 1 - inside).cast("int")).alias("after"))


def paths(tree: Tree, top: DataFrame, *payload: str) -> DataFrame:
    """(tree, digest, payload, path, columns of ``top``) for every leaf.

    ``path`` holds the siblings level by level, those of ``top`` (tree, path, ...) last: what
    lies above the root of each tree.
    """
    fanout, stride = tree.fanout, tree.stride
    extra = [c for c in top.columns if c not in ("tree", "path")]
    above = None
    for depth in reversed(range(len(tree.levels))):
        carried = payload if depth == 0 else ()
        level = tree.levels[depth]
        t = top.withColumnRenamed("tree", "__t")
        out = level.where("n = 1").join(t, F.col("tree").eqNullSafe(F.col("__t"))).select("tree", "pos", "digest", *carried, "path", *extra)
        if above is not None:
            blocks = _subtrees(level, fanout, stride, *carried)
            over = above.select(F.col("tree").alias("__t"), F.col("pos").alias("block"), "path", *extra)
            blocks = blocks.join(over, (F.col("tree").eqNullSafe(F.col("__t"))) & (blocks["block"] == over["block"])).drop(over["block"])
            blocks = blocks.select("*", F.posexplode("items").alias("__at", "__item"))
            steps = [F.when(F.col(f"l{i + 1}").isNotNull(), _siblings(F.col(f"l{i}"), F.expr(f"__at div {fanout ** i}"), fanout)) for i in range(stride)]
            own = F.filter(F.array(*steps), lambda x: x.isNotNull())
            out = out.unionByName(blocks.select("tree", *[F.col("__item")[c].alias(c) for c in ("pos", "digest", *carried)],
                                                F.concat(own, F.col("path")).alias("path"), *extra))
        above = out if depth == 0 else written(out, "paths")
    return above.drop("pos")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", group: str = "source", extra: dict[str, Column] | None = None,
             fanout: int = 3, stride: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, the ``extra`` columns, subroot, root, path.

    Leaves ascend by id (NULL first; rows that repeat an id by their digest) in the tree of their
    group; the groups' roots, by group (NULL first, then by UTF-8 bytes), make the tree above.
    An empty table gives no rows. Only the named columns are read; names may clash with those used here.
    """
    more = extra or {}
    rows = docs.select(F.col(group).cast("string").alias("tree"), F.col(doc_id).alias("key"), leaf(*[F.col(c) for c in columns]).alias("digest"),
                       F.col(doc_id).alias("doc_id"), *[v.alias(f"x_{k}") for k, v in more.items()])
    trees = build(rows, fanout, stride)
    subroots = trees.roots
    whole = build(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("source")), fanout, stride)
    no_path = whole.roots.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    top = written(paths(whole, no_path, "source").select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    found = paths(trees, top, "doc_id", *[f"x_{k}" for k in more])
    return found.select("doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), *[F.col(f"x_{k}").alias(k) for k in more], "subroot", "root", "path")
