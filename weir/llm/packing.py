"""Best-fit packing of documents into training sequences under conflicts.

Documents are dealt into shards of bounded size by a hash of their id and place; each shard is packed by
itself, so no task holds more than a shard. Within a shard the longest pieces go first. Open bins
are held in the order of their free space, each with one bitmap of the sources that have reached
their limit in it and one of the duplicate clusters it holds; the search starts at the smallest
sufficient free space and goes on until a bin without conflict is found: the tightest compatible
one. Only lengths and keys travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import near_duplicates
from weir.llm.common import parts, words

OUT = "row_key long, doc_id long, piece int, start long, length long, shard long, bin long, offset long"


def pack(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each item (length, source bit, cluster bit), best fit in the given order.

    A bin takes at most ``per_source`` items of a source and one of a cluster; a bit below 0
    conflicts with nothing. Ties in free space go to the older bin.
    """
    open_bins: list[tuple[int, int]] = []  # (free space, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    counts: list[dict[int, int]] = []
    placed = []
    for length, source, cluster in items:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & s or clusters[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            free, b = open_bins.pop(at)
        else:
            free, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
            counts.append({})
        placed.append((b, capacity - free))
        clusters[b] |= c
        if s:
            counts[b][source] = counts[b].get(source, 0) + 1
            if counts[b][source] >= per_source:
                sources[b] |= s
        if free > length:
            insort(open_bins, (free - length, b))
    return placed


def best_fit(docs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", source: str = "source", cluster: str = "cluster",
             capacity: int = 2048, per_source: int = 4, shard_rows: int = 4000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length (in tokens), shard, bin, offset.

    A document longer than ``capacity`` is cut into full pieces, which fill bins of their own, and
    a rest that is packed; nothing is dropped. Documents with NULL or no tokens get one piece of
    length 0. NULL sources and clusters conflict with nothing. Repeated rows are packed as often
    as they come. Only the four named columns are read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"),
                       F.col(source).cast("string").alias("s"), F.col(cluster).cast("string").alias("c"))
    shards = parts(docs.count(), shard_rows)
    # Dealt by id and by the place in the input: an id that many rows repeat fills no shard.
    rows = rows.withColumn("row_key", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(shards)))

    def shard_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(rest=frame.n % capacity)
        order = frame.sort_values(["rest", "doc_id", "row_key"], ascending=[False, True, True], na_position="last")
        bits = [pd.factorize(order[x])[0] for x in ("s", "c")]  # NULL becomes -1
        out, full = [], 0
        whole = order.n.to_numpy() // capacity
        keys, ids = order.row_key.to_numpy(), order.doc_id.tolist()
        tight = [i for i in range(len(order)) if order.rest.iat[i] or not whole[i]]
        places = pack([(int(order.rest.iat[i]), int(bits[0][i]), int(bits[1][i])) for i in tight], capacity, per_source)
        used = max((b for b, _ in places), default=-1) + 1
        shard = int(frame.shard.iat[0])
        for i in range(len(order)):
            for p in range(whole[i]):
                out.append((keys[i], ids[i], p, p * capacity, capacity, shard, used + full, 0))
                full += 1
        for i, (b, offset) in zip(tight, places):
            out.append((keys[i], ids[i], whole[i], whole[i] * capacity, order.rest.iat[i], shard, b, offset))
        made = pd.DataFrame(out, columns=["row_key", "doc_id", "piece", "start", "length", "shard", "bin", "offset"])
        return made.assign(doc_id=made.doc_id.astype("Int64"))

    return rows.groupBy("shard").applyInPandas(shard_of, OUT).drop("row_key")


def with_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and cluster (hash of the text; NULL for NULL texts)."""
    return docs.withColumns({"n_tokens": F.size(words(F.col(text))).cast("long"), "cluster": F.xxhash64(text)}).withColumn(
        "cluster", F.when(F.col(text).isNotNull(), F.col("cluster")))


def with_near_clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, n_tokens (words) and cluster of every row: the component of near duplicates.

    Texts with the same words share a cluster, also in rows without an id; where no row with an id has
    a text's words, its cluster is the hash of the text (NULL for a NULL text). The texts are read in
    the one pass that signs them.
    """
    rows = near_duplicates.linked(docs, doc_id, text, percent=80, matches=36, keep=[source])
    return rows.select("doc_id", F.col(f"keep_{source}").alias("source"), F.col("n_words").alias("n_tokens"),
                       F.coalesce(F.concat(F.lit("near:"), F.col("component_id")), F.col("text_hash").cast("string")).alias("cluster"))
