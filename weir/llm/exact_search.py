"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; a stated set of queries meets all rows block by block. Each round
scores every pair and counts the scores of every query in equal cells of the interval in which
its kth best score must lie; the global sum of these histograms gives the one cell that holds it,
which is the next round's interval, until a cell is a single score. A last pass keeps the scores
above that value, and as many ties at it as fit, smallest id first.

Blocks are dealt out in groups: every group of queries meets every group of candidates in a task,
so a block is copied once for each group of the other side, not for each of its blocks. Groups are
bounded in bytes, and nothing but rows (id, cell) may be broadcast: what a copied block weighs
can't be told from the size of its file. Within a task one pair of blocks is scored at a time.
A task's histogram leaves out what cannot matter: cells below the one in which its group of
candidates alone reaches k scores. No score list is stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.llm.common import parts, written

#: Histogram cells of a round, as a power of two.
CELL_BITS = 10
#: Scores beyond this are held at it, so that differences of scores fit 64 bits.
LIMIT = 1 << 61
#: Bytes of blocks that a group of queries, and one of candidates, holds at most, unless one block is larger.
QUERY_BYTES, CANDIDATE_BYTES = 16 << 20, 32 << 20
#: Tasks of a pass at most.
MOST_TASKS = 2000


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products as int64; exact while they fit, else held at +-LIMIT."""
    width = max(left.shape[1], right.shape[1])
    left, right = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (left, right))
    top = max(1.0, float(np.abs(left).max(initial=0))) * max(1.0, float(np.abs(right).max(initial=0))) * max(1, width)
    if top < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in x.tolist()] for x in (left, right)]
    exact = np.array(whole[0], dtype=object) @ np.array(whole[1], dtype=object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def blocks(rows: DataFrame, count: int, scale: int) -> DataFrame:
    """(block, ids, flat, width, kind): rows (id, v) packed into ``count`` blocks by a hash of the id, components as floor(scale * x)
    in the smallest number type that holds them."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        v = table.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        width = max(1, int(sizes.max(initial=0)))
        flat = np.zeros((len(sizes), width))
        # A product beyond the largest double is held there; its scores are beyond LIMIT in any case.
        with np.errstate(over="ignore"):
            flat[np.arange(width) < sizes[:, None]] = np.floor(np.nan_to_num(scale * v.flatten().to_numpy(zero_copy_only=False).astype(float)))
        top = np.abs(flat).max(initial=0)
        kind = next((k for k in ("<i1", "<i2", "<i4") if top <= np.iinfo(k).max), "<f8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
                         "flat": pa.array([flat.astype(kind).tobytes()], pa.binary()), "width": pa.array([width], pa.int32()), "kind": pa.array([kind])})

    keyed = rows.withColumn("block", block_of("id", count))
    return keyed.groupBy("block").applyInArrow(packed, "block int, ids array<long>, flat binary, width int, kind string")


def block_of(vec_id: str, count: int) -> Column:
    return F.pmod(F.xxhash64(vec_id), F.lit(count)).cast("int")


def grouped(queries: DataFrame, candidates: DataFrame, n_query: int, n_candidate: int) -> tuple[int, int]:
    """Into how many groups the blocks of queries and those of candidates go.

    As few as their bytes allow, so that little is copied; but so many groups of candidates that
    the copies of the queries weigh about as much as those of the candidates, for more tasks.
    """
    weigh = (F.max(F.length("flat")), F.sum(F.length("flat")))
    (q_most, q_all), (c_most, c_all) = ([x or 1 for x in side.agg(*weigh).first()] for side in (queries, candidates))
    query_groups = parts(n_query, max(1, QUERY_BYTES // q_most))
    return query_groups, min(n_candidate, max(parts(n_candidate, max(1, CANDIDATE_BYTES // c_most)), query_groups * c_all // q_all))


def paired(score: Callable[[pa.Table, pa.Table], pa.Table], schema: str, queries: DataFrame, candidates: DataFrame, n_query: int,
           groups: tuple[int, int], state: DataFrame) -> DataFrame:
    """What ``score`` makes of every group of queries (blocks with their state) with every group of candidates."""
    lows = state.groupBy(block_of("id", n_query).alias("block")).agg(F.collect_list(F.struct("id", "low")).alias("state"))
    sides = []
    for side, own, other in ((queries.join(lows.hint("merge"), "block"), 0, 1), (candidates, 1, 0)):
        names = ("q", "c")
        side = side.withColumn(names[own], F.pmod("block", F.lit(groups[own]))).withColumn(names[other], F.explode(F.sequence(F.lit(0), F.lit(groups[other] - 1))))
        sides.append(side.repartition(min(MOST_TASKS, groups[0] * groups[1]), "q", "c").groupBy("q", "c"))
    return sides[0].cogroup(sides[1]).applyInArrow(score, schema)


def _unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each block: ids, vectors, and the lower ends of queries."""
    for i in range(len(table)):
        vectors = np.frombuffer(table.column("flat")[i].as_buffer(), table.column("kind")[i].as_py()).reshape(-1, table.column("width")[i].as_py())
        low = None
        if "state" in table.column_names:  # ids are sorted in the block, and of the same set in the state
            state = table.column("state")[i].values
            low = state.field("low").to_numpy()[np.argsort(state.field("id").to_numpy())]
        yield table.column("ids")[i].values.to_numpy(), vectors.astype(float), low


def _reached(qids: np.ndarray, left: np.ndarray, floor: np.ndarray, ids: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of blocks the scores at or above each query's ``floor``: number of the query in its block, number of the candidate, score."""
    table = scores(left, right)
    row, col = np.nonzero(table >= floor[:, None])
    other = ids[col] != qids[row]
    row, col = row[other], col[other]
    return row, col, table[row, col]


def histogram(state: DataFrame, queries: DataFrame, candidates: DataFrame, n_query: int, groups: tuple[int, int], shift: int, k: int) -> DataFrame:
    """(id, cell, n): scores at or above ``low`` counted in cells of 2**shift; what lies above the interval counts as the last cell."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        last, out = 1 << CELL_BITS, [(np.empty(0, np.int64),) * 3]
        for qids, vectors, low in _unpacked(left):
            floor, n = low, np.zeros((len(qids), last + 1), np.int64)
            for ids, candidate, _ in _unpacked(right):
                row, _, s = _reached(qids, vectors, floor, ids, candidate)
                cell = np.minimum((s - low[row]) >> shift, last)
                n += np.bincount(row * (last + 1) + cell, minlength=n.size).reshape(n.shape)
                enough = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] >= k  # in this cell and above
                lowest = np.maximum(0, enough.sum(axis=1) - 1)
                floor = low + (lowest << shift)
            n[np.arange(last + 1) < ((floor - low) >> shift)[:, None]] = 0
            row, cell = np.nonzero(n)
            out.append((qids[row], cell, n[row, cell]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["id", "cell", "n"])

    found = paired(count, "id long, cell long, n long", queries, candidates, n_query, groups, state)
    return found.groupBy("id", "cell").agg(F.sum("n").alias("n"))


def narrowed(state: DataFrame, counts: DataFrame, shift: int, k: int) -> DataFrame:
    """The next interval of each query: the cell in which the kth best score lies, or the lowest one filled."""
    order = Window.partitionBy("id").orderBy(F.desc("cell"))
    run = counts.withColumn("above", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cell = run.where(F.col("above") < k).groupBy("id").agg(F.min("cell").alias("cell"))
    return state.join(cell, "id", "left").select("id", (F.col("low") + F.shiftleft(F.coalesce("cell", F.lit(0)).cast("long"), shift)).alias("low"))


def selected(state: DataFrame, queries: DataFrame, candidates: DataFrame, n_query: int, groups: tuple[int, int], k: int) -> DataFrame:
    """The k best rows of each query, given its kth best score as ``low``."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.empty(0, np.int64),) * 3]
        for qids, vectors, low in _unpacked(left):
            row, vec, best = out[0]
            for ids, candidate, _ in _unpacked(right):
                r, c, s = _reached(qids, vectors, low, ids, candidate)
                row, vec, best = np.append(row, r), np.append(vec, ids[c]), np.append(best, s)
                at = np.lexsort((vec, -best, row))
                row, vec, best = row[at], vec[at], best[at]
                at = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, vec, best = row[at], vec[at], best[at]
            out.append((qids[row], vec, best))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = paired(keep, "query_id long, vec_id long, score long", queries, candidates, n_query, groups, state)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: str, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
          query_rows: int = 256, candidate_rows: int = 4096) -> DataFrame:
    """The ``k`` best rows for each query row: query_id, rank (from 1), vec_id, score.

    Components are taken as floor(scale * x); the score is their inner product. ``is_query`` is an
    SQL condition on the columns of ``vectors``. Scores beyond +-2**61 are held there. Vectors that are NULL or hold a NULL or non-finite component, and
    rows without an id, take no part; empty vectors score 0; a shorter vector counts as padded
    with zeros. Of rows that repeat an id the smallest vector counts. A query with fewer than k
    other rows gets them all. Extra columns are not read.
    """
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.expr(is_query).alias("q")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = written(plain.where(~bad).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "vectors")
    chosen = rows.where("q")
    square = F.aggregate("v", F.lit(0.0), lambda t, x: t + F.pow(F.abs(F.lit(scale) * x) + 1, F.lit(2)))
    n, reach = rows.agg(F.count("*"), F.max(square)).first()
    n_candidate, n_query = parts(n, candidate_rows), parts(chosen.count(), query_rows)
    candidates = written(blocks(rows, n_candidate, scale), "candidate_blocks")
    queries = written(blocks(chosen, n_query, scale), "query_blocks")
    groups = grouped(queries, candidates, n_query, n_candidate)
    bound = int(min(reach or 0.0, float(LIMIT))) + 1  # no score lies beyond the largest squared length
    state = chosen.select("id", F.lit(-bound).cast("long").alias("low"))
    shift = (2 * bound).bit_length()
    while shift:
        shift = max(0, shift - CELL_BITS)
        state = narrowed(state, histogram(state, queries, candidates, n_query, groups, shift, k), shift, k)
        state = written(state, "intervals")
    return selected(state, queries, candidates, n_query, groups, k)
