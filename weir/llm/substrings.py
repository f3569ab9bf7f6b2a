"""Removal of word sequences that repeat from an earlier document, by fixed-block anchors.

A window of ``window`` words holds, wherever it starts, one whole block of ``window // 2 + 1``
words at a multiple of that length. So these non-overlapping blocks of every document are the
index, and every rolling window of that length is a probe. Where a probe meets a block of another
document, the hit is extended: all windows around it are compared in full length (by their 64-bit
hash), each keeps the smallest document id it starts in, and the union of windows known from a
smaller id is the maximal repeat that goes.

Documents with the same words as one with a smaller id are settled first and index nothing.
Hashes travel packed: one row per batch of documents and bucket of hashes, 4 bytes an entry for
blocks and probes. What meets inside a batch is decided there, and only its smallest document goes
on, so that a passage that a third of all documents share sends one entry per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import parts, written
from weir.llm.shingles import WordHashes, hashes, runs

PACKED = "bucket int, doc_id long, docs binary, counts binary, entries binary"
WORDS_AT_ONCE = 1_000_000


def _split(value: pa.Scalar) -> list[bytes]:
    return (value.as_py() or b"").split()  # bytes split at ASCII white space only


def word_keys(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, text): doc_id, text_hash, n_words, high and low half of a 128-bit hash of the words."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low = [], [], []
            for value in batch.column(1):
                words = _split(value)
                whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                n.append(len(words))
                high.append((whole >> 64) - (1 << 63))
                low.append((whole & ((1 << 64) - 1)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in (n, high, low)]],
                                             ["doc_id", "text_hash", "n_words", "high", "low"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(keyed, "doc_id long, text_hash long, n_words long, high long, low long")


def _packed(bucket: np.ndarray, doc: np.ndarray, entry: np.ndarray, ids: np.ndarray, offset: int = 0) -> Iterator[tuple]:
    """Rows (bucket, None, ids, counts, entries): entries sorted by bucket, then by document."""
    order = np.lexsort((doc, bucket))
    bucket, doc, entry = bucket[order], doc[order], entry[order]
    new = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])]) if len(bucket) else np.empty(0, int)
    counts = np.diff(np.r_[new, len(bucket)]).astype(np.uint32)
    run_bucket, run_doc = bucket[new], ids[doc[new]]
    edges = np.flatnonzero(np.r_[True, run_bucket[1:] != run_bucket[:-1]]) if len(new) else np.empty(0, int)
    for a, b in zip(edges, np.r_[edges[1:], len(new)]):
        at, to = new[a], new[b] if b < len(new) else len(bucket)
        yield int(run_bucket[a]) + offset, None, run_doc[a:b].tobytes(), counts[a:b].tobytes(), entry[at:to].tobytes()


def _direct(doc: np.ndarray, key: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows (bucket, doc_id, None, None, keys) of what is settled already; they pass through the reduction."""
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, int)
    for a, b in zip(new, np.r_[new[1:], len(doc)]):
        i = int(ids[doc[a]])
        yield buckets + i % buckets, i, None, None, key[a:b].tobytes()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "doc_id", "docs", "counts", "entries"])


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about WORDS_AT_ONCE words (taken as 5 bytes each); a longer text stands alone."""
    size = np.array(pa.compute.binary_length(batch.column(1)).fill_null(0))
    part = np.cumsum(size) // (5 * WORDS_AT_ONCE)
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(edges, np.r_[edges[1:], len(part)]):
        yield batch.slice(a, b - a)


def _repeated(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry sorted by (hash, doc): the order, and the index of its hash's first entry."""
    order = np.lexsort((doc, h))
    sorted_h = h[order]
    start = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]]) if len(h) else np.empty(0, int)
    return order, np.repeat(start, np.diff(np.r_[start, len(h)]))


def anchors(docs: DataFrame, buckets: int, block: int) -> DataFrame:
    """PACKED rows of blocks and probes of (doc_id, text); an entry is 31 bits of the hash and a block flag."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in _batches(whole):
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                found = [runs(hashes(memo, _split(v)), block) for v in batch.column(1)]
                sizes = [len(x) for x in found]
                if not sum(sizes):
                    continue
                h, doc = np.concatenate(found), np.repeat(np.argsort(np.argsort(ids, kind="stable")), sizes)
                flag = np.concatenate([np.arange(n) % block == 0 for n in sizes])
                ids = np.sort(ids)
                order, first = _repeated(h, doc)
                h, doc, flag = h[order], doc[order], flag[order]
                last = np.r_[first[1:] != first[:-1], True]
                many = np.zeros(len(h), bool)  # the hash is in two documents of this batch at least
                ends = np.flatnonzero(last)
                many = np.repeat(ids[doc[ends]] != ids[doc[first[ends]]], np.diff(np.r_[-1, ends]))
                key = (h >> (bits - np.uint64(31))).astype(np.int64)
                send = ~many | (np.arange(len(h)) == first)
                low = ((key & ((1 << 31) - 1)) << 1 | (flag | many)).astype(np.uint32)
                bucket = (key >> 31).astype(np.int32)
                yield _rows([*_packed(bucket[send], doc[send], low[send], ids), *_direct(doc[many], key[many], ids, buckets)])

    return docs.select("doc_id", "text").mapInArrow(post, PACKED)


def _gathered(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    docs = [np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")]
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")]
    return (np.concatenate([np.repeat(d, c) for d, c in zip(docs, counts)]),
            np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("entries")]))


def _reduced(packed: DataFrame, decide: Callable, buckets: int, kind: type) -> DataFrame:
    """(doc_id, key): per bucket what ``decide`` keeps; settled entries as they are. One row per entry, at any number of buckets."""

    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            entries = [np.frombuffer(x.as_py(), kind) for x in table.column("entries")]
            doc, found = np.repeat(table.column("doc_id").to_numpy(), [len(x) for x in entries]), np.concatenate(entries)
        else:
            doc, found = decide(key[0].as_py(), table)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "key": pa.array(found.view(np.int64))})

    return packed.groupBy("bucket").applyInArrow(reduce, "doc_id long, key long")


def hits(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, key): hashes of a document's windows that meet a block of a smaller document, and of those blocks."""

    def decide(bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, entry = _gathered(table, np.uint32)
        h, flag = entry >> np.uint32(1), (entry & np.uint32(1)).astype(bool)
        order, first = _repeated(h, doc)
        h, doc, flag = h[order], doc[order], flag[order]
        top = np.iinfo(np.int64).max
        starts = np.unique(first)
        low = np.minimum.reduceat(np.where(flag, doc, top), starts)  # smallest document with the block
        high = np.maximum.reduceat(doc, starts)
        low, high = (np.repeat(x, np.diff(np.r_[starts, len(h)])) for x in (low, high))
        keep = (low < high) & (doc >= low)
        return doc[keep], (np.int64(bucket) << 31) | h[keep].astype(np.int64)

    return _reduced(packed, decide, buckets, np.int64)


def windows(docs: DataFrame, buckets: int, block: int, window: int) -> DataFrame:
    """PACKED rows of the full windows around the hits (``keys``: list) of (doc_id, text)."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for whole in batches:
            for batch in _batches(whole):
                ids = np.array(batch.column(0).to_pylist(), np.int64)
                found = []
                for value, keys in zip(batch.column(1), batch.column(2)):
                    h = hashes(memo, _split(value))
                    known = keys.values.to_numpy()
                    hit = np.isin((runs(h, block) >> (bits - np.uint64(31))).astype(np.int64), known)
                    n = max(0, len(h) - window + 1)
                    near = np.cumsum(np.r_[0, hit])  # a window holds the probes that start in its first window - block + 1 places
                    span = window - block + 1
                    found.append(np.unique(runs(h, window)[near[span:span + n] > near[:n]]) if n else np.empty(0, np.uint64))
                sizes = [len(x) for x in found]
                if not sum(sizes):
                    continue
                h, doc = np.concatenate(found), np.repeat(np.argsort(np.argsort(ids, kind="stable")), sizes)
                ids = np.sort(ids)
                order, first = _repeated(h, doc)
                h, doc = h[order], doc[order]
                lead = np.arange(len(h)) == first
                later = ids[doc] > ids[doc[first]]
                bucket = (h >> bits).astype(np.int32)
                yield _rows([*_packed(bucket[lead], doc[lead], h[lead], ids), *_direct(doc[later], h[later], ids, buckets)])

    return docs.select("doc_id", "text", "keys").mapInArrow(post, PACKED)


def repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, key): hashes of the windows that start in a smaller document too."""

    def decide(bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, h = _gathered(table, np.uint64)
        order, first = _repeated(h, doc)
        h, doc = h[order], doc[order]
        later = doc > doc[first]
        return doc[later], h[later]

    return _reduced(packed, decide, buckets, np.uint64)


def cut(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, is_copy, keys) to doc_id, n_words, n_removed, repeats (first word, words), text."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n, removed, spans, left = [], [], [], []
            for value, copy, keys in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = _split(value)
                gone = np.zeros(len(words), bool)
                if copy.as_py():
                    gone[:] = len(words) >= window
                elif keys.is_valid and len(words) >= window:
                    known = keys.values.to_numpy().view(np.uint64)
                    at = np.flatnonzero(np.isin(runs(hashes(memo, words), window), known))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                steps = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                n.append(len(words))
                removed.append(int(gone.sum()))
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(steps[::2], steps[1::2])])
                left.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(steps) else words).decode())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(left, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "repeats", "text"])

    return docs.select("doc_id", "text", "is_copy", "keys").mapInArrow(
        remove, "doc_id long, n_words long, n_removed long, repeats array<struct<first: long, words: long>>, text string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, bucket_words: int = 1_500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, repeats, text (kept words, one space between).

    A word goes if it lies in a window whose words also start in a document with a smaller id.
    NULL and empty texts have no words. A row without an id keeps all its words and removes none
    elsewhere; rows that share an id remove nothing from each other. Extra columns are not read.
    """
    block = window // 2 + 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    keys = written(word_keys(rows), "word_keys")
    firsts = keys.where("doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(keys.join(firsts, ["high", "low"]).where("doc_id > first").select("doc_id", "text_hash").distinct().withColumn("is_copy", F.lit(True)), "copies")
    total = keys.agg(F.sum("n_words")).first()[0] or 0
    buckets = 1 << max(2, parts(total, bucket_words) - 1).bit_length()
    # The texts are dealt out once; the three uses below read one and the same exchange.
    # The join compares the second key beside the first, not as a key, since it would deal the texts out again.
    other = copies.select(F.col("doc_id").alias("copy"), F.col("text_hash").alias("copy_hash"), "is_copy")
    same = (F.col("doc_id") == F.col("copy")) & (F.col("text_hash").bitwiseXOR(F.col("copy_hash")) == 0)
    # Rows without an id go their own way: a filter in one of the uses would make it an exchange of its own.
    dealt = rows.where("doc_id is not null").repartition("doc_id").join(other, same, "left")
    own = dealt.where("is_copy is null")
    per_doc = lambda found: found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list("key").alias("keys"))
    near = own.join(per_doc(hits(anchors(own, buckets, block), buckets)), F.col("doc_id") == F.col("d")).select("doc_id", "text", "keys")
    known = per_doc(repeats(windows(near, buckets, block, window), buckets))
    alone = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("boolean").alias("is_copy"), F.lit(None).cast("array<bigint>").alias("keys"))
    return cut(dealt.join(known, F.col("doc_id") == F.col("d"), "left"), window).union(cut(alone, window))
