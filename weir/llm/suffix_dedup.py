"""Removal of byte strings that repeat from an earlier place, by suffix arrays of content shards.

A window is ``window`` consecutive bytes of one text. Equal windows must meet in one suffix array, so
shards hold content, not documents: of the runs of two fifths of its length in a window the one of the smallest
key (rare runs first, then by hash, then the leftmost) names the window, and consecutive windows named
by one and the same run make a piece, which goes where its name goes.

1. Every piece sends its name, its hash and its place. Equal pieces keep their first place; all others
   repeat it. What repeats inside a batch is settled there, so that a passage that a third of all
   documents share sends one row per batch. A name with one content only needs nothing else.
2. The other contents, each from its first place only, are cut from the texts and dealt into shards by
   name. A shard sorts the suffixes of its pieces by external induced sorting (``induced``): runs of
   suffixes with a common prefix of ``window`` bytes are one window at several places, and the
   smallest place keeps it. Shards may be far larger than memory.
3. The spans found are united per document, and the texts lose them.

Rare runs first: a run that stands out in its part of the table is passed over wherever a window
has another one, so that a frequent phrase with many different surroundings does not gather in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import parts
from weir.llm.induced import suffix_order
from weir.llm.shingles import mixed

CELLS = 1 << 18
SLICE = 1 << 22
SORT_ROWS = 1 << 17
_PLACE = np.uint64(24)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes: longer runs from shorter ones, the bits spread once at the end."""
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    n, out, at = len(data) - gram + 1, None, 0
    while True:
        if gram & size:
            out = h[at:at + n] if out is None else out * np.uint64(0xD6E8FEB86659FD93) + h[at:at + n]
            at += size
        if 2 * size > gram:
            return mixed(out)
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, (factor * factor * 3) & ((1 << 64) - 1)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """All texts of a batch one behind the other in parts of about SLICE bytes: bytes, edges of the texts, first row."""
    values = batch.column(column)
    size = np.array(pa.compute.binary_length(values).fill_null(0), np.int64)
    part = np.cumsum(size) // SLICE
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for a, b in zip(edges, np.r_[edges[1:], len(part)]):
        joined = b"".join(x.as_py() or b"" for x in values.slice(a, b - a))
        yield np.frombuffer(joined, np.uint8), np.r_[0, np.cumsum(size[a:b])], int(a)


def frequent_runs(texts: DataFrame, gram: int) -> tuple[np.ndarray, int]:
    """Classes (log2 of how far a cell stands out, 0 to 63) of CELLS hash cells of runs, and the bytes of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n_bytes = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for data, _, _ in _texts(batch, 0):
                n_bytes += len(data)
                for i in range(0, len(data), SLICE):
                    cells += np.bincount((_grams(data[i:i + SLICE + gram - 1], gram) >> np.uint64(46)).astype(np.int64), minlength=CELLS) if len(data) - i >= gram else 0
        # A cell stands out with eight times the part's mean and eight runs; -1 counts the bytes.
        out = np.flatnonzero(cells > max(8, 8 * n_bytes // CELLS))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, out]), pa.array(np.r_[n_bytes, cells[out]])], ["cell", "n"])

    total, table = 0, np.zeros(CELLS, np.int64)
    for cell, n in texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CELLS + 1 rows
        if cell < 0:
            total = n
        else:
            table[cell] = n
    return np.ceil(np.log2(table + 1)).astype(np.uint8), total


def pieces(rows: DataFrame, classes: np.ndarray, window: int, gram: int) -> DataFrame:
    """(name, hash, doc_id, ver, start, n): n windows from byte ``start`` on; n below 0: settled, all -n of them repeat."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)  # CELLS bytes
    span = window - gram + 1

    def named(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and name of every piece, over all windows of ``data``."""
        h = _grams(data, gram)
        key = (shared.value[(h >> np.uint64(46)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(30) << _PLACE) | np.arange(len(h), dtype=np.uint64)
        low, size = key, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[:len(key) - span + 1], low[span - size:])
        at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return first, h[at[first]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ver = (np.array(batch.column(i)) for i in (0, 1))
            for data, edges, row in _texts(batch, 2):
                found = []
                # A text longer than a slice is looked at in parts that share window - 1 bytes.
                for a in range(0, max(1, len(data) - window + 1), SLICE):
                    some = data[a:a + SLICE + window - 1]
                    if len(some) < window:
                        continue
                    first, name = named(some)
                    last = np.r_[first[1:], len(some) - window + 1] - 1
                    # Pieces end with their text: no window crosses an edge.
                    doc = np.searchsorted(edges, first + a, side="right") - 1
                    doc_last = np.searchsorted(edges, last + a, side="right") - 1
                    whole = doc == doc_last
                    begin, end, key, owner = [first + a], [np.minimum(last + a, edges[doc + 1] - window)], [name], [doc]
                    for i in np.flatnonzero(~whole):  # at most one piece per text crosses its end
                        for d in range(doc[i] + 1, doc_last[i] + 1):
                            begin.append(np.array([edges[d]]))
                            end.append(np.array([min(last[i] + a, edges[d + 1] - window)]))
                            key.append(name[i:i + 1])
                            owner.append(np.array([d]))
                    found.append([np.concatenate(x) for x in (begin, end, key, owner)])
                if not found:
                    continue
                begin, end, name, doc = (np.concatenate(x) for x in zip(*found))
                ok = end >= begin
                begin, n, name, doc = begin[ok], (end - begin + 1)[ok], name[ok], doc[ok]
                view = memoryview(data)
                digest = xxhash.xxh3_64_intdigest
                content = np.fromiter((digest(view[x:y]) for x, y in zip(begin.tolist(), (begin + n + window - 1).tolist())), np.uint64, len(begin))
                d, v, start = ids[row + doc], ver[row + doc], begin - edges[doc]
                order = np.lexsort((start, d, content, name))
                d, v, start, n, name, content = (x[order] for x in (d, v, start, n, name, content))
                new = np.r_[True, (name[1:] != name[:-1]) | (content[1:] != content[:-1])] if len(name) else np.empty(0, bool)
                lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                later = (d != d[lead]) | (start != start[lead])
                # Neighbouring settled pieces of a text make one row.
                s_d, s_v, s_a, s_n = (x[later] for x in (d, v, start, n))
                order = np.lexsort((s_a, s_v, s_d))
                s_d, s_v, s_a, s_n = (x[order] for x in (s_d, s_v, s_a, s_n))
                if len(s_d):
                    head = np.flatnonzero(np.r_[True, (s_d[1:] != s_d[:-1]) | (s_v[1:] != s_v[:-1]) | (s_a[1:] != s_a[:-1] + s_n[:-1])])
                    tail = np.r_[head[1:], len(s_d)] - 1
                    s_d, s_v, s_a, s_n = s_d[head], s_v[head], s_a[head], s_a[tail] + s_n[tail] - s_a[head]
                # Settled rows travel with the others, under names that spread them.
                spread = mixed(s_d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + s_a.astype(np.uint64))
                columns = [(name[~later], spread), (content[~later], spread), *((x[~later], y) for x, y in ((d, s_d), (v, s_v), (start, s_a), (n, -s_n)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in columns], ["name", "hash", "doc_id", "ver", "start", "n"])

    return rows.select("doc_id", "ver", "text").mapInArrow(cut, "name long, hash long, doc_id long, ver long, start long, n long")


def firsts(found: DataFrame) -> DataFrame:
    """Settled rows (n below 0) and the first place of every content whose name has several.

    Rows come sorted by name, hash and place and are read as a stream: a name may have any number of them.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # name, hash, doc_id, start of the last content's first row
        waiting = None  # that row, while its name has no other content
        for batch in batches:
            columns = [np.array(x) for x in batch.columns]
            passed = columns[5] < 0
            settled = [x[passed] for x in columns[2:]]
            name, content, doc, ver, start, n = (x[~passed] for x in columns)
            if not len(name):
                yield pa.RecordBatch.from_arrays([pa.array(settled[0]), *map(pa.array, settled)], ["name", "doc_id", "ver", "start", "n"])
                continue
            new = np.r_[last is None or name[0] != last[0] or content[0] != last[1], (name[1:] != name[:-1]) | (content[1:] != content[:-1])]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            first_doc, first_start = doc[lead], start[lead]
            if last is not None:
                first_doc[lead < 0], first_start[lead < 0] = last[2], last[3]
            later = (doc != first_doc) | (start != first_start)
            at = np.flatnonzero(new)
            rows = [(name[at], content[at], doc[at], ver[at], start[at], n[at])]
            if waiting is not None:
                rows.insert(0, tuple(np.array([x]) for x in waiting))
            heads = [np.concatenate(x) for x in zip(*rows)]
            several = np.zeros(len(heads[0]), bool)
            if len(several):
                same = heads[0][1:] == heads[0][:-1]
                several[1:] |= same
                several[:-1] |= same
                if last is not None and waiting is None:
                    several[heads[0] == last[0]] = True  # its name has sent a content before
            if len(at):
                i = at[-1]
                row = (name[i], content[i], doc[i], ver[i], start[i], n[i])
                waiting, last = (None if several[-1] else row), (name[i], content[i], doc[i], start[i])
            kept = [x[several] for x in heads]
            rest = [np.r_[x[later], y] for x, y in zip((doc, ver, start, -n), settled)]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, y]) for x, y in zip((kept[0], *kept[2:]), (rest[0], *rest))], ["name", "doc_id", "ver", "start", "n"])

    cols = ["name", "hash", "doc_id", "ver", "start", "n"]
    return found.select(*cols).mapInArrow(settle, "name long, doc_id long, ver long, start long, n long")


def contents(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, places) to (name, doc_id, ver, start, piece)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, doc, ver, start, piece = [], [], [], [], []
            size = 0
            for d, v, text, places in zip(*[x.to_pylist() for x in batch.columns]):
                for p in places:
                    name.append(p["name"])
                    doc.append(d)
                    ver.append(v)
                    start.append(p["start"])
                    piece.append(text[p["start"]:p["start"] + p["n"] + window - 1])
                    size += len(piece[-1])
                if size > SLICE:
                    yield _pieces(name, doc, ver, start, piece)
                    name, doc, ver, start, piece, size = [], [], [], [], [], 0
            yield _pieces(name, doc, ver, start, piece)

    return rows.mapInArrow(fetch, "name long, doc_id long, ver long, start long, piece binary")


def _pieces(name: list, doc: list, ver: list, start: list, piece: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (name, doc, ver, start)], pa.array(piece, pa.binary())], ["name", "doc_id", "ver", "start", "piece"])


def repeats(shard: DataFrame, window: int, sort_rows: int) -> DataFrame:
    """Spans (doc_id, ver, start, n) of windows that start earlier too, from pieces dealt by name and sorted by place.

    A part of the table is one shard: one suffix array over all its pieces.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, ver, start, strings = [], [], [], []
        for batch in batches:
            for kept, x in zip((doc, ver, start), batch.columns):
                kept.append(np.array(x))
            strings.extend(batch.column(3).to_pylist())
        if not strings:
            return
        doc, ver, start = (np.concatenate(x) for x in (doc, ver, start))
        edges = np.r_[0, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1)]
        pos, low, text = suffix_order(strings, sort_rows)
        flag = np.zeros(len(text), bool)
        number = np.unique(doc, return_inverse=True)[1]
        carry, step = np.empty(0, np.int64), 8 * sort_rows  # members of a run that reaches over a chunk's end
        for a in range(0, len(pos), step):
            p = np.r_[carry, pos[a:a + step]]
            joined = np.r_[np.arange(len(carry)) > 0, np.asarray(low[a:a + step]) >= window]
            if a + step < len(pos):
                last = int(np.flatnonzero(~joined)[-1])
                p, joined, carry = p[:last], joined[:last], p[last:]
            several = joined | np.r_[joined[1:], False]
            p, head = p[several], np.flatnonzero(~joined[several])
            if len(p):
                owner = np.searchsorted(edges, p, side="right") - 1
                place = (number[owner] << 40) | (start[owner] + p - edges[owner])
                least = np.repeat(np.minimum.reduceat(place, head), np.diff(np.r_[head, len(p)]))
                flag[p[place > least]] = True
        at = np.flatnonzero(np.diff(np.r_[False, flag, False].astype(np.int8)))
        first, n = at[::2], at[1::2] - at[::2]
        owner = np.searchsorted(edges, first, side="right") - 1
        for i in range(0, len(first), 100_000):
            part = slice(i, i + 100_000)
            o = owner[part]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[o], ver[o], start[o] + first[part] - edges[o], n[part])], ["doc_id", "ver", "start", "n"])

    return shard.select("doc_id", "ver", "start", "piece").mapInArrow(scan, "doc_id long, ver long, start long, n long")


def cut(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, spans) to doc_id, n_bytes, n_removed, n_spans, repeats (first byte, bytes), kept (binary)."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, left = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                text = text.as_py() or b""
                runs = []
                if len(found.values):
                    a = found.values.field("start").to_numpy()
                    b = a + found.values.field("n").to_numpy() + window - 1
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    runs = list(zip(a[head].tolist(), b[np.r_[head[1:], len(a)] - 1].tolist()))
                keep = [text[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(text)])]
                size.append(len(text))
                gone.append(sum(y - x for x, y in runs))
                spans.append([{"first": x, "bytes": y - x} for x, y in runs])
                left.append(b"".join(keep) if runs else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "repeats", "kept"])

    return rows.select("doc_id", "text", "spans").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, repeats array<struct<first: long, bytes: long>>, kept binary")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 100,
                    shard_bytes: int = 8 << 20, sort_rows: int = SORT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, repeats (first byte, bytes), kept (the remaining bytes).

    A byte goes if it lies in a window whose bytes also start earlier: in a document with a smaller id,
    or before in the same one. NULL and empty texts have no bytes. A row without an id keeps all its
    bytes and removes none elsewhere. Rows that share an id are one document at the same places: what
    starts at a smaller byte of any of them is earlier. Extra columns are not read.
    ``window`` must lie between 24 and 254 bytes. A shard holds the pieces of about ``shard_bytes`` of
    text, and a task sorts it with about ``sort_rows`` suffixes in memory at once.
    """
    if not 24 <= window <= 254:
        raise ValueError("window must be between 24 and 254 bytes")
    gram = 2 * window // 5
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("hash"))
    own = rows.where("doc_id is not null")
    classes, total = frequent_runs(own.select("text"), gram)
    shards = parts(total, shard_bytes)
    # Ids that stand for several texts tell them apart by their hash; all other rows have version 0.
    unlike = own.groupBy("doc_id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("d"), F.lit(True).alias("several"))
    # The texts are dealt out once; the three uses below read one and the same exchange.
    dealt = own.repartition("doc_id").join(unlike, F.col("doc_id") == F.col("d"), "left").select(
        "doc_id", F.when(F.col("several"), F.col("hash")).otherwise(F.lit(0)).alias("ver"), "text")
    found = pieces(dealt, classes, window, gram).repartition(shards, "name").sortWithinPartitions("name", "hash", "doc_id", "start")
    # Both kinds of rows go to their documents once; the texts are cut into contents there, and later into what is left.
    met = firsts(found).groupBy(F.col("doc_id").alias("d"), F.col("ver").alias("v")).agg(F.collect_list(F.struct("name", "start", "n")).alias("met"))
    same = (F.col("doc_id") == F.col("d")) & (F.col("ver").bitwiseXOR(F.col("v")) == 0)
    both = dealt.join(met, same, "left").select("doc_id", "ver", "text", F.filter("met", lambda x: x["n"] > 0).alias("places"),
                                                F.transform(F.filter("met", lambda x: x["n"] < 0), lambda x: F.struct(x["start"].alias("start"), (-x["n"]).alias("n"))).alias("settled"))
    strings = contents(both.where(F.size("places") > 0).select("doc_id", "ver", "text", "places"), window)
    again = repeats(strings.repartition(shards, "name").sortWithinPartitions("doc_id", "start"), window, sort_rows)
    again = again.groupBy(F.col("doc_id").alias("d"), F.col("ver").alias("v")).agg(F.collect_list(F.struct("start", "n")).alias("again"))
    kind = "array<struct<start: long, n: long>>"
    spans = F.concat(F.coalesce("settled", F.array().cast(kind)), F.coalesce("again", F.array().cast(kind)))
    alone = rows.where("doc_id is null").select("doc_id", "text", F.array().cast(kind).alias("spans"))
    return cut(both.join(again, same, "left").select("doc_id", "text", spans.alias("spans")), window).union(cut(alone, window))
