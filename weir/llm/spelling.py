"""Spelling variants: words at one edit from each other, found with an FM-index in both directions.

Two words at one edit share a whole half: cut a word in two, and the other one ends with its second
half or begins with its first. So the search scheme has two searches. One matches the second half
from the end of the word backwards, exactly, and goes on across the first half with one error; the
other matches the first half forwards and goes on across the second. Each works on intervals of suffix ranks
of the delimited vocabulary: the first on the index of the words, the second on that of the words
written backwards. Both begin and end at a delimiter, so neither search turns round, and the two
indexes need not be kept in step.

The vocabulary is dealt out by halves, since only words that share one can be near: a word is posted
under each half that a word of its length, one more or one less may ask for, and asks under its own.
A half with more than ``crowd`` words is split into parts, and its words ask in every part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import parts, written
from weir.llm.induced import suffix_order

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASKED_AT_ONCE = 50_000


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spoil: int | None = None) -> DataFrame:
    """(word, n): every word of all texts, A-Z in lower case, and how often it occurs.

    With ``spoil``, a word whose CRC-32 of ``<id>:<word>`` is a multiple of it loses one code point; rows
    without an id keep their words as they are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for key, value in zip(batch.column(0), batch.column(1)):
                if not value.is_valid:
                    continue
                found = Counter(RUN.findall(value.as_py().lower().decode()))  # bytes: only A-Z are changed
                if spoil is None or not key.is_valid:
                    total.update(found)
                    continue
                start = zlib.crc32(b"%d:" % key.as_py())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % spoil:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """FM-index of delimited words (Latin-1 bytes): ranks over the symbol before each suffix."""

    def __init__(self, words: list[bytes], sort_rows: int) -> None:
        pos, _, text = suffix_order(words, sort_rows)
        before = np.where(pos > 0, text[np.maximum(pos - 1, 0)], 0)
        kinds, before = np.unique(before, return_inverse=True)
        self.symbols = np.full(257, -1, np.int64)  # place of a byte (plus one) among those that occur
        self.symbols[kinds] = np.arange(len(kinds))
        self.size, self.kinds, self.words = len(pos), len(kinds), len(words)
        self.start = np.r_[0, np.cumsum(np.bincount(self.symbols[text], minlength=len(kinds)))][:len(kinds)]
        blocks = self.size // 64 + 1
        self.bits = np.zeros((len(kinds), blocks), np.uint64)
        order = np.argsort(before, kind="stable")
        at = np.arange(self.size)[order]
        np.bitwise_or.at(self.bits, (before[order], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        self.ahead = np.zeros((len(kinds), blocks), np.int32)
        np.cumsum(np.bitwise_count(self.bits[:, :-1]), axis=1, dtype=np.int32, out=self.ahead[:, 1:])
        edges = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.first = np.searchsorted(edges, pos[before == 0], side="right")  # words in the order of the suffixes that are whole words

    def rank(self, symbol: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` suffixes follow ``symbol``."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ahead[symbol, block] + np.bitwise_count(self.bits[symbol, block] & mask)

    def extend(self, symbol: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put before them; a symbol below 0 occurs nowhere."""
        start = np.where(np.asarray(symbol) < 0, 0, self.start[symbol])
        a, b = self.rank(symbol, low), self.rank(symbol, high)
        return start + a, start + np.where(np.asarray(symbol) < 0, a, b)


def near(index: Index, asked: list[bytes], longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asked, found): places of words at one edit that end with the asked word's last half (of an odd word the ``longer`` one).

    Backward search: the last half exactly, then the first with one error.
    """
    size = np.fromiter(map(len, asked), np.int64, len(asked))
    width = int(size.max())
    pattern = np.full((len(asked), width + 1), -1, np.int64)  # from the last symbol to the first
    flat = index.symbols[np.frombuffer(b"".join(asked), np.uint8).astype(np.int64) + 1]
    owner = np.repeat(np.arange(len(asked)), size)
    pattern[owner, size[owner] - 1 - (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size))] = flat
    exact = (size + longer) // 2
    who, low, high = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.full(len(asked), index.words)
    none = np.empty(0, np.int64)
    err = (none, none, none)  # states with one error so far
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def open_(state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        ok = state[2] > state[1]
        return tuple(x[ok] for x in state)

    def joined(states: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*states))

    for j in range(width + 1):
        late = j >= exact[who]
        # Any symbol here: an insertion stays at j, a replacement goes on to j + 1.
        base = (who[late], low[late], high[late])
        inserted, after = [err], []
        for c in range(1, index.kinds):
            a, b = index.extend(c, base[1], base[2])
            ok = b > a
            if ok.any():
                w, a, b = base[0][ok], a[ok], b[ok]
                inserted.append((w, a, b))
                other = (pattern[w, j] != c) & (j < size[w])
                after.append((w[other], a[other], b[other]))
        err = joined(inserted)
        done = size[err[0]] == j
        if done.any():  # the pattern is used up: whole words only
            w, a, b = (x[done] for x in err)
            a, b = index.rank(0, a), index.rank(0, b)
            n = b - a
            at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(w, n), index.first[at]))
        w, a, b = (x[~done] for x in err)
        moved = open_((w, *index.extend(pattern[w, j], a, b)))
        skip = base[0][size[base[0]] > j], base[1][size[base[0]] > j], base[2][size[base[0]] > j]  # the found word lacks this symbol
        err = joined([moved, skip, *after])
        ok = size[who] > j
        who, low, high = who[ok], low[ok], high[ok]
        who, low, high = open_((who, *index.extend(pattern[who, j], low, high)))
    if not found:
        return none, none
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
    return pairs[0], pairs[1]


def posted(words: DataFrame) -> DataFrame:
    """(side, half, word, n, asks): each word under the halves by which it may be found; ``asks`` under its own."""
    # Side 0: last halves, the longer part of a word; side 1: first halves.
    sizes = lambda add: F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.length("word") + d + add) / 2).cast("int")))
    own = lambda add: F.floor((F.length("word") + add) / 2).cast("int")
    last = F.transform(sizes(1), lambda k: F.struct(F.lit(0).alias("side"), F.right("word", k).alias("half"), (k == own(1)).alias("asks")))
    first = F.transform(sizes(0), lambda k: F.struct(F.lit(1).alias("side"), F.left("word", k).alias("half"), (k == own(0)).alias("asks")))
    return words.select("word", "n", F.explode(F.concat(last, first)).alias("p")).select("p.side", "p.half", "word", "n", "p.asks")


def pairs(words: DataFrame, crowd: int = 20_000, shard_words: int = 100_000, sort_rows: int = 1 << 16) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n; Latin-1 words) at exactly one edit, both ways round."""
    rows = posted(words)
    counted = rows.groupBy("side", "half").agg(F.count("*").alias("in_half")).where(F.col("in_half") > crowd)
    rows = rows.join(counted, ["side", "half"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("in_half") / crowd), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    held = rows.select("side", "half", mine.alias("block"), "word", "n", F.lit(False).alias("asks"))
    ask = rows.where("asks").select("side", "half", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n", "asks")
    shards = parts(words.count() * 4, shard_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[bytes, int]] = [{}, {}]
        asking: list[set[bytes]] = [set(), set()]
        for batch in batches:
            side, word, n, asks = (x.to_pylist() for x in batch.columns)
            for s, w, k, a in zip(side, word, n, asks):
                w = w.encode("latin-1")
                if a:
                    asking[s].add(w if s == 0 else w[::-1])
                else:
                    held[s][w if s == 0 else w[::-1]] = k
        for s in (0, 1):
            if not held[s] or not asking[s]:
                continue
            words, wanted = list(held[s]), list(asking[s])
            counts = np.fromiter(held[s].values(), np.int64, len(words))
            index = Index(words, sort_rows)
            shown = np.array([(w if s == 0 else w[::-1]).decode("latin-1") for w in words], object)
            for i in range(0, len(wanted), ASKED_AT_ONCE):
                some = wanted[i:i + ASKED_AT_ONCE]
                a, b = near(index, some, longer=s == 0)
                names = np.array([(w if s == 0 else w[::-1]).decode("latin-1") for w in some], object)
                yield pa.RecordBatch.from_arrays([pa.array(names[a], pa.string()), pa.array(shown[b], pa.string()), pa.array(counts[b])], ["word", "near", "near_n"])

    dealt = held.union(ask).repartition(shards, "side", "half", "block")
    met = dealt.select("side", "word", "n", "asks").mapInArrow(search, "word string, near string, near_n long")
    return met.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, by doubling. Forms must not lead in a circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = written(now.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 7, min_n: int = 2, factor: int = 10,
             spoil: int | None = None, crowd: int = 20_000, shard_words: int = 100_000) -> DataFrame:
    """One row per word of at least ``min_chars`` code points (two or more) and ``min_n`` occurrences: word, n, n_near, form, form_n, root.

    A word's form is the most frequent word at one edit (ties: smallest in code-point order), if it is at
    least ``factor`` (2 or more) times as frequent, else NULL; the root is where forms lead in the end. NULL and
    empty texts hold no words; every row counts, also one that repeats an id. Extra columns are not read.
    """
    words = written(occurrences(docs, doc_id, text, spoil).where((F.length("word") >= max(2, min_chars)) & (F.col("n") >= min_n)), "words")
    best = pairs(words, crowd, shard_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))).alias("best"))
    good = -F.col("best.k") >= factor * F.col("n")
    found = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n")), "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
