"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern; tokens never cross them. The leaves of a
document's tree are runs of ``LEAF`` pre-tokens with their characters and tokens, inner nodes hold
the sums. An edit re-encodes the text from the leaf before it up to the first old leaf boundary
after it that the new pre-tokens meet again, and updates the sums above these leaves; the rest of
the document is neither cut nor encoded again.

The tokenizer is a public byte-pair vocabulary, given by path; each task reads it once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = regex.compile(PATTERN)
LEAF = 32
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Counter(dict):
    """Tokens by pre-token. A memo: emptied when it holds ``limit`` of them."""

    limit = 300_000

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Sums of characters and tokens over leaves, as two heaps: node i has the children 2i and 2i + 1."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def build(cls, text: str, count: Counter) -> Tree:
        pieces = PIECES.findall(text)
        leaves = max(1, -(-len(pieces) // LEAF))
        size = 1 << (leaves - 1).bit_length()
        heaps = []
        for values in (map(len, pieces), map(count.__getitem__, pieces)):
            heap = np.zeros(2 * size, np.int64)
            if pieces:
                each = np.fromiter(values, np.int64, len(pieces))
                heap[size:size + leaves] = np.add.reduceat(each, np.arange(0, len(pieces), LEAF))
            for low in (1 << b for b in range(size.bit_length() - 2, -1, -1)):
                heap[low:2 * low] = heap[2 * low:4 * low].reshape(-1, 2).sum(axis=1)
            heaps.append(heap)
        return cls(*heaps)

    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it starts; the last one filled for the end of the text."""
        node, start = 1, 0
        at = min(at, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str, count: Counter) -> tuple[str, int]:
        """Replace text[start:end]; returns the text and the number of pre-tokens encoded again.

        A pre-token depends on nothing before it and on one character behind it. So the leaf that
        holds the character before the edit is where the cutting starts, and it ends where a new
        pre-token ends on an old leaf boundary behind the edit.
        """
        old_length = len(text)
        text = text[:start] + new + text[end:]
        moved = len(new) - (end - start)
        if old_length == 0:
            first, begin, last, stop = 0, 0, 0, 0
        else:
            first, begin = self.leaf_at(max(0, start - 1))
            last, at = self.leaf_at(max(start, end - 1) if end > start else max(0, start - 1))
            stop = at + int(self.chars[last + self.size])  # old end of the last leaf so far
        at, tokens, pieces = begin, 0, 0
        for m in PIECES.finditer(text, begin):
            tokens += count[m.group()]
            pieces += 1
            at = m.end()
            while stop + moved < at and stop < old_length:  # passed this boundary: the next leaf goes too
                last += 1
                stop += int(self.chars[last + self.size])
            if at == stop + moved and stop >= end and at >= start + len(new):
                break
        for leaf in range(first + 1, last + 1):
            self.put(leaf, 0, 0)
        self.put(first, at - begin, tokens)
        return text, pieces


def with_trees(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens, tree_chars and tree_tokens (arrays of long). NULL and empty texts have 0 tokens.

    All columns of ``docs`` pass through, but for older columns of these three names.
    """
    rows = docs.drop("n_tokens", "tree_chars", "tree_tokens")
    place = rows.columns.index(text)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for batch in batches:
            trees = [Tree.build(v.as_py() or "", count) for v in batch.column(place)]
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.total() for t in trees], pa.int64()), pa.array([t.chars for t in trees], many), pa.array([t.tokens for t in trees], many)],
                [*batch.schema.names, "n_tokens", "tree_chars", "tree_tokens"])

    sums = ArrayType(LongType())
    return rows.mapInArrow(build, StructType([*rows.schema.fields]).add("n_tokens", "long").add("tree_chars", sums).add("tree_tokens", sums))


def apply_edits(docs: DataFrame, edits: str = "edits", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` of ``with_trees`` after its ``edits``: text, n_tokens and trees renewed; n_encoded added.

    ``edits`` is an array of (start, end, new) in characters of the text before any edit; parts
    that overlap an edit further right are refused with an error. NULL edits and NULL texts change
    nothing; NULL ``new`` deletes. n_encoded is the number of pre-tokens cut and encoded again.
    """
    rows = docs.drop("n_encoded")
    names = rows.columns
    at_text, at_edits, at_n, at_chars, at_tokens = (names.index(c) for c in (text, edits, "n_tokens", "tree_chars", "tree_tokens"))

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for batch in batches:
            cols = {i: batch.column(i).to_pylist() for i in (at_text, at_edits, at_n, at_chars, at_tokens)}
            encoded = [0] * batch.num_rows
            for row, todo in enumerate(cols[at_edits]):
                if not todo or cols[at_text][row] is None:
                    continue
                tree, value, limit = Tree(np.array(cols[at_chars][row]), np.array(cols[at_tokens][row])), cols[at_text][row], None
                for e in sorted(todo, key=lambda e: (e["start"], e["end"]), reverse=True):  # from the right: offsets stay valid
                    if not 0 <= e["start"] <= e["end"] <= (len(value) if limit is None else limit):
                        raise ValueError("an edit lies outside its text or overlaps another")
                    limit = e["start"]
                    value, n = tree.edit(value, e["start"], e["end"], e["new"] or "", count)
                    encoded[row] += n
                cols[at_text][row], cols[at_n][row], cols[at_chars][row], cols[at_tokens][row] = value, tree.total(), tree.chars, tree.tokens
            made = [pa.array(cols[i], batch.schema.field(i).type) if i in cols and i != at_edits else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(encoded, pa.int64())], [*batch.schema.names, "n_encoded"])

    return rows.mapInArrow(change, StructType([*rows.schema.fields]).add("n_encoded", "long"))


def replacements(text: Column, pattern: str, new: str) -> Column:
    """Edits that replace every match of ``pattern``: array of (start, end, new)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern)
    ends = F.aggregate(
        F.zip_with(found, between, lambda f, b: F.struct(F.length(b).alias("b"), F.length(f).alias("f"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,new:string>>").alias("out")),
        lambda s, x: F.when(x["f"].isNull(), s).otherwise(F.struct(
            (s["at"] + x["b"] + x["f"]).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + x["b"]).alias("start"), (s["at"] + x["b"] + x["f"]).alias("end"), F.lit(new).alias("new")))).alias("out"))),
        lambda s: s["out"])
    return F.when(F.size(found) > 0, ends)
