"""Quality rules: base measures of a text, and the frequency of its lines across documents.

Native: DataFrame functions only. Lines are normalised and hashed; for every host the number of
documents that hold a line is counted; lines above the limit are removed, and documents
with too little left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import SPACE, SPACE_CHARS, words

SYMBOLS = "#*$%&|<>"


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    A NULL or empty text counts 0 everywhere. Repeated 3-word windows are found by their 64-bit
    hash; hash and position are packed into one number for sorting, so that a text of n words
    compares 64 - log2(n) bits. Columns of ``df`` keep their names, except the five added.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = t
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    out = df.withColumns({"__w": words(F.col(text)), "__l": lines})
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(bare)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.expr("slice(transform(__w, (x, i) -> xxhash64(x, get(__w, i + 1), get(__w, i + 2))), 1, greatest(size(__w) - 2, 0))"),
    })
    out = out.withColumn("__bits", F.length(F.bin(F.col("n_words"))))
    # Texts without any repeated window, the usual case, skip the sort.
    keys = F.expr("sort_array(transform(__h, (h, i) -> shiftleft(h, __bits) | i))")
    out = out.withColumn("__k", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), keys))
    same = "shiftright({a}, __bits) = shiftright({b}, __bits)"
    before, after = same.format(a="k", b="get(__k, j - 1)"), same.format(a="k", b="get(__k, j + 1)")
    out = out.withColumn("__p", F.expr(
        f"array_sort(filter(transform(__k, (k, j) -> if(coalesce({before}, false) or coalesce({after}, false),"
        " k & (shiftleft(1L, __bits) - 1), null)), k -> k is not null))"))
    covered = F.expr("aggregate(__p, named_struct('n', 0L, 'last', -3L), (s, p) -> named_struct('n', s.n + least(3L, p - s.last), 'last', p), s -> s.n)")
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("__w", "__l", "__h", "__bits", "__k", "__p")


def normal_line(line: Column) -> Column:
    """A line in lower case, trimmed, white space as one space."""
    return F.lower(F.regexp_replace(F.trim(line, F.lit(SPACE_CHARS)), SPACE, " "))


def _keys(host: str, text: str, doc_id: str) -> dict[str, Column]:
    """Row key: equal rows share it; NULL ids have one too."""
    return {"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))), "__key": F.xxhash64(doc_id, host, text),
            "__host": F.coalesce(F.col(host).cast("string"), F.lit(""))}


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  max_docs: int = 10) -> DataFrame:
    """Per distinct row (__id, __key): words in lines above the limit, and those lines' hashes.

    A line that more than ``max_docs`` documents of a host hold, on hosts of any size, is removed from
    all of them. A NULL host is the host ''. Rows that share an id are one document; rows without an id
    are counted as none, and lose what the others lose. Rows without such lines have no row here.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), normal_line), lambda x: x != "")
    sized = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.size(F.split(x, " "))).alias("n")))
    base = docs.select(*[v.alias(k) for k, v in _keys(host, text, doc_id).items()], F.col(doc_id).alias("__doc"), sized.alias("lines"))
    per_doc = base.select("__id", "__key", "__host", F.explode("lines").alias("line")).select(
        "__id", "__key", "__host", "line.h", "line.n")
    # Distinct documents in two steps: a line that very many share is counted in as many places as it has documents.
    frequent = (base.select("__host", "__doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
                .groupBy("__host", "h").agg(F.count_distinct("__doc").alias("n_docs")).where(F.col("n_docs") > max_docs).select("__host", "h"))
    hit = per_doc.join(frequent, ["__host", "h"])
    # Equal rows share a key, so each line of theirs comes once per copy: first per line, then per document.
    copies = docs.select(*[v.alias(k) for k, v in _keys(host, text, doc_id).items()]).groupBy("__id", "__key").agg(F.count("*").alias("copies"))
    lines_hit = hit.groupBy("__id", "__key").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.collect_set("h").alias("cut"))
    return lines_hit.join(copies, ["__id", "__key"]).select(
        "__id", "__key", F.expr("n div copies").alias("words_cut"), F.expr("k div copies").alias("lines_cut"), "cut")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 10,
            min_words: int = 50, max_repeat_pct: int = 50, min_left_pct: int = 30) -> DataFrame:
    """One row per row of ``docs``: base measures, base_failed, lines_cut, words_cut, cut_hashes, kept.

    A document is rejected when it fails the base rules (fewer than ``min_words`` words, or more
    than ``max_repeat_pct`` percent of them in repeated 3-word windows), or when the lines above
    the limit leave less than ``min_left_pct`` percent of its words. Only the four named columns
    are read; other columns of ``docs`` do not pass through.
    """
    keys = _keys(host, text, doc_id)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *[v.alias(k) for k, v in keys.items()])
    base = with_base(base, "__text").drop("__text", "__host")
    cut = line_verdicts(docs, doc_id, text, host, max_docs)
    out = base.join(cut, ["__id", "__key"], "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("words_cut", F.lit(0))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * left >= min_left_pct * F.col("n_words"))).alias("kept"),
        F.coalesce("lines_cut", F.lit(0)).cast("long").alias("lines_cut"),
        F.coalesce("words_cut", F.lit(0)).cast("long").alias("words_cut"),
        F.coalesce("cut", F.array().cast("array<bigint>")).alias("cut_hashes"))


def without_lines(text: Column, cut_hashes: Column) -> Column:
    """``text`` without the lines whose hash is in ``cut_hashes`` (see ``quality``); NULL where either is."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(cut_hashes, F.xxhash64(normal_line(x)))), "\n")
