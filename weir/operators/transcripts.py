"""Transcripts from subtitle lines, subtitle files and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.text import is_spoken, let, or_empty, strip
from weir.operators.inbox import first_wins


def pick_subtitles(files: DataFrame, key: str, languages: list[str], extensions: tuple[str, ...] = ("srt", "vtt"),
                   items: DataFrame | None = None) -> DataFrame:
    """The best subtitle file per item among ``(key, name, body)``: language first, then extension.

    With ``items(key)`` every item comes back once; one without a wanted file has NULL name and body.
    """
    wanted = [f".{lang}.{ext}" for lang in languages for ext in extensions]
    rank = F
    for position, ending in enumerate(wanted):
        rank = rank.when(F.col("name").endswith(ending), position)
    best = first_wins(
        files.withColumn("_rank", rank.otherwise(None)).filter("_rank is not null"), key, ["_rank", "name"]
    ).drop("_rank")
    return best if items is None else items.select(key).distinct().join(best, key, "left")


def distinct_lines(lines: DataFrame, file: str, pos: list[str], line: str = "line") -> DataFrame:
    """Spoken lines landed one per row: first occurrence per file.

    The row-wise twin of the text function, for subtitle tracks too long for
    one value. Equal lines meet by (file, line), never a whole file.
    """
    spoken = lines.filter(let(strip(F.col(line)), is_spoken))
    trimmed = spoken.withColumn(line, strip(F.col(line)))
    return first_wins(trimmed, [file, line], pos)


def concat_segments(segments: DataFrame, key: str, position: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """Segment texts joined in order: ``(key, transcript)``, one row per key.

    A transcript is one value, so it must fit one (2 GB). Where a recording does not, keep its
    segments as rows; ``distinct_lines`` works on them.
    """
    ordered = F.array_sort(F.collect_list(F.struct(position, text)))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s[text]), separator).alias("transcript"))


def stats(df: DataFrame, key: str, transcript: Column) -> DataFrame:
    return df.select(
        key, F.length(or_empty(transcript)).alias("n_chars"), (or_empty(transcript) != "").alias("has_transcript")
    )
