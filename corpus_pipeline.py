"""A training corpus from raw documents: five stages, each over all that the one before kept.

``run`` writes each stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import language, mixing, near_duplicates, packing, secrets
from weir.llm.common import documents, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a language (NULL, empty, no letters) or with a mean probability
    below 0.35 go; ``lang`` becomes the predicted language. Learns from the landed documents."""
    model = language.train(documents(spark, sf_dir))
    kept = language.predict(docs, model, keep=COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.35))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of texts with a similarity of 0.8 or more, the document
    with the smallest id stays (of several texts under that id, the one of the smallest hash; one row, if rows repeat it). Rows
    without an id and texts without words stay."""
    found = near_duplicates.linked(docs, percent=80, matches=36)
    keep = found.where("leads").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    rows = docs.withColumn("__h", F.xxhash64("text"))
    firsts = rows.join(keep.withColumnRenamed("__d", "doc_id"), ["doc_id", "__h"], "left_semi").dropDuplicates(["doc_id", "__h"])
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return firsts.unionByName(rows.where(F.col("doc_id").isNull() | wordless)).select(*COLUMNS)


def scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: secrets are replaced by ``[secret]``; no document goes. ``n_chars`` follows."""
    clean = secrets.redact(docs, secrets.scan(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document once, those of small sources up to twice; copies are rows of their own."""
    plan = mixing.mix(docs, target_entropy=None, max_repeat=2.0, budget=None)
    copies = plan.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), "copies").dropDuplicates(["__d", "__s"])
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
    return docs.join(copies, same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of documents in bins of 2,048 words; copies never share a bin."""
    return packing.best_fit(packing.with_lengths(docs))


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("secret_scan", scan), ("mixing", mix), ("packing", pack)]

#: The learned models, the similarity search and the packing have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
