"""Records from JSON: one object per row, or whole inbox arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import present
from weir.model import (
    MEDIA_TYPES, PRIORITIES, RECORD_DDL, RECORD_FIELDS, REQUIRED_FIELDS, SOURCE_TYPES, record_columns,
)


def record_error(r: Column, keys: Column) -> Column:
    """Why an object is no record: a required key is missing, or an enumeration holds a strange value."""
    required = F.array(*(F.lit(name) for name in REQUIRED_FIELDS))
    missing = F.array_join(F.array_except(required, keys), ",")
    strange = lambda name, allowed: r[name].isNotNull() & ~r[name].isin(allowed)
    return (
        F.when(r.isNull() | keys.isNull(), "undecodable")
        .when(strange("source_type", SOURCE_TYPES), F.concat(F.lit("bad source_type: "), r["source_type"]))
        .when(strange("media_type", MEDIA_TYPES), F.concat(F.lit("bad media_type: "), r["media_type"]))
        .when(strange("priority", PRIORITIES), F.concat(F.lit("bad priority: "), r["priority"]))
        .when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(r["url"].isNull() & present(r["id"]).isNull(), "no url to derive an id from")
    )


def records_from_json(df: DataFrame, column: str, as_of: str, keep: list[str] | None = None) -> DataFrame:
    """Decode one JSON object per row: unknown keys fall away, defaults fill in, empty ids are derived.

    Rows that are no record keep their place with ``error`` set.
    """
    decoded = df.withColumn("_r", F.from_json(column, RECORD_DDL)).withColumn("_keys", F.json_object_keys(column))
    decoded = decoded.withColumn("error", record_error(F.col("_r"), F.col("_keys")))
    fields = {name: F.col("_r")[name] for name in RECORD_FIELDS}
    typed = F.from_json(column, "extra map<string,variant>")["extra"]
    fields["extra"] = F.transform_values(typed, lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    defaults = {
        "media_type": F.lit("text"), "score": F.lit(0), "priority": F.lit("normal"), "category": F.lit(""),
        "tags": F.array().cast("array<string>"), "processed": F.lit(False),
        "extra": F.create_map().cast("map<string,string>"),
    }
    for name, value in defaults.items():
        fields[name] = F.coalesce(fields[name], value)
    return decoded.select(*(keep or []), "error", *record_columns(as_of, **fields))


def load_arrays(df: DataFrame, column: str, as_of: str, keep: list[str], strict: bool = False) -> DataFrame:
    """Inbox texts (a JSON array each) to records with their position ``pos``.

    An undecodable text counts as an empty inbox. A strange enumeration value
    is kept as a row with ``error``; ``strict`` stops the job instead.
    """
    objects = df.select(
        *keep,
        F.posexplode(F.from_json(column, "array<string>")).alias("pos", "_json"),
    )
    out = records_from_json(objects, "_json", as_of, [*keep, "pos"])
    if strict:
        bad = F.col("error").startswith("bad ")
        out = out.withColumn("error", F.when(bad, F.raise_error(F.col("error"))).otherwise(F.col("error")))
    return out


def read_inbox_file(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Inbox exports from files or folders of files; a path that does not exist is an empty inbox."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        texts = spark.createDataFrame([], "file string, value string")
    else:
        texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return load_arrays(texts, "value", as_of, ["file"])


def read_inbox_files(spark: SparkSession, paths: list[str], as_of: str) -> DataFrame:
    """Inbox exports ``(file, pos, error, record columns)`` from many files, each read by the task that gets it.

    A file that is not there, or is no JSON array, is one row without a place and with its error; an
    object that is no record keeps its place. An empty array gives no row. One export is one value, as it is one array.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    found, lost = [], []
    for p in paths:
        file = hadoop.Path(p)
        fs = file.getFileSystem(conf)
        if not fs.exists(file):
            lost.append((p, "no such file"))
        elif fs.getFileStatus(file).isFile() and not fs.getFileStatus(file).getLen():  # Spark's readers pass over it
            lost.append((p, "undecodable file"))
        else:
            found.append(p)
    texts = spark.createDataFrame([], "file string, value string")
    if found:
        texts = spark.read.text(found, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    items = F.from_json("value", "array<string>")
    cut = texts.withColumn("_items", items).select(
        "file", F.posexplode(F.coalesce("_items", F.array(F.lit(None).cast("string")))).alias("pos", "_json"), F.col("_items").isNull().alias("_bad"))
    rows = records_from_json(cut, "_json", as_of, ["file", "pos", "_bad"])
    rows = rows.withColumn("error", F.when(F.col("_bad"), "undecodable file").otherwise(F.col("error"))).withColumn(
        "pos", F.when(~F.col("_bad"), F.col("pos"))).drop("_bad")
    return rows.unionByName(spark.createDataFrame(lost, "file string, error string"), allowMissingColumns=True) if lost else rows


def read_export(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Exports with one JSON object per line; large files are read by many tasks."""
    return records_from_json(spark.read.text(path), "value", as_of)
