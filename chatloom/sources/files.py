"""Readers and writers of the chat corpus. Schemas are always given, never inferred."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "session_id string, timeline_date string, dialogue array<struct<role:string,content:struct<text:string,image:string>>>"
QUESTIONS = (
    "metadata struct<session_number:int,source:string>, questions array<struct<original_question_id:string,question:struct<text:string,image:string>,"
    "original_answer:string,validation_notes:string,question_type:struct<main_type:string,sub_type:string>,answer_session:array<string>>>"
)
IMAGE_SUFFIXES = ("gif", "jpeg", "jpg", "png", "webp")
PLACE = r"([^/]+)/dialogue(\d+)/scenes/session(\d+)/[^/]+$"


def _json(spark: SparkSession, root: str, schema: str, name: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("mode", "FAILFAST")
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def sessions(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, SESSION, "session.json")


def questions(spark: SparkSession, root: str) -> DataFrame:
    """One row a question, with the family and dialogue of its path; single says that it has exactly one answer session."""
    rows = _json(spark, root, QUESTIONS, "questions.json").select("path", "metadata", F.posexplode("questions").alias("position", "q"))
    rows = rows.select("path", "position", "metadata.*", "q.*")
    place = lambda k: F.regexp_extract("path", r"([^/]+)/dialogue(\d+)/", k)
    return rows.withColumn("family", place(1)).withColumn("dialogue", place(2).cast("int")).withColumn("single", F.size("answer_session") == 1)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, content_sha256, length) of image files outside .git."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    mine = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES) & ~F.contains(F.col("path"), F.lit("/.git/"))
    return files.filter(mine).select("path", F.sha2("content", 256).alias("content_sha256"), "length")


def object_mismatches(objects: DataFrame) -> DataFrame:
    """Content-addressed files whose name is not their digest. objects: (path, content_sha256)."""
    return objects.filter(F.element_at(F.split("path", "/"), -1) != F.col("content_sha256"))


def vectors(spark: SparkSession, path: str, key: str, vector: str, size: int) -> DataFrame:
    """A matrix by id: every vector has the size, every id occurs once, else it fails."""
    rows = spark.read.parquet(path)
    bad = rows.agg(F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != size).alias("shape"), (F.count("*") - F.count_distinct(key)).alias("repeats")).first()
    if bad["shape"] or bad["repeats"]:
        raise ValueError(f"{bad['shape']} vectors of another size, {bad['repeats']} repeated or null ids")
    return rows


def encoded(rows: DataFrame, encode: Callable[[Iterator], Iterator], schema: str, out: str, batches: int) -> DataFrame:
    """Runs an encoder in resumable batches: a batch whose folder has the success marker is not run again."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for k in range(batches):
        done = fs_path(f"{out}/{k}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows.filter(F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(batches)) == k).mapInPandas(encode, schema).write.mode("overwrite").parquet(f"{out}/{k}")
    return spark.read.parquet(*(f"{out}/{k}" for k in range(batches)))


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_jsonl(rows: DataFrame, order: list[str], path: str, files: int | None = 1) -> None:
    """An export of rows in order, keys sorted, nulls kept: in one file, or in ranges of the order whose files follow by name (files=None lets Spark choose how many)."""
    lines = rows.select(canonical_json(rows.columns).alias("value"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(order)))
    by = [f"_{k}" for k in range(len(order))]
    ranged = lines.orderBy(*by) if files is None else lines.repartitionByRange(files, *by).sortWithinPartitions(*by) if files > 1 else lines.orderBy(*by).coalesce(1)
    ranged.select("value").write.mode("overwrite").text(path)


def lookup(spark: SparkSession, path: str, top: str, key: str, value: str) -> DataFrame:
    """A small mapping file (JSON, or YAML where a YAML reader is installed) as (key, value) rows."""
    with open(path, encoding="utf-8") as f:
        if os.path.splitext(path)[1] in (".yaml", ".yml"):
            import yaml

            found = yaml.safe_load(f)
        else:
            found = json.load(f)
    return spark.createDataFrame([(str(k), str(v)) for k, v in (found.get(top) or {}).items()], f"{key} string, {value} string")
