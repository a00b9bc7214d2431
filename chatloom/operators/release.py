"""Immutable releases with an atomic pointer, manifests and digests."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.operators.windows import global_rank
from chatloom.session import exists, read_text, write_text

# Keys that a configuration's hash leaves out.
VOLATILE = frozenset({"output_path", "run_id", "created_at", "timestamp"})


def config_hash(config: Any) -> str:
    """sha256 of a configuration: volatile keys gone at any depth, floats to 12 digits, keys sorted, ASCII."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k not in VOLATILE}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return f"{x:.12g}" if isinstance(x, float) else x

    return hashlib.sha256(json.dumps(plain(config), ensure_ascii=True, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def row_digest(rows: DataFrame) -> str:
    """A digest of a table whatever its order: counts and sums of row hashes."""
    h = F.xxhash64(*sorted(rows.columns))
    r = rows.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0))).first()
    return hashlib.sha256("|".join(map(str, r)).encode()).hexdigest()


def ordered_digests(rows: DataFrame, group: str, key: str, parts: list[str], fan: int = 1024, levels: int = 4) -> DataFrame:
    """(group, n, digest): sha256 over the rows of each group in key order, by `levels` levels of `fan` digests each.

    A row's digest is that of its key and parts; each level joins the digests of `fan` neighbours and digests them. It
    depends on the order of keys alone, not on files, and no array holds more than `fan` digests. Up to fan ** levels rows a group.
    """
    line = F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in [key, *parts]))
    own = global_rank(rows.select(F.col(group).alias("_g"), F.col(key).alias("_key"), F.sha2(line, 256).alias("_d")), ["_g", "_key", "_d"], "_place")
    first = own.groupBy("_g").agg(F.min("_place").alias("_first"), F.count("*").alias("n")).withColumnRenamed("_g", "_h")
    level = own.join(first, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", (F.col("_place") - F.col("_first")).alias("_at"), "_d", "n")
    over = F.when(F.col("n") > fan**levels, F.raise_error(F.lit("more rows in a group than the levels hold"))).otherwise(F.col("n"))
    for _ in range(levels):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "")
        level = level.groupBy("_g", F.floor(F.col("_at") / fan).alias("_at")).agg(F.sha2(joined, 256).alias("_d"), F.max("n").alias("n"))
    return level.select(F.col("_g").alias(group), over.cast("long").alias("n"), F.col("_d").alias("digest"))


def publish(rows: DataFrame, root: str, about: dict | None = None, approve: bool = True) -> str:
    """Writes a new release beside the old ones; with approve, CURRENT is moved in one step."""
    return publish_tables({"": rows}, root, {}, about, approve)


def publish_tables(tables: dict[str, DataFrame], root: str, references: dict[tuple[str, str], tuple[str, str]], about: dict | None = None, approve: bool = True) -> str:
    """A full refresh: all tables as one release, seen together or not at all.

    references: (table, column) -> (table, column) that must hold each value that is not null. Everything is written and checked
    before the release has a manifest; only then may CURRENT point to it.
    """
    spark, name = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    at = {table: f"{root}/releases/{name}/{table}".rstrip("/") for table in tables}
    for table, rows in tables.items():
        rows.write.parquet(at[table])
    read = {table: spark.read.schema(rows.schema).parquet(at[table]) for table, rows in tables.items()}
    for (table, column), (other, key) in references.items():
        lost = read[table].filter(F.col(column).isNotNull()).join(read[other].select(F.col(key).alias(column)), column, "left_anti").count()
        if lost:
            raise ValueError(f"{lost} rows of {table}.{column} are not in {other}.{key}")
    manifest = {"release": name, "digests": {table: row_digest(rows) for table, rows in read.items()}, "schemas": {table: rows.schema.json() for table, rows in read.items()}, "about": about or {}}
    write_text(spark, f"{root}/releases/{name}.json", json.dumps(manifest, sort_keys=True))
    if approve:
        promote(spark, root, name)
    return name


def promote(spark: SparkSession, root: str, name: str, report: DataFrame | None = None) -> None:
    """Move CURRENT to a release that has a manifest; with a report, only if all of its `passes` hold."""
    if not exists(spark, f"{root}/releases/{name}.json"):
        raise ValueError(f"release {name} was not finished")
    if report is not None and (report.filter(~F.coalesce("passes", F.lit(False))).count() or not report.count()):
        raise ValueError(f"release {name} does not pass its gates")
    write_text(spark, f"{root}/CURRENT", name)


def current(spark: SparkSession, root: str, table: str = "") -> DataFrame:
    """A table of the approved release; fails if its rows are not those that were published."""
    name = read_text(spark, f"{root}/CURRENT").strip()
    manifest = json.loads(read_text(spark, f"{root}/releases/{name}.json"))
    rows = spark.read.schema(StructType.fromJson(json.loads(manifest["schemas"][table]))).parquet(f"{root}/releases/{name}/{table}".rstrip("/"))
    if row_digest(rows) != manifest["digests"][table]:
        raise ValueError(f"release {name} has been changed")
    return rows


def index_manifest(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str, list[str]]], about: dict[str, Any]) -> dict:
    """Binds what an index holds now into one file: of each table (rows, key, parts) its count and digest in key order."""
    found = {}
    for name, (rows, key, parts) in tables.items():
        digest = ordered_digests(rows.withColumn("_all", F.lit(0)), "_all", key, parts).first()
        found[name] = {"count": digest["n"] if digest else 0, "sha256": digest["digest"] if digest else None}
    manifest = {"artifact_type": "index", "tables": found, "about": about}
    write_text(spark, path, json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest
