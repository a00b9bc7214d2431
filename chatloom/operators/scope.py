"""Membership scope: every read goes through scoped()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(now: Column, open_only: bool = False, check_start: bool = False) -> Column:
    """A grant that holds at `now`; open_only accepts no end at all, check_start also tests the start."""
    holds = F.col("valid_to").isNull() if open_only else F.col("valid_to").isNull() | (F.col("valid_to") > now)
    return holds & (F.col("valid_from") <= now) if check_start else holds


def grants_of(memberships: DataFrame, caller, now: Column, **rules: bool) -> DataFrame:
    return memberships.filter((F.col("caller_id") == caller) & active(now, **rules)).select("channel_id").distinct()


def scoped(rows: DataFrame, grants: DataFrame, key: str = "channel_id") -> DataFrame:
    """Default deny: rows of channels with a grant."""
    return rows.join(grants, key, "left_semi")


def hidden_channels(channels: DataFrame, grants: DataFrame) -> DataFrame:
    return channels.join(grants, "channel_id", "left_anti")


def dedupe_open_grants(memberships: DataFrame) -> DataFrame:
    """Of several open grants of a caller and channel, the one that starts first; closed grants stay."""
    is_open = F.col("valid_to").isNull()
    first = Window.partitionBy("caller_id", "channel_id", is_open).orderBy("valid_from", "grant_id")
    return memberships.withColumn("_k", F.row_number().over(first)).filter(~is_open | (F.col("_k") == 1)).drop("_k")


def missing_owner_grants(viewers: DataFrame, channels: DataFrame, memberships: DataFrame, block: int = 1000) -> DataFrame:
    """Viewer and channel pairs without a grant. Viewers are a handful by contract; more come in blocks, each spread over the channels."""
    few, out = viewers.select("caller_id").distinct(), None
    n = max(1, -(-few.count() // block))
    for k in range(n):
        own = [r[0] for r in few.filter(F.pmod(F.xxhash64("caller_id"), F.lit(n)) == k).collect()]
        names = F.array(*(F.lit(x) for x in own)) if own else F.array().cast(f"array<{few.schema['caller_id'].dataType.simpleString()}>")
        pairs = channels.select("channel_id", F.explode(names).alias("caller_id"))
        missing = pairs.join(memberships, ["caller_id", "channel_id"], "left_anti").select("caller_id", "channel_id", F.lit("owner").alias("role"))
        out = missing if out is None else out.unionByName(missing)
    return out
