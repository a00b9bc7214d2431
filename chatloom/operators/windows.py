"""Ordering, segmentation and sampling by windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import staged


def global_rank(rows: DataFrame, order: list[str], name: str = "chronological_rank") -> DataFrame:
    """0-based position in a total order, without a task that sees all rows.

    Rows are dealt by ranges of the order and written once; each range is numbered on
    its own and moved by the counts of those before it.
    """
    ranged = staged(rows.repartitionByRange(*(F.col(c) for c in order)).withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):  # one row a partition
        offsets.append((r[0], before))
        before += r[1]
    if not offsets:
        return ranged.drop("_range").withColumn(name, F.lit(None).cast("long"))
    moved = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_range int, _before long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_k", inside).join(moved, "_range").withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_range", "_k", "_before")


def global_running(rows: DataFrame, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """The sum of the weights that come earlier in a total order, without a task that sees all rows."""
    ranged = staged(rows.repartitionByRange(*(F.col(c) for c in order)).withColumn("_range", F.spark_partition_id()))
    total, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.sum(weight).alias("n")).collect()):  # one row a partition
        offsets.append((r["_range"], total))
        total += r["n"]
    moved = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_range int, _moved long"))
    inside = F.sum(weight).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_sum", inside).join(moved, "_range").withColumn(name, F.col("_moved") + F.col("_sum") - F.col(weight)).drop("_range", "_sum", "_moved")


def adjacent_inversion(rows: DataFrame, group: str, order: str, day: str) -> DataFrame:
    """Both neighbours of an inverted pair are flagged: the one before has the later day."""
    w = Window.partitionBy(group).orderBy(order)
    down = F.coalesce(F.lag(day).over(w) > F.col(day), F.lit(False))
    up = F.coalesce(F.lead(day).over(w) < F.col(day), F.lit(False))
    return rows.withColumn("temporal_order_conflict", down | up)


def gap_minutes(ts: str, w) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / F.lit(60_000_000.0)


def gap_segments(rows: DataFrame, group: str, ts: str, tie: str, minutes: float) -> DataFrame:
    """0-based segment within the group; a gap above the limit starts a new one, a negative gap never does."""
    w = Window.partitionBy(group).orderBy(ts, tie)
    cut = F.when(gap_minutes(ts, w) > minutes, 1).otherwise(0)
    return rows.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_cut")


def gap_buckets(rows: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    gaps = rows.select(gap_minutes(ts, Window.partitionBy(group).orderBy(ts, tie)).alias("gap")).filter("gap is not null")
    bucket = F.when(F.col("gap") <= 5, "<=5").when(F.col("gap") <= 60, "5-60").otherwise(">60")
    return gaps.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def islands(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Maximal runs of consecutive ordinals: (group, island, first, last, n)."""
    w = Window.partitionBy(group).orderBy(ordinal)
    keyed = rows.select(group, ordinal).distinct().withColumn("_key", F.col(ordinal) - F.row_number().over(w))
    runs = keyed.groupBy(group, "_key").agg(F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"), F.count("*").alias("n"))
    return runs.withColumn("island", F.row_number().over(Window.partitionBy(group).orderBy("first_ordinal")).cast("long") - 1).drop("_key")


def contiguous_prefix(rows: DataFrame, group: str, ordinal: str, expected: int) -> DataFrame:
    """Rows that can be shown: those from the expected ordinal on without a gap."""
    runs = islands(rows.filter(F.col(ordinal) >= expected), group, ordinal).filter(F.col("first_ordinal") == expected)
    return rows.join(runs.select(group, "last_ordinal"), group).filter((F.col(ordinal) >= expected) & (F.col(ordinal) <= F.col("last_ordinal"))).drop("last_ordinal")


def bursts(rows: DataFrame, group: str, order: str, sender: str, is_image: str) -> DataFrame:
    """Numbers runs of images by one sender without a message between; null for other rows."""
    w = Window.partitionBy(group).orderBy(order)
    same = F.lag(is_image).over(w) & F.col(is_image) & F.lag(sender).over(w).eqNullSafe(F.col(sender))
    start = F.when(F.col(is_image) & ~F.coalesce(same, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("burst", F.when(F.col(is_image), F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def sequence_id(rows: DataFrame, stratum: str, order: list[str], prefix: str = "q") -> DataFrame:
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("query_id", F.concat_ws("_", F.lit(prefix), F.col(stratum).cast("string"), F.lpad(k.cast("string"), F.greatest(F.lit(4), F.length(k.cast("string"))), F.lit("0"))))


def systematic_sample(rows: DataFrame, order: list[str], every: int = 20) -> DataFrame:
    """Every n-th row of the order, beginning with the first."""
    return global_rank(rows, order, "_rank").filter(F.col("_rank") % every == 0).drop("_rank")


def top_per_group(rows: DataFrame, group: str, order: list, n: int, overall: int | None = None, overall_order: list | None = None) -> DataFrame:
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
    return best.orderBy(*(overall_order or order)).limit(overall) if overall else best


def folded(rows: DataFrame, group: list[str], order: list[str], start, step, out: str, out_type: pa.DataType, needs: tuple[str, ...]) -> DataFrame:
    """Adds what step(state, *needed values) -> (state, value) says of each row, in order within its group.

    Rows stream through sorted partitions, so memory is one state whatever the size of a group. Only the columns
    of the group and those that a step needs become Python values; the others pass as they came.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            values = []
            keys, needed = (zip(*(batch.column(names.index(c)).to_pylist() for c in cs), strict=True) for cs in (group, needs))
            for own, row in zip(keys, needed, strict=True):
                if own != key or state is None:
                    key, state = own, start()
                state, value = step(state, *row)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, out_type)], names=[*names, out])

    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(out, from_arrow_type(out_type))])
    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def quota_take(rows: DataFrame, order: list[str], quotas: dict[str, int], stratum: str = "stratum") -> DataFrame:
    """The first rows of each stratum up to its quota; strata without one take none."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    most = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    return rows.withColumn("_k", k).filter(F.col("_k") <= F.coalesce(F.element_at(most, F.col(stratum)), F.lit(0))).drop("_k")


def diverse_evidence(rows: DataFrame, query: str, session: str, order: list, most: int = 3) -> DataFrame:
    """One visit in rank order. A row of a new session is always taken, and ends the visit once
    `most` rows are taken; a row of a known session is taken while there are fewer."""

    def step(state, own):
        taken, sessions, over = state
        new = own not in sessions
        take = not over and (new or taken < most)
        if take:
            taken, sessions = taken + 1, sessions | {own}
        return (taken, sessions, over or (take and new and taken >= most)), take

    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return folded(ranked, [query], ["_rank"], lambda: (0, frozenset(), False), step, "taken", pa.bool_(), (session,)).filter("taken").drop("_rank", "taken")
