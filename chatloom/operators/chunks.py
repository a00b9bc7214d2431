"""Greedy chunking of conversations, sections of hits and their expansion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.windows import folded

# Limits of a chunk.
MOST_MESSAGES, MOST_TOKENS = 20, 400


def place(state: tuple[int, int, int], tokens: int, most_messages: int = MOST_MESSAGES, most_tokens: int = MOST_TOKENS) -> tuple[int, int, int]:
    """(chunk, messages, tokens) after one more message; an over-long first message is still taken."""
    chunk, n, k = state
    if n and (n + 1 > most_messages or k + tokens > most_tokens):
        return chunk + 1, 1, tokens
    return chunk, n + 1, k + tokens


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def greedy_chunks(messages: DataFrame, channel: str, order: str, text: str, most_messages: int = MOST_MESSAGES, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Adds n_tokens and the 0-based chunk_index. Batch and stream use the same step."""

    def step(state, n_tokens):
        state = place(state, n_tokens, most_messages, most_tokens)
        return state, state[0]

    counted = messages.withColumn("n_tokens", count_tokens(F.col(text)).cast("long"))
    return folded(counted, [channel], [order], lambda: (0, 0, 0), step, "chunk_index", pa.int64(), ("n_tokens",))


def message_line(sender: str, text: str, media: str | None = None) -> Column:
    """`sender: text`, then `[image:id]` for each of a message's media, so that they stand where they were sent."""
    line = F.concat(F.coalesce(F.col(sender).cast("string"), F.lit("unknown")), F.lit(": "), F.coalesce(text, F.lit("")))
    if media is None:
        return line
    images = F.array_join(F.transform(F.coalesce(F.col(media), F.array().cast("array<string>")), lambda x: F.concat(F.lit("[image:"), x.cast("string"), F.lit("]"))), " ")
    return F.when(images != "", F.concat(line, F.lit(" "), images)).otherwise(line)


def chunk_table(chunked: DataFrame, channel: str, order: str, sender: str, text: str, closed_only: bool = False, day: str | None = None, media: str | None = None) -> DataFrame:
    """One row a chunk: its message range, header and lines; the last chunk of a channel is open.

    With day, the header tells that of the chunk's first message; with media, lines name their images.
    """
    line = message_line(sender, text, media)
    rows = chunked.groupBy(channel, "chunk_index").agg(
        F.min(order).alias("first_ordinal"),
        F.max(order).alias("last_ordinal"),
        F.count("*").alias("n_messages"),
        F.sum("n_tokens").alias("token_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("_lines"),
        *([F.min_by(F.col(day).cast("string"), order).alias("_day")] if day else []),
    )
    last = F.max("chunk_index").over(Window.partitionBy(channel))
    rows = rows.withColumn("status", F.when(F.col("chunk_index") == last, "open").otherwise("closed")).withColumn("text", F.concat(F.lit("[conversation:"), F.col(channel).cast("string"), F.lit("]"), *([F.lit(" [day:"), F.coalesce("_day", F.lit("")), F.lit("]")] if day else []), F.lit("\n"), F.col("_lines"))).drop("_lines", "_day")
    return rows.filter("status = 'closed'") if closed_only else rows


def sections(hits: DataFrame, document: str, index: str, rank: str, most: int = 3) -> DataFrame:
    """Runs of neighbouring hits in a document; the best `most` of each, its centre and its rank."""
    w = Window.partitionBy(document).orderBy(index)
    keyed = hits.withColumn("_key", F.col(index) - F.row_number().over(w))
    best = F.row_number().over(Window.partitionBy(document, "_key").orderBy(rank, index))
    kept = keyed.withColumn("_k", best).filter(F.col("_k") <= most)
    return kept.groupBy(document, "_key").agg(
        F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count("*").alias("n_hits"), F.min_by(index, F.struct(rank, index)).alias("center_index"), F.min(rank).alias("section_rank")
    ).drop("_key")


def capped(rows: DataFrame, order: list, tokens: str, most_rows: int, most_tokens: int) -> DataFrame:
    """The first rows of the order while their tokens fit; at most most_rows, so the window sees no more than those."""
    few = rows.orderBy(*order).limit(most_rows)
    running = F.sum(tokens).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("running_tokens", running).filter(F.col("running_tokens") <= most_tokens)


def expanded(selected: DataFrame, chunks: DataFrame, document: str, index: str) -> DataFrame:
    """Chunks around each centre by level: 0 none, 1 the section, 2 two on either side, 3 five; clipped to the document by the join."""
    reach = F.when(F.col("level") == 2, 2).when(F.col("level") == 3, 5).otherwise(0)
    low = F.when(F.col("level") == 1, F.col("first_index")).otherwise(F.col("center_index") - reach)
    high = F.when(F.col("level") == 1, F.col("last_index")).otherwise(F.col("center_index") + reach)
    wanted = selected.filter("level > 0").select(document, F.explode(F.sequence(low, high)).alias(index)).distinct()
    return chunks.join(wanted, [document, index], "left_semi")


def directed_ranges(selected: DataFrame, chunks: DataFrame, document: str, index: str) -> DataFrame:
    """(selected columns, low, high, truncated): the chunks that a section's level and direction reach, inside its document.

    Level 1 is the section alone; 2 and 3 reach 2 and 5 chunks to either side of the centre, or 4 and 10 to one side: `forward` from the
    section's last chunk, `backward` from its first. truncated: the document ends earlier. Sections of level 0 are gone.
    """
    ends = chunks.groupBy(document).agg(F.min(index).alias("_first"), F.max(index).alias("_last"))
    both, one = F.when(F.col("level") == 2, 2).otherwise(5), F.when(F.col("level") == 2, 4).otherwise(10)
    alone = (F.col("level") == 1) | F.col("direction").isNull() | ~F.col("direction").isin("both", "forward", "backward")
    low = F.when(alone, F.col("first_index")).when(F.col("direction") == "both", F.col("center_index") - both).when(F.col("direction") == "backward", F.col("first_index") - one).otherwise(F.col("first_index"))
    high = F.when(alone, F.col("last_index")).when(F.col("direction") == "both", F.col("center_index") + both).when(F.col("direction") == "forward", F.col("last_index") + one).otherwise(F.col("last_index"))
    rows = selected.filter("level > 0").join(ends, document).withColumns({"_low": low, "_high": high})
    cut = (F.col("_low") < F.col("_first")) | (F.col("_high") > F.col("_last"))
    return rows.select(*selected.columns, F.greatest("_low", "_first").alias("low"), F.least("_high", "_last").alias("high"), cut.alias("truncated"))


def output_chunks(ranges: DataFrame, query: str, document: str, rank: str, most: int = 30) -> DataFrame:
    """(query, document, chunk, rank): chunks of all ranges once each, under their best rank, the first `most` of each query."""
    each = ranges.select(query, document, rank, F.explode(F.sequence("low", "high")).alias("chunk_index"))
    once = each.groupBy(query, document, "chunk_index").agg(F.min(rank).alias(rank))
    place = F.row_number().over(Window.partitionBy(query).orderBy(rank, document, "chunk_index"))
    return once.withColumn("_k", place).filter(F.col("_k") <= most).drop("_k")


def merged_ranges(ranges: DataFrame, document: str, low: str, high: str) -> DataFrame:
    """Overlapping or touching ranges of a document as one."""
    w = Window.partitionBy(document).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(reach.isNull() | (F.col(low) > reach + 1), 1).otherwise(0)
    keyed = ranges.withColumn("_cut", cut).withColumn("_key", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return keyed.groupBy(document, "_key").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_key")
