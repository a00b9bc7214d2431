"""Feed pages, event replay, attachments and resume points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of page sizes.
DEFAULT_LIMIT, MOST = 100, 500
BEFORE_FIRST = -1


def clamp_limit(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 or limit > MOST else limit


def cursor(after: int | None = None, before: int | None = None) -> Column:
    """Rows past one of the two cursors; without one, everything from ordinal 0."""
    if after is not None and before is not None:
        raise ValueError("a page has one cursor")
    return F.col("feed_ordinal") < before if before is not None else F.col("feed_ordinal") > (BEFORE_FIRST if after is None else after)


def forward_page(rows: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    return rows.filter(cursor(after)).orderBy("feed_ordinal", "message_id").limit(clamp_limit(limit))


def backward_page(rows: DataFrame, limit: int, before: int) -> DataFrame:
    """The last rows before the cursor, in ascending order."""
    return rows.filter(cursor(before=before)).orderBy(F.desc("feed_ordinal"), F.desc("message_id")).limit(clamp_limit(limit)).orderBy("feed_ordinal", "message_id")


def event_stream(rows: DataFrame, event: str, data: list[str]) -> DataFrame:
    """(feed_ordinal, frame): each row as one frame of a text/event-stream, its data as compact JSON."""
    body = F.to_json(F.struct(*data), {"ignoreNullFields": "false"})
    return rows.select("feed_ordinal", F.concat(F.lit("id: "), "feed_ordinal", F.lit(f"\nevent: {event}\ndata: "), body, F.lit("\n\n")).alias("frame"))


def with_senders(rows: DataFrame, senders: DataFrame) -> DataFrame:
    named = rows.join(senders.select("sender_id", "display_name"), "sender_id", "left")
    return named.withColumn("sender_id", F.coalesce(F.col("sender_id").cast("string"), F.lit("unknown"))).withColumn("display_name", F.coalesce("display_name", F.lit("Unknown")))


def with_attachments(messages: DataFrame, media: DataFrame, key: str = "message_id", item: str = "media_id") -> DataFrame:
    """A sorted list of attached ids, empty where there is none."""
    lists = media.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("media_ids"))
    return messages.join(lists, key, "left").withColumn("media_ids", F.coalesce("media_ids", F.array().cast(lists.schema["media_ids"].dataType)))


def resume_point(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages after the last one that any chunk of their channel holds."""
    last = chunks.groupBy("channel_id").agg(F.max("last_feed_ordinal").alias("_last"))
    return messages.join(last, "channel_id", "left").filter(F.col("feed_ordinal") > F.coalesce("_last", F.lit(BEFORE_FIRST))).drop("_last")


def next_pending_media(media: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The oldest bound media without an embedding."""
    return media.filter(F.col("parent_message_id").isNotNull()).join(embeddings, "media_id", "left_anti").orderBy("created_at", "media_id").limit(1)


def live_drafts(media: DataFrame, owner, channel, now: Column, ttl_seconds: int) -> DataFrame:
    alive = F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now
    return media.filter(F.col("parent_message_id").isNull() & (F.col("uploader_id") == owner) & (F.col("channel_id") == channel) & alive)


def allocate_ordinals(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Channel ordinals of a batch of messages, after the largest one in use."""
    last = existing.groupBy("channel_id").agg(F.max("ordinal").alias("_last"))
    numbered = new.withColumn("_k", F.row_number().over(Window.partitionBy("channel_id").orderBy(*order)))
    return numbered.join(last, "channel_id", "left").withColumn("ordinal", F.coalesce("_last", F.lit(-1)) + F.col("_k")).drop("_k", "_last")


def raised_last(channels: DataFrame, messages: DataFrame) -> DataFrame:
    """Channels with last_ordinal moved up to their newest message, never down."""
    newest = messages.groupBy("channel_id").agg(F.max("ordinal").alias("_newest"))
    return channels.join(newest, "channel_id", "left").withColumn("last_ordinal", F.greatest("last_ordinal", "_newest")).drop("_newest")


def queue_head(outbox: DataFrame, now: Column, limit: int = 1) -> DataFrame:
    """Interrupted events first, then those whose turn has come."""
    ready = (F.col("status") == "processing") | ((F.col("status") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return outbox.filter(ready).orderBy(F.when(F.col("status") == "processing", 0).otherwise(1), "event_id").limit(limit)


def outbox_status(attempts: DataFrame, most: int = 5) -> DataFrame:
    """Replay of attempt results (event_id, attempt, ok): done, dead_letter or pending with the attempts made."""
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    made = F.count("*")
    folded = attempts.groupBy("event_id").agg(first_ok.alias("_ok"), made.alias("_n"))
    count = F.least(F.coalesce("_ok", F.col("_n")), F.lit(most)).cast("long")
    status = F.when(F.col("_ok").isNotNull() & (F.col("_ok") <= most), "done").when(F.col("_n") >= most, "dead_letter").otherwise("pending")
    return folded.select("event_id", status.alias("status"), count.alias("attempt_count"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return new.unionByName(old.join(new, key, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))
