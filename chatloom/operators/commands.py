"""Commands as merge plans over a batch: sends with drafts, closing chunks, replays, counters.

Each takes the state before the batch and returns rows to add; a batch is committed whole by the
writer (a versioned folder, a table format's transaction or foreachBatch with its batch id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.windows import global_rank
from chatloom.session import staged


def first_of_each_key(commands: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds first_id and replayed: a command with a key seen before has the outcome of the first one."""
    first = F.min(order).over(Window.partitionBy(*key))
    return commands.withColumn("first_id", first).withColumn("replayed", F.col(order) != first)


def apply_sends(sends: DataFrame, grants: DataFrame, drafts: DataFrame, existing: DataFrame) -> DataFrame:
    """(send_id, channel_id, status, ordinal) of a batch of sends.

    sends: (send_id, channel_id, draft_ids); grants: channel_id; drafts: (draft_id, channel_id) that are alive
    and unbound; existing: (channel_id, ordinal). A send without a grant is `denied`; one whose drafts are not
    all in its channel, or which shares a draft with an earlier send, is `draft_conflict` as a whole. Others get the next
    ordinals of their channel in order of send_id.
    """
    rows = sends.join(grants.select("channel_id").distinct().withColumn("_granted", F.lit(True)), "channel_id", "left")
    wanted = rows.filter("_granted").select("send_id", "channel_id", F.explode("draft_ids").alias("draft_id"))
    first = F.row_number().over(Window.partitionBy("draft_id", "channel_id").orderBy("send_id"))
    bound = wanted.withColumn("_k", first).join(drafts.select("draft_id", "channel_id").distinct().withColumn("_there", F.lit(True)), ["draft_id", "channel_id"], "left")
    bad = bound.filter("_there is null or _k > 1").select("send_id").distinct().withColumn("_bad", F.lit(True))
    rows = rows.join(bad, "send_id", "left")
    status = F.when(F.col("_granted").isNull(), "denied").when(F.col("_bad"), "draft_conflict").otherwise("sent")
    rows = rows.select("send_id", "channel_id", status.alias("status"))
    last = existing.groupBy("channel_id").agg(F.max("ordinal").alias("_last"))
    k = F.row_number().over(Window.partitionBy("channel_id", "status").orderBy("send_id"))
    rows = rows.withColumn("_k", k).join(last, "channel_id", "left")
    return rows.select("send_id", "channel_id", "status", F.when(F.col("status") == "sent", F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("long").alias("ordinal"))


def committed_sends(sends: DataFrame, grants: DataFrame, drafts: DataFrame, channels: DataFrame, outcomes: DataFrame, last_feed: int) -> dict[str, DataFrame]:
    """What one transaction of a batch of sends adds: tables `outcomes`, `messages`, `bindings` and `outbox`.

    sends: (send_id, caller_id, channel_id, key, text, draft_ids); grants: (caller_id, channel_id); drafts: (draft_id, caller_id, channel_id),
    alive and unbound; channels: (channel_id, last_ordinal); outcomes: (caller_id, key, status, message_id) of earlier batches.
    A caller's key that was used before, in a batch or in this one, repeats the first outcome and adds nothing. Blank texts are `invalid`, a send
    without a grant is `denied`, one with a draft that is not the caller's in the channel or taken by an earlier send is `draft_conflict`. The sent ones get the next ordinals of
    their channel and of the feed in order of send_id, and each has one pending row in the outbox. Write all four in one release.
    """
    keyed = F.col("key").isNotNull()
    first = F.min("send_id").over(Window.partitionBy("caller_id", "key"))
    rows = sends.withColumn("first_id", F.when(keyed, first).otherwise(F.col("send_id")))
    known = outcomes.filter("key is not null").groupBy("caller_id", "key").agg(F.first("status").alias("_status"), F.first("message_id").alias("_message"))
    rows = staged(rows.join(known, ["caller_id", "key"], "left"))
    fresh = rows.filter("_status is null and send_id = first_id")
    valid = F.trim(F.coalesce("text", F.lit(""))) != ""
    allowed = staged(fresh.filter(valid).join(grants.select("caller_id", "channel_id"), ["caller_id", "channel_id"], "left_semi"))
    # A draft belongs to a caller in a channel, so both together stand for the channel of a draft.
    place = F.concat_ws("\u0000", F.col("caller_id").cast("string"), F.col("channel_id").cast("string"))
    wanted = allowed.select("send_id", place.alias("_place"), F.explode("draft_ids").alias("draft_id"))
    taken = F.row_number().over(Window.partitionBy("draft_id").orderBy("send_id"))
    bad = wanted.withColumn("_k", taken).join(drafts.select("draft_id", place.alias("_place"), F.lit(True).alias("_there")), ["draft_id", "_place"], "left").filter("_there is null or _k > 1").select("send_id").distinct()
    sent = allowed.join(bad, "send_id", "left_anti")
    numbered = global_rank(sent, ["send_id"], "_feed").join(channels.select("channel_id", "last_ordinal"), "channel_id", "left")
    k = F.row_number().over(Window.partitionBy("channel_id").orderBy("send_id"))
    ordinal, feed = F.coalesce("last_ordinal", F.lit(-1)) + k, F.lit(last_feed) + F.col("_feed") + 1
    messages = staged(numbered.withColumns({"ordinal": ordinal.cast("long"), "feed_ordinal": feed.cast("long")}).withColumn("message_id", F.concat_ws(":", F.col("channel_id").cast("string"), F.lit("live"), F.col("feed_ordinal"))))
    done = fresh.select("send_id", valid.alias("_valid")).join(allowed.select("send_id", F.lit(True).alias("_allowed")), "send_id", "left").join(messages.select("send_id", "message_id", "ordinal", "feed_ordinal"), "send_id", "left")
    status = F.when(~F.col("_valid"), "invalid").when(F.col("_allowed").isNull(), "denied").when(F.col("message_id").isNull(), "draft_conflict").otherwise("sent")
    firsts = done.select(F.col("send_id").alias("first_id"), status.alias("_now"), F.col("message_id").alias("_new"), "ordinal", "feed_ordinal")
    every = rows.join(firsts, "first_id", "left")
    return {
        "outcomes": every.select("send_id", "caller_id", "key", F.coalesce("_status", "_now").alias("status"), F.when(F.col("_status").isNotNull(), F.col("_message")).otherwise(F.col("_new")).alias("message_id"), (F.col("_status").isNotNull() | (F.col("send_id") != F.col("first_id"))).alias("replayed")),
        "messages": messages.select("message_id", "channel_id", F.col("caller_id").alias("sender_id"), "text", "ordinal", "feed_ordinal"),
        "bindings": messages.select("message_id", F.posexplode("draft_ids").alias("position", "draft_id")),
        "outbox": messages.select(F.col("feed_ordinal").alias("event_id"), "message_id", "feed_ordinal", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count")),
    }


def chunk_commit(placed: DataFrame, channel: str, order: str, event: str) -> dict[str, DataFrame]:
    """What one transaction of indexing adds: chunks it `closed`, chunks `open` after it, and `acks` of every event placed.

    placed: rows with chunk_index and n_tokens. A closed chunk, the chunk opened by the same message and that message's acknowledgement
    belong to one release, so a reader sees all three or none.
    """
    chunks = placed.groupBy(channel, "chunk_index").agg(F.min(order).alias("first_ordinal"), F.max(order).alias("last_ordinal"), F.count("*").alias("n_messages"), F.sum("n_tokens").alias("token_count"), F.max_by(event, order).alias("last_event"))
    last = F.max("chunk_index").over(Window.partitionBy(channel))
    chunks = staged(chunks.withColumn("_last", last))
    by = F.lead("first_ordinal").over(Window.partitionBy(channel).orderBy("chunk_index"))
    return {
        "closed": chunks.withColumn("closed_by", by).filter("chunk_index < _last").drop("_last"),
        "open": chunks.filter("chunk_index = _last").drop("_last"),
        "acks": placed.select(F.col(event).alias("event_id"), F.lit("processed").alias("status")),
    }


def chunk_transitions(placed: DataFrame, channel: str, order: str) -> DataFrame:
    """(channel, order, closed_chunk, opened_chunk): messages that close a chunk, open the next and are acknowledged at once."""
    before = F.lag("chunk_index").over(Window.partitionBy(channel).orderBy(order))
    return placed.withColumn("_before", before).filter(F.col("_before") < F.col("chunk_index")).select(channel, order, F.col("_before").alias("closed_chunk"), F.col("chunk_index").alias("opened_chunk"))


def raised_counter(rows: DataFrame, value: str, current: int) -> DataFrame:
    """(counter): a single counter moved up to the largest value, never down."""
    return rows.agg(F.greatest(F.max(value), F.lit(current)).cast("long").alias("counter"))


def retried(outbox: DataFrame, now: Column, seconds: int = 2, most: int = 5) -> DataFrame:
    """Failed events with one more attempt: pending again after a delay, or dead_letter at the last."""
    n = F.col("attempt_count") + 1
    over = n >= most
    return outbox.withColumns({"attempt_count": n, "status": F.when(over, "dead_letter").otherwise("pending"), "next_attempt_at": F.when(~over, F.timestamp_add("SECOND", F.lit(seconds), now))})
