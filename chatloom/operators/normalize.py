"""Raw sessions to canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators.windows import adjacent_inversion, global_rank

TURN_SECONDS = 90
ORDER = ["session_index", "local_date", "channel_id", "source_turn_index", "message_id"]


def _named(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds display_name: an alias of the role, else of its cleaned form, else that form."""
    direct = aliases.select(F.col("alias").alias("role"), F.col("name").alias("_direct"))
    cleaned = aliases.select(F.col("alias").alias("_candidate"), F.col("name").alias("_cleaned"))
    rows = rows.join(direct, "role", "left").withColumn("_candidate", T.display_candidate(F.col("role"))).join(cleaned, "_candidate", "left")
    name = F.when(F.col("role") != "Everyone", F.coalesce("_direct", "_cleaned", "_candidate"))
    return rows.withColumn("display_name", name).drop("_direct", "_cleaned", "_candidate")


def messages(sessions: DataFrame, dates: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a turn, ranked over the corpus. dates: (raw, day); aliases: (alias, name). An unknown date fails."""
    s = sessions.withColumn("channel_id", T.channel_id(F.col("path"))).withColumn("session_index", T.session_number(F.col("path")))
    s = s.join(dates, s["timeline_date"] == dates["raw"], "left").drop("raw")
    s = s.withColumn("local_date", F.coalesce("day", F.raise_error(F.lit("timeline date has no mapping")).cast("string")))
    flags = adjacent_inversion(s.select("channel_id", "session_index", "local_date"), "channel_id", "session_index", "local_date").select("channel_id", "session_index", "temporal_order_conflict")
    turns = s.select("path", "channel_id", "session_index", "session_id", "local_date", F.posexplode("dialogue").alias("source_turn_index", "turn"))
    turns = _named(turns.withColumn("role", F.col("turn.role")), aliases).join(flags, ["channel_id", "session_index"], "left")
    at = F.timestamp_add("SECOND", F.col("source_turn_index") * TURN_SECONDS, F.to_timestamp_ntz(F.concat("local_date", F.lit(" 09:00:00"))))
    rows = turns.select(
        F.concat_ws(":", "channel_id", F.concat(F.lit("session"), "session_index"), "source_turn_index").alias("message_id"),
        "channel_id", F.when(F.col("display_name").isNotNull(), T.sender_slug(F.col("display_name"))).alias("sender_id"), "display_name",
        F.coalesce("turn.content.text", F.lit("")).alias("text"), F.col("turn.content.image").alias("image"), "local_date",
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+07:00")).alias("timestamp"), "source_turn_index", "session_index",
        F.col("session_id").alias("source_session_id"), "temporal_order_conflict", F.lit(None).cast("string").alias("reply_to_message_id"), F.lit(None).cast("string").alias("thread_id"), "path",
    )
    return global_rank(rows, ORDER)


def media(messages_: DataFrame, images: DataFrame) -> DataFrame:
    """Attached images; one that is missing from the inventory (path, content_sha256) fails."""
    wanted = messages_.filter("image is not null").withColumn("image_path", F.concat(F.regexp_replace("path", "[^/]+$", ""), "image"))
    found = wanted.join(images.withColumnRenamed("path", "image_path"), "image_path", "left")
    sha = F.coalesce("content_sha256", F.raise_error(F.concat(F.lit("missing image "), "image_path")).cast("string"))
    name = F.element_at(F.split("image", "/"), -1)
    return found.select(F.concat_ws(":", "message_id", name).alias("media_id"), F.col("message_id").alias("parent_message_id"), "channel_id", F.col("image_path").alias("raw_relative_path"), sha.alias("content_sha256"), F.concat(F.lit("sha256/"), sha).alias("storage_object_ref"))


def orphans(images: DataFrame, media_: DataFrame) -> DataFrame:
    return images.join(media_.select(F.col("raw_relative_path").alias("path")), "path", "left_anti").withColumn("excluded_from_runtime_retrieval", F.lit(True))


def mentions(messages_: DataFrame, names: DataFrame) -> DataFrame:
    """(message_id, start, end, sender_id, confidence): the longest known name that begins an @mention.

    names: (name, sender_id, confidence). The prefix join is an equi-join: a mention is
    split into its prefixes of the lengths that names have.
    """
    key = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    known = names.select(key(F.col("name")).alias("key"), F.col("name"), "sender_id", "confidence").filter("key <> ''")
    lengths = known.select(F.length("key").alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("lengths"))  # as many as a name has letters
    pieces = F.split("text", "@")
    raw = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, r"^([^,!.?;:\n]+)", 1).alias("raw")))
    found = messages_.filter(F.contains("text", F.lit("@"))).select("message_id", pieces.alias("pieces"), F.explode(raw).alias("m")).filter("m.raw <> ''")
    start = F.length(F.array_join(F.slice("pieces", 1, F.col("m.i") + 1), "@"))
    found = found.select("message_id", start.alias("start"), (start + 1 + F.length("m.raw")).alias("end"), key(F.trim("m.raw")).alias("target"))
    found = found.crossJoin(F.broadcast(lengths)).withColumn("key", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("target")), lambda n: F.substr("target", F.lit(1), n))))
    w = Window.partitionBy("message_id", "start")
    best = found.join(known, "key").withColumn("_k", F.row_number().over(w.orderBy(F.desc(F.length("name")), "name"))).withColumn("_n", F.count("*").over(w)).filter("_k = 1")
    return best.select("message_id", "start", "end", "sender_id", F.when(F.col("_n") > 1, F.round(F.col("confidence") / F.col("_n"), 2)).otherwise(F.col("confidence")).alias("confidence"))


def summary(messages_: DataFrame, media_: DataFrame, images: DataFrame) -> dict[str, int]:
    m = messages_.agg(F.count("*").alias("messages"), F.count_distinct("channel_id").alias("channels"), F.count_distinct("sender_id").alias("senders"), F.count_distinct("channel_id", "session_index").alias("sessions"), F.count_if("temporal_order_conflict").alias("flagged"), F.count_if(F.col("text").rlike(T.CJK)).alias("cjk")).first()
    return m.asDict() | {"media": media_.count(), "images": images.count()}


def mention_targets(mentions_: DataFrame, messages_: DataFrame) -> DataFrame:
    """(message_id, sender_id, target_message_id): every message, of any channel, by the sender that a mention names."""
    said = messages_.filter("sender_id is not null").select("sender_id", F.col("message_id").alias("target_message_id"))
    return mentions_.join(said, "sender_id").select("message_id", "sender_id", "target_message_id")


def by_folded_name(senders: DataFrame, name: str, key: str) -> DataFrame:
    """Adds the 0-based place in the order of names whatever their case, then of names, then of keys."""
    return global_rank(senders.withColumn("_folded", F.lower(name)), ["_folded", name, key], "place").drop("_folded")
