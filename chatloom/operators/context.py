"""Context around anchors, routing, narrowing, search cycles and media lookup.

Every neighbourhood is an equi-join on bounded keys: an anchor is exploded to the places
that it reaches, so no join compares all rows of a channel with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns_around(messages: DataFrame, anchors: DataFrame, channel: str, order: str, width: int) -> DataFrame:
    """Messages at most `width` turns from an anchor of their channel."""
    reach = anchors.select(channel, F.explode(F.sequence(F.col(order) - width, F.col(order) + width)).alias(order)).distinct()
    return messages.join(reach, [channel, order], "left_semi")


def minutes_around(messages: DataFrame, anchors: DataFrame, channel: str, ts: str, minutes: int) -> DataFrame:
    """Messages at most so many minutes from an anchor; time is cut into slots of that width and an anchor meets three."""
    wide = minutes * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = F.floor(micros(ts) / wide)
    reach = anchors.select(F.col(channel).alias("_c"), micros(ts).alias("_t"), F.explode(F.sequence(slot - 1, slot + 1)).alias("_s"))
    rows = messages.withColumn("_slot", slot).withColumn("_micros", micros(ts))
    near = (F.col(channel) == F.col("_c")) & (F.col("_slot") == F.col("_s")) & (F.abs(F.col("_micros") - F.col("_t")) <= wide)
    return rows.join(reach, near, "left_semi").drop("_slot", "_micros")


def same_sender_around(messages: DataFrame, channel: str, sender: str, order: str, is_anchor: str, width: int) -> DataFrame:
    """Anchors and what their sender said in the channel up to `width` messages before and after."""
    w = Window.partitionBy(channel, sender).orderBy(order)
    flags = F.max(F.col(is_anchor).cast("int")).over(w.rowsBetween(-width, width))
    return messages.withColumn("_near", flags).filter("_near = 1").drop("_near")


def replies_around(messages: DataFrame, anchors: DataFrame, key: str, parent: str) -> DataFrame:
    """Anchors, the messages they answer and the messages that answer them."""
    own = anchors.select(F.col(key).alias("_k"))
    up = anchors.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("_k"))
    down = messages.join(own.distinct(), F.col(parent) == F.col("_k"), "left_semi").select(F.col(key).alias("_k"))
    return messages.join(own.union(up).union(down).distinct(), F.col(key) == F.col("_k"), "left_semi")


def route(context: Column, visual: Column) -> Column:
    """structural without either constraint, visual without context, else context."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(empty(context) & empty(visual), "structural").when(empty(context), "visual").otherwise("context")


def narrowed(low: tuple[str, str], high: tuple[str, str]) -> tuple[Column, Column]:
    """A derived range may only narrow the user's own: their intersection, an open end being null."""
    return F.greatest(*low), F.least(*high)


def fresh_searches(searches: DataFrame, run: str, order: str, keywords: str, most: int = 6) -> DataFrame:
    """Searches whose set of keywords is new in their run, numbered from 1, at most `most` cycles."""
    same = F.row_number().over(Window.partitionBy(run, "_set").orderBy(order))
    new = searches.withColumn("_set", F.sort_array(F.array_distinct(keywords))).withColumn("_k", same).filter("_k = 1").drop("_k", "_set")
    return new.withColumn("cycle", F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("long")).filter(F.col("cycle") <= most)


def resolve_media(questions: DataFrame, media: DataFrame) -> DataFrame:
    """(question_id, media_id, rule): the media that a question's image names.

    questions: (question_id, channel_id, session, image); media: (media_id, channel_id, path).
    Of the files with the name in the channel the session in the image's own path is best (1),
    then the question's session (2), then any (3); ties go to the smaller id. Media are first
    folded to a map of sessions for each name, so a common name adds no rows to the one join.
    """
    named = F.when(F.contains("image", F.lit("/")), F.substring_index("image", "/", 1))
    asked = questions.select("question_id", "channel_id", F.col("session").alias("_asked"), named.alias("_named"), F.substring_index("image", "/", -1).alias("_file"))
    place = r"([^/]+)/image/([^/]+)$"
    held = media.select("media_id", "channel_id", F.regexp_extract("path", place, 1).alias("_session"), F.regexp_extract("path", place, 2).alias("_file")).filter("_file <> ''")
    best = held.groupBy("channel_id", "_file", "_session").agg(F.min("media_id").alias("_id")).filter("_id is not null")
    best = best.groupBy("channel_id", "_file").agg(F.map_from_entries(F.collect_list(F.struct("_session", "_id"))).alias("_by"), F.min("_id").alias("_any"))
    found = asked.join(best, ["channel_id", "_file"])
    own, theirs = (F.try_element_at("_by", F.col(c)) for c in ("_named", "_asked"))
    return found.select("question_id", F.coalesce(own, theirs, "_any").alias("media_id"), F.when(own.isNotNull(), 1).when(theirs.isNotNull(), 2).otherwise(3).alias("rule"))


def sessions_with_image(questions: DataFrame, media: DataFrame, keys: list[str]) -> DataFrame:
    """Questions with has_image: their gold session (keys) holds any media."""
    held = media.select(*keys).distinct().withColumn("_held", F.lit(True))
    return questions.join(held, keys, "left").withColumn("has_image", F.coalesce("_held", F.lit(False))).drop("_held")


def media_documents(media: DataFrame, messages: DataFrame, senders: DataFrame) -> DataFrame:
    """(media_id, text): the sender's name and the words of the message that holds the media."""
    told = media.join(messages.select("message_id", "sender_id", F.col("text").alias("_text")), F.col("parent_message_id") == F.col("message_id"), "left")
    named = told.join(senders.select("sender_id", "display_name"), "sender_id", "left")
    return named.select("media_id", F.concat(F.coalesce("display_name", F.lit("Unknown")), F.lit(": "), F.coalesce("_text", F.lit(""))).alias("text"))
