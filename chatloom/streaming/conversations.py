"""Streams over append-only message files: chunking, ordered delivery, replay and latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chatloom.operators import inverted
from chatloom.operators.chunks import MOST_MESSAGES, MOST_TOKENS, count_tokens, place
from chatloom.operators.scope import scoped

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACED = "channel_id string, ordinal long, chunk_index long, n_tokens long"
CLOSED = "channel_id string, chunk_index long, first_ordinal long, last_ordinal long, n_messages long, token_count long"
SHOWN = "channel_id string, ordinal long"


def messages(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


class Chunker(StatefulProcessor):
    """One open chunk a channel. Messages of a batch are taken in ordinal order; repeats and stale ordinals are dropped."""

    def __init__(self, most_messages: int = MOST_MESSAGES, most_tokens: int = MOST_TOKENS, closed_only: bool = False):
        self.limits, self.closed_only = (most_messages, most_tokens), closed_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "chunk long, n long, tokens long, first long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        chunk, n, tokens, first, last = self.open.get() if self.open.exists() else (0, 0, 0, -1, -1)
        got = pd.concat(list(rows)).drop_duplicates("ordinal").sort_values("ordinal")
        placed, closed = [], []
        for ordinal, k in zip(got["ordinal"].tolist(), got["n_tokens"].tolist(), strict=True):
            if ordinal <= last:
                continue
            now = place((chunk, n, tokens), k, *self.limits)
            if now[0] != chunk:
                closed.append((key[0], chunk, first, last, n, tokens))
            if now[1] == 1:
                first = ordinal
            (chunk, n, tokens), last = now, ordinal
            placed.append((key[0], ordinal, chunk, k))
        self.open.update((chunk, n, tokens, first, last))
        names, values = (CLOSED, closed) if self.closed_only else (PLACED, placed)
        yield pd.DataFrame(values, columns=[c.split()[0] for c in names.split(", ")])

    def close(self) -> None:
        pass


def chunk_stream(stream: DataFrame, text: str = "text", **limits: Any) -> DataFrame:
    """Rows as they are placed, or with closed_only=True each chunk once, when it is closed."""
    rows = stream.select("channel_id", "ordinal", count_tokens(F.col(text)).cast("long").alias("n_tokens"))
    schema = CLOSED if limits.get("closed_only") else PLACED
    return rows.groupBy("channel_id").transformWithStateInPandas(Chunker(**limits), schema, "Append", "None")


class InOrder(StatefulProcessor):
    """Shows ordinals without a gap from `expected` on; later ones wait, repeats are dropped."""

    def __init__(self, expected: int = 0):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "ordinal long")
        self.waiting = handle.getMapState("waiting", "ordinal long", "one boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.expected
        for part in rows:
            for ordinal in part["ordinal"].tolist():
                if ordinal >= at:
                    self.waiting.updateValue((ordinal,), (True,))
        shown = []
        while self.waiting.containsKey((at,)):
            self.waiting.removeKey((at,))
            shown.append((key[0], at))
            at += 1
        self.next.update((at,))
        yield pd.DataFrame(shown, columns=["channel_id", "ordinal"])

    def close(self) -> None:
        pass


def ordered_stream(stream: DataFrame, expected: int = 0) -> DataFrame:
    return stream.select("channel_id", "ordinal").groupBy("channel_id").transformWithStateInPandas(InOrder(expected), SHOWN, "Append", "None")


def deliver(stream: DataFrame, grants: Callable[[], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str):
    """Scope is checked again for each batch, with the grants of that moment, before it is sent."""
    return stream.writeStream.foreachBatch(lambda batch, k: send(scoped(batch, grants()), k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_closed(closed: DataFrame, messages_: Callable[[], DataFrame], folder: str, checkpoint: str):
    """Chunks enter the kept BM25 index of their channel in the batch that closes them; open chunks are never found.

    closed: chunk_stream(..., closed_only=True); messages_: (channel_id, ordinal, text) as stored.
    """

    def take(batch: DataFrame, k: int) -> None:
        ranges = batch.select(F.col("channel_id").alias("_channel"), "chunk_index", "first_ordinal", "last_ordinal")
        inside = messages_().join(ranges, (F.col("channel_id") == F.col("_channel")) & F.col("ordinal").between(F.col("first_ordinal"), F.col("last_ordinal")))
        lines = F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text"))))
        texts = inside.groupBy("channel_id", "chunk_index").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
        inverted.add(texts, k, folder, "channel_id", "chunk_index", "text")

    return closed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visibility_latency(acks: DataFrame, commits: DataFrame) -> DataFrame:
    """(event_id, latency_ms) from the acknowledgement of a message to the commit that closed its chunk."""
    return acks.join(commits, "event_id").select("event_id", (F.timestamp_diff("MICROSECOND", F.col("acked_at"), F.col("committed_at")) / 1000.0).alias("latency_ms"))
