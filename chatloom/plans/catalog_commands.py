"""Queries of whole transactions: sends with idempotency keys and outbox rows, chunks closed and opened together."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import commands
from chatloom.plans.catalog import _CHUNKS, _placed, query, table

_SENDS = """with s as (select o_orderkey send_id, o_custkey % 5 caller_id, o_custkey channel_id, case when o_orderkey % 6 <> 0 then o_orderkey // 8 end as key, case when o_orderkey % 11 = 0 then '  ' else o_orderpriority end text, o_orderkey // 3 draft_id, o_orderkey % 7 = 0 has_draft from orders),
f as (select *, case when key is null then send_id else min(send_id) over (partition by caller_id, key) end first_id, coalesce(key % 13 = 0, false) old from s),
n as (select * from f where not old and send_id = first_id),
a as (select * from n where trim(text) <> '' and channel_id % 3 <> 0 and channel_id in (select c_custkey from customer)),
d as (select send_id, row_number() over (partition by draft_id order by send_id) > 1 or draft_id % 4 = 0 bad from a where has_draft),
m as (select a.*, row_number() over (order by a.send_id) + 999 feed, (c_nationkey * 10) + row_number() over (partition by channel_id order by a.send_id) ordinal from a join customer on c_custkey = channel_id where a.send_id not in (select send_id from d where bad)),
o as (select f.send_id, f.old, case when f.old then 'sent' when trim(g.text) = '' then 'invalid' when f.first_id not in (select send_id from a) then 'denied' when m.send_id is null then 'draft_conflict' else 'sent' end status, case when f.old then 'old:' || f.key else m.channel_id || ':live:' || m.feed end message_id, f.old or f.send_id <> f.first_id replayed
  from f join s g on g.send_id = f.first_id left join m on m.send_id = f.first_id)
"""


def _committed(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.when(k % 6 != 0, F.floor(k / 8))
    text = F.when(k % 11 == 0, "  ").otherwise(F.col("o_orderpriority"))
    lists = F.when(k % 7 == 0, F.array(F.floor(k / 3))).otherwise(F.array().cast("array<bigint>"))
    sends = table(spark, sf_dir, "orders").select(k.alias("send_id"), (c % 5).alias("caller_id"), c.alias("channel_id"), key.alias("key"), text.alias("text"), lists.alias("draft_ids"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), (F.col("c_custkey") % 5).alias("caller_id"), (F.col("c_nationkey") * 10).cast("long").alias("last_ordinal"))
    drafts = sends.filter("size(draft_ids) > 0").select(F.col("draft_ids")[0].alias("draft_id"), "caller_id", "channel_id").distinct().filter("draft_id % 4 <> 0")
    old = sends.filter("key % 13 = 0").select("caller_id", "key").distinct().select("caller_id", "key", F.lit("sent").alias("status"), F.concat(F.lit("old:"), "key").alias("message_id"))
    return commands.committed_sends(sends, customers.filter("channel_id % 3 <> 0"), drafts, customers, old, 999)


@query(_SENDS + "select send_id, status, message_id, replayed from o")
def send_outcomes(spark, sf_dir):
    """The outcome of each send; repeated keys get that of the first."""
    return _committed(spark, sf_dir)["outcomes"].select("send_id", "status", "message_id", "replayed")


@query(_SENDS + "select feed event_id, channel_id || ':live:' || feed message_id, channel_id, ordinal, 'pending' status, 0 attempt_count from m")
def send_outbox(spark, sf_dir):
    """The outbox rows of a batch with their messages."""
    found = _committed(spark, sf_dir)
    return found["outbox"].join(found["messages"].select("message_id", "channel_id", "ordinal"), "message_id").select("event_id", "message_id", "channel_id", "ordinal", "status", "attempt_count")


@query(_CHUNKS + ", n as (select *, lead(first_ordinal) over (partition by conv_id order by chunk_index) closed_by from t) select conv_id, chunk_index, first_ordinal, last_ordinal, n_messages, token_count, coalesce(closed_by, -1) closed_by, closed_by is null is_open from n")
def chunk_commits(spark, sf_dir):
    """Closed chunks with the message that closed them, and the one left open."""
    found = commands.chunk_commit(_placed(spark, sf_dir), "conv_id", "turn", "turn")
    names = ["conv_id", "chunk_index", "first_ordinal", "last_ordinal", "n_messages", "token_count", "closed_by"]
    both = found["closed"].select(*names, F.lit(False).alias("is_open")).unionByName(found["open"].withColumn("closed_by", F.lit(-1).cast("long")).select(*names, F.lit(True).alias("is_open")))
    return both
