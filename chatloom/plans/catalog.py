"""The registered queries of the engine and their DuckDB counterparts.

Each runs an operator on the test table nearest to its input: conversations for messages,
events for the feed and outbox, embeddings for media vectors, documents and benchmark for
chunks and gold questions, labels for gold strata, customers by nation for membership.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import chunks, context, evaluate, feed, gates, inverted, lexical, normalize, scope, similarity, windows
from chatloom.operators.graph import connected_components
from chatloom.streaming import conversations

_FOUND: dict[str, tuple[Callable, str | None]] = {}
#: Thresholds that give rows on these tables, in place of the production ones.
COSINE, HAMMING, TOP_K = 0.40, 18, 10
MESSAGES, TOKENS = 4, 60
PATTERNS = (r"\d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
NOW = "1995-01-01"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- chunking --------------------------------------------------------------------------------------

_CHUNKS = f"""
with recursive m as (select conv_id, turn, row_number() over (partition by conv_id order by turn) r,
    len(regexp_extract_all(coalesce(text, ''), '\\S+'))::bigint k from conversations),
c(conv_id, r, turn, chunk_index, n, k) as (
  select conv_id, r, turn, 0::bigint, 1::bigint, k from m where r = 1
  union all
  select m.conv_id, m.r, m.turn, case when c.n + 1 > {MESSAGES} or c.k + m.k > {TOKENS} then c.chunk_index + 1 else c.chunk_index end,
    case when c.n + 1 > {MESSAGES} or c.k + m.k > {TOKENS} then 1 else c.n + 1 end, case when c.n + 1 > {MESSAGES} or c.k + m.k > {TOKENS} then m.k else c.k + m.k end
  from c join m on m.conv_id = c.conv_id and m.r = c.r + 1),
p as (select m.conv_id, m.turn, m.k n_tokens, c.chunk_index from m join c using (conv_id, r)),
t as (select conv_id, chunk_index, min(turn) first_ordinal, max(turn) last_ordinal, count(*)::bigint n_messages, sum(n_tokens)::bigint token_count from p group by all)
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.greedy_chunks(table(spark, sf_dir, "conversations").filter("turn is not null"), "conv_id", "turn", "text", MESSAGES, TOKENS)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_table(_placed(spark, sf_dir), "conv_id", "turn", "role", "text")


@query(_CHUNKS + "select conv_id, turn, n_tokens, chunk_index from p")
def chunks_greedy(spark, sf_dir):
    return _placed(spark, sf_dir).select("conv_id", "turn", "n_tokens", "chunk_index")


@query(_CHUNKS + "select * from t where chunk_index < (select max(chunk_index) from t o where o.conv_id = t.conv_id)")
def chunks_closed_only(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("status = 'closed'").select("conv_id", "chunk_index", "first_ordinal", "last_ordinal", "n_messages", "token_count")


@query(_CHUNKS + ", q as (select conv_id, turn, chunk_index, coalesce(role, 'unknown') || ': ' || coalesce(text, '') l from p join conversations using (conv_id, turn)) select conv_id, chunk_index, '[conversation:' || conv_id || ']' || chr(10) || string_agg(l, chr(10) order by turn) as text from q group by conv_id, chunk_index")
def chunk_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("conv_id", "chunk_index", "text")


# --- scope and feed ----------------------------------------------------------------------------------
# Users are channels; caller 1 holds grants on every third, which end in 2000 or never, and expired ones on others.

_GRANTS = """
with ch as (select distinct user_id channel_id from events),
gr as (select channel_id, case when channel_id % 4 = 0 then timestamp '1990-01-01' when channel_id % 2 = 0 then null else timestamp '2000-01-01' end valid_to from ch where channel_id % 3 = 0 or channel_id % 4 = 0),
ok as (select channel_id from gr where valid_to is null or valid_to > timestamp '1995-01-01'),
f as (select event_id feed_ordinal, 'e' || event_id message_id, user_id channel_id, event_type from events)
"""


def _grants(spark, sf_dir) -> DataFrame:
    ch = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel_id")).distinct()
    end = F.when(F.col("channel_id") % 4 == 0, F.to_timestamp_ntz(F.lit("1990-01-01 00:00:00"))).when(F.col("channel_id") % 2 != 0, F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")))
    return ch.filter("channel_id % 3 = 0 or channel_id % 4 = 0").select(F.lit(1).alias("caller_id"), "channel_id", F.lit(None).cast("timestamp_ntz").alias("valid_from"), end.alias("valid_to"))


def _visible(spark, sf_dir) -> DataFrame:
    return scope.grants_of(_grants(spark, sf_dir), 1, F.to_timestamp_ntz(F.lit(f"{NOW} 00:00:00")))


def _feed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("feed_ordinal"), F.concat(F.lit("e"), "event_id").alias("message_id"), F.col("user_id").alias("channel_id"), "event_type")


@query(_GRANTS + "select f.* from f where exists (select 1 from ok where ok.channel_id = f.channel_id) and feed_ordinal > 100 order by feed_ordinal, message_id limit 100")
def feed_forward(spark, sf_dir):
    return feed.forward_page(scope.scoped(_feed(spark, sf_dir), _visible(spark, sf_dir)), 0, after=100).select("feed_ordinal", "message_id", "channel_id", "event_type")


@query(_GRANTS + "select * from (select f.* from f where channel_id in (select channel_id from ok) and feed_ordinal < 900 order by feed_ordinal desc, message_id desc limit 50) order by feed_ordinal")
def feed_backward(spark, sf_dir):
    return feed.backward_page(scope.scoped(_feed(spark, sf_dir), _visible(spark, sf_dir)), 50, 900).select("feed_ordinal", "message_id", "channel_id", "event_type")


@query(_GRANTS + "select f.*, coalesce(c_name, 'Unknown') display_name from f left join customer on c_custkey = channel_id where channel_id in (select channel_id from ok) and feed_ordinal > 500")
def events_after(spark, sf_dir):
    rows = scope.scoped(_feed(spark, sf_dir), _visible(spark, sf_dir)).filter(feed.cursor(500)).withColumn("sender_id", F.col("channel_id"))
    named = feed.with_senders(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sender_id"), F.col("c_name").alias("display_name")))
    return named.select("feed_ordinal", "message_id", "channel_id", "event_type", "display_name")


@query(_GRANTS + "select channel_id from ch where not exists (select 1 from ok where ok.channel_id = ch.channel_id)")
def scope_missing_channels(spark, sf_dir):
    return scope.hidden_channels(_feed(spark, sf_dir).select("channel_id").distinct(), _visible(spark, sf_dir))


@query("select event_id feed_ordinal, user_id channel_id from events e where not exists (select 1 from events c where c.user_id = e.user_id and c.event_id % 7 = 0 and c.event_id >= e.event_id)")
def resume_point(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("feed_ordinal"), F.col("user_id").alias("channel_id"))
    return feed.resume_point(e, e.filter("feed_ordinal % 7 = 0").withColumnRenamed("feed_ordinal", "last_feed_ordinal")).select("feed_ordinal", "channel_id")


@query("select o_orderkey, coalesce(string_agg(l_linenumber::varchar, ',' order by l_linenumber), '') media_ids from orders left join (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey group by 1")
def attachments_agg(spark, sf_dir):
    media = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct()
    return feed.with_attachments(table(spark, sf_dir, "orders").select("o_orderkey"), media, "o_orderkey", "l_linenumber").select("o_orderkey", F.array_join("media_ids", ",").alias("media_ids"))


@query("""with g as (select event_id grant_id, user_id % 20 caller_id, user_id channel_id, ts valid_from, case when event_id % 5 = 0 then ts end valid_to from events)
select grant_id, caller_id, channel_id from g qualify valid_to is not null or row_number() over (partition by caller_id, channel_id, valid_to is null order by valid_from, grant_id) = 1""")
def dedupe_open_grants(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.select(F.col("event_id").alias("grant_id"), (F.col("user_id") % 20).alias("caller_id"), F.col("user_id").alias("channel_id"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("valid_to"))
    return scope.dedupe_open_grants(g).select("grant_id", "caller_id", "channel_id")


@query("""with v as (select distinct n_regionkey caller_id from nation), o as (select distinct c_nationkey channel_id from customer)
select v.caller_id, o.channel_id from v, o where not exists (select 1 from nation n where n.n_regionkey = v.caller_id and n.n_nationkey = o.channel_id)""")
def missing_owner_grants(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("caller_id"), F.col("n_nationkey").alias("channel_id"))
    return scope.missing_owner_grants(nation, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("channel_id")).distinct(), nation).select("caller_id", "channel_id")


@query("""select user_id channel_id, event_id, coalesce(m, -1) + row_number() over (partition by user_id order by event_id) as ordinal
from (select * from events where event_id % 2 = 1) e left join (select user_id u, max(event_id) m from events where event_id % 2 = 0 group by 1) on u = user_id""")
def allocate_ordinals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel_id"), "event_id")
    return feed.allocate_ordinals(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0").withColumn("ordinal", F.col("event_id")), ["event_id"])


@query("""with a as (select user_id event_id, row_number() over (partition by user_id order by event_id)::bigint attempt, event_type = 'purchase' ok from events),
f as (select event_id, min(attempt) filter (ok) o, count(*) n from a group by 1)
select event_id, case when o <= 5 then 'done' when n >= 5 then 'dead_letter' else 'pending' end status, least(coalesce(o, n), 5)::bigint attempt_count from f""")
def outbox_status(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return feed.outbox_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.row_number().over(w).cast("long").alias("attempt"), (F.col("event_type") == "purchase").alias("ok")))


@query("select c_custkey, c_name, c_acctbal, 'new' as state from customer where c_custkey % 3 = 0 union all select c_custkey, c_name, c_acctbal, 'old' from customer where c_custkey % 3 <> 0 and c_custkey % 2 = 0")
def upsert_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return feed.upsert(c.filter("c_custkey % 2 = 0").withColumn("state", F.lit("old")), c.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), "c_custkey")


@query("select c_custkey, c_name, 'old' as state from customer where c_custkey % 2 = 0 union all select c_custkey, c_name, 'new' from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def insert_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return feed.insert_ignore(c.filter("c_custkey % 2 = 0").withColumn("state", F.lit("old")), c.filter("c_custkey % 3 = 0").withColumn("state", F.lit("new")), "c_custkey")


# --- order, segments, samples ---------------------------------------------------------------------


@query("select conv_id, turn, row_number() over (order by turn, conv_id) - 1 as chronological_rank from conversations")
def chronological_rank(spark, sf_dir):
    return windows.global_rank(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["turn", "conv_id"])


@query("""select o_orderkey, coalesce(lag(d) over w > d, false) or coalesce(lead(d) over w < d, false) as temporal_order_conflict
from (select *, o_orderdate::date d from orders) window w as (partition by o_custkey order by o_orderkey)""")
def adjacent_inversion(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return windows.adjacent_inversion(rows, "o_custkey", "o_orderkey", "day").select("o_orderkey", "temporal_order_conflict")


def _gap_sql(minutes: int) -> str:
    return f"""with g as (select user_id, event_id, ts, case when date_diff('microsecond', lag(ts) over w, ts) > {minutes} * 60000000::bigint then 1 else 0 end cut from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(cut) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as segment from g)
select user_id, segment, count(*)::bigint n, date_diff('microsecond', min(ts), max(ts))::bigint span_us from s group by all"""


def _segments(spark, sf_dir, minutes: int) -> DataFrame:
    rows = windows.gap_segments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", minutes)
    return rows.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("span_us"))


@query(_gap_sql(5))
def gap_segments_5(spark, sf_dir):
    return _segments(spark, sf_dir, 5)


@query(_gap_sql(60))
def gap_segments_60(spark, sf_dir):
    return _segments(spark, sf_dir, 60)


@query(_gap_sql(600))
def gap_segments_600(spark, sf_dir):
    return _segments(spark, sf_dir, 600)


@query("""with g as (select date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) / 60000000.0 gap from events)
select case when gap <= 5 then '<=5' when gap <= 60 then '5-60' else '>60' end bucket, count(*)::bigint n from g where gap is not null group by 1""")
def gap_buckets(spark, sf_dir):
    return windows.gap_buckets(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("""with d as (select distinct conv_id, turn from conversations where turn % 4 <> 3), k as (select *, turn - row_number() over (partition by conv_id order by turn) g from d),
r as (select conv_id, min(turn) first_ordinal, max(turn) last_ordinal, count(*)::bigint n from k group by conv_id, g)
select *, row_number() over (partition by conv_id order by first_ordinal) - 1 as island from r""")
def ordinal_islands(spark, sf_dir):
    return windows.islands(table(spark, sf_dir, "conversations").filter("turn % 4 <> 3"), "conv_id", "turn")


@query("""select conv_id, turn from conversations c where turn % 4 <> 3 and turn >= 0 and not exists (select 1 from range(0, 1000) r(x) where x < c.turn and (x % 4 = 3 or not exists (select 1 from conversations o where o.conv_id = c.conv_id and o.turn = x)))""")
def ordered_prefix(spark, sf_dir):
    return windows.contiguous_prefix(table(spark, sf_dir, "conversations").filter("turn % 4 <> 3").select("conv_id", "turn"), "conv_id", "turn", 0)


@query("""with b as (select *, event_type = 'view' img from events), s as (select *, case when img and not coalesce(lag(img) over w and lag(event_type) over w = event_type, false) then 1 else 0 end st from b window w as (partition by user_id order by event_id))
select user_id, event_id, sum(st) over (partition by user_id order by event_id rows unbounded preceding)::bigint as burst from s qualify img""")
def image_bursts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("img", F.col("event_type") == "view")
    return windows.bursts(rows, "user_id", "event_id", "event_type", "img").filter("img").select("user_id", "event_id", F.col("burst").cast("long").alias("burst"))


@query("select doc_id, quality, toxic from labels qualify (row_number() over (order by doc_id, quality, toxic) - 1) % 20 = 0")
def control_sample(spark, sf_dir):
    return windows.systematic_sample(table(spark, sf_dir, "labels"), ["doc_id", "quality", "toxic"])


@query("select doc_id, 'q_' || quality || '_' || lpad(k::varchar, greatest(4, length(k::varchar))::int, '0') query_id from (select *, row_number() over (partition by quality order by doc_id) k from labels)")
def stratum_sequence(spark, sf_dir):
    rows = windows.sequence_id(table(spark, sf_dir, "labels"), "quality", ["doc_id"])
    return rows.select("doc_id", "query_id")


@query("select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents qualify rank <= 3")
def top_n_per_group(spark, sf_dir):
    return windows.top_per_group(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 3)


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 79")
def top_overall(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(79).select("doc_id", "n_chars")


@query("select doc_id, quality from labels qualify row_number() over (partition by quality order by doc_id) <= case quality when 1 then 40 when 0 then 15 else 0 end")
def quota_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("stratum", F.col("quality").cast("string"))
    return windows.quota_take(rows, ["doc_id"], {"1": 40, "0": 15}).select("doc_id", "quality")


# --- lexical ---------------------------------------------------------------------------------------

_BM25 = """
with dt as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from documents),
dl as (select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) dl, source from documents),
w as (select count(*) n, avg(dl) a from dl),
q as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark),
tf as (select doc_id, term, count(*) tf from dt where term in (select term from q) group by all),
df as (select term, count(*) df from tf group by 1),
s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 6) score
  from q join tf using (term) join df using (term) join dl using (doc_id), w group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
"""


def _ranked(spark, sf_dir, k: int) -> DataFrame:
    found = inverted.best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k)
    return found.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", "rank")


@query(_BM25 + f"select item_id, doc_id, score, rank from r where rank <= {TOP_K}")
def bm25_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, TOP_K)


@query("""with d as (select regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') t from documents)
select count(*)::bigint n_docs, avg(len(t)) avg_len, sum(len(list_distinct(t)))::bigint n_postings, (select count(distinct x) from (select unnest(t) x from d))::bigint n_terms from d""")
def bm25_stats(spark, sf_dir):
    return lexical.bm25_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


_GOLD = ", gold as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"


def _judged(spark, sf_dir, k: int) -> DataFrame:
    """Ranked pairs with `gold`: the document contains the item. Only ranked pairs are looked at."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    pairs = _ranked(spark, sf_dir, k).join(items, "item_id").join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return pairs.select("item_id", "doc_id", "rank", "source", F.coalesce(F.contains("text", "item"), F.lit(False)).alias("gold"))


@query(_BM25 + _GOLD + "select item_id, doc_id from r join gold using (item_id, doc_id) where rank = 1")
def anti_leak_top1(spark, sf_dir):
    return _judged(spark, sf_dir, 1).filter("gold").select("item_id", "doc_id")


@query(_BM25 + _GOLD + """, t as (select b.item_id, b.item_id % 4 stratum, bool_or(gold.doc_id is not null) hit from benchmark b left join r on r.item_id = b.item_id and rank = 1 left join gold on gold.item_id = b.item_id and gold.doc_id = r.doc_id group by all)
select stratum, count(*)::bigint n, count(*) filter (hit)::bigint hits, round(avg(hit::int), 6) hit_rate from t group by 1""")
def leak_rates(spark, sf_dir):
    top = _judged(spark, sf_dir, 1)
    evidence = top.groupBy("item_id").agg(F.collect_list(F.when(F.col("gold"), F.col("doc_id"))).alias("evidence"))
    gold = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("stratum")).join(evidence, "item_id", "left")
    return evaluate.hit_rates(top, gold, "item_id", "doc_id", "stratum")


@query(_BM25 + _GOLD + """, x as (select r.item_id, source, min(rank) fr, max(case when gold.doc_id is not null then 1 else 0 end) g from r join documents using (doc_id) left join gold using (item_id, doc_id) where rank <= 30 group by all),
y as (select *, row_number() over (partition by item_id order by fr, source) k from x) select item_id, max(case when g = 1 and k <= 5 then 1 else 0 end)::bigint hit from y group by 1""")
def distinct_at_k(spark, sf_dir):
    return lexical.distinct_at_k(_judged(spark, sf_dir, 30), "item_id", "source", "gold", 5)


@query(_BM25 + _GOLD + "select item_id, max(case when gold.doc_id is not null then 1 else 0 end)::bigint hit from r left join gold using (item_id, doc_id) where rank <= 5 group by 1")
def raw_at_k(spark, sf_dir):
    return lexical.raw_at_k(_judged(spark, sf_dir, 5), "item_id", F.col("gold"), 5)


@query("""with a as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) a, list_distinct(regexp_extract_all(lower(text[1:60]), '[a-z0-9]+')) q from benchmark),
d as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) t from documents),
p as (select item_id, doc_id, len(list_intersect(a, t)) ia, len(list_intersect(q, t)) iq, len(a) n from a, d)
select item_id, doc_id, round(ia / n, 6) coverage, (6 * ia + 2 * iq)::bigint score from p where round(ia / n, 6) >= 0.75""")
def token_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"), F.substring("text", 1, 60).alias("question"))
    return lexical.token_overlap(b, table(spark, sf_dir, "documents"), "item_id", "answer", "question", "doc_id", "text")


_LISTS = _BM25 + """, l as (select 'original' list, item_id, doc_id, rank from r where rank <= 20 union all
select 'keyword', item_id, doc_id, row_number() over (partition by item_id order by doc_id) from r where rank <= 20 and doc_id % 2 = 0 union all
select 'rewrite', item_id, doc_id, row_number() over (partition by item_id order by doc_id desc) from r where rank <= 20 and doc_id % 3 = 0),
f as (select item_id, doc_id, round(sum(case list when 'rewrite' then 1.3::double when 'keyword' then 1.0 else 0.5 end / (60 + rank)), 9) score from l group by all),
fused as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from f)
"""


def _fused(spark, sf_dir) -> DataFrame:
    best = _ranked(spark, sf_dir, 20).select("item_id", "doc_id", "rank")
    again = lambda name, keep, by: best.filter(keep).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(by)).cast("long")).withColumn("list", F.lit(name))
    lists = best.withColumn("list", F.lit("original")).unionByName(again("keyword", "doc_id % 2 = 0", F.col("doc_id"))).unionByName(again("rewrite", "doc_id % 3 = 0", F.desc("doc_id")))
    return lexical.rrf(lists, "item_id", "doc_id")


@query(_LISTS + "select * from fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


@query(_LISTS + "select item_id, doc_id, round(case when mx > mn then (score - mn) / (mx - mn) else 0 end, 6) norm from (select *, max(score) over (partition by item_id) mx, min(score) over (partition by item_id) mn from f)")
def minmax_scores(spark, sf_dir):
    w = Window.partitionBy("item_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return _fused(spark, sf_dir).select("item_id", "doc_id", F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(0.0), 6).alias("norm"))


# --- sections ---------------------------------------------------------------------------------------
# Hits are chunks whose index is not 2 modulo 3; their rank is by tokens.

_HITS = _CHUNKS + """, h as (select conv_id, chunk_index, row_number() over (partition by conv_id order by token_count desc, chunk_index) as rank from t where chunk_index % 3 <> 2),
hk as (select *, chunk_index - row_number() over (partition by conv_id order by chunk_index) g from h),
hb as (select *, row_number() over (partition by conv_id, g order by rank, chunk_index) k from hk),
sec as (select conv_id, min(chunk_index) first_index, max(chunk_index) last_index, count(*)::bigint n_hits, arg_min(chunk_index, rank) center_index, min(rank) section_rank from hb where k <= 3 group by conv_id, g)
"""


def _sections(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("token_count"), "chunk_index")
    hits = _chunks(spark, sf_dir).filter("chunk_index % 3 <> 2").select("conv_id", "chunk_index", F.row_number().over(w).cast("long").alias("rank"))
    return chunks.sections(hits, "conv_id", "chunk_index", "rank")


@query(_HITS + "select * from sec")
def section_merge(spark, sf_dir):
    return _sections(spark, sf_dir)


@query(_HITS + """, lv as (select *, (first_index + conv_id) % 4 lv from sec)
select distinct t.conv_id, t.chunk_index from t join lv on t.conv_id = lv.conv_id where lv > 0 and t.chunk_index between case lv when 1 then first_index when 2 then center_index - 2 else center_index - 5 end and case lv when 1 then last_index when 2 then center_index + 2 else center_index + 5 end""")
def expand_window(spark, sf_dir):
    chosen = _sections(spark, sf_dir).withColumn("level", (F.col("first_index") + F.col("conv_id")) % 4)
    return chunks.expanded(chosen, _chunks(spark, sf_dir).select("conv_id", "chunk_index"), "conv_id", "chunk_index")


@query(_HITS + """, rg as (select conv_id, center_index - 2 lo, center_index + 2 hi from sec),
cu as (select *, case when hi0 is null or lo > hi0 + 1 then 1 else 0 end cut from (select *, max(hi) over (partition by conv_id order by lo, hi rows between unbounded preceding and 1 preceding) hi0 from rg)),
k as (select *, sum(cut) over (partition by conv_id order by lo, hi rows unbounded preceding) g from cu) select conv_id, min(lo) lo, max(hi) hi from k group by conv_id, g""")
def merge_ranges(spark, sf_dir):
    ranges = _sections(spark, sf_dir).select("conv_id", (F.col("center_index") - 2).alias("lo"), (F.col("center_index") + 2).alias("hi"))
    return chunks.merged_ranges(ranges, "conv_id", "lo", "hi")


@query(_CHUNKS + ", o as (select conv_id, chunk_index, token_count from t order by token_count desc, conv_id, chunk_index limit 30), s as (select *, sum(token_count) over (order by token_count desc, conv_id, chunk_index rows unbounded preceding)::bigint running_tokens from o) select * from s where running_tokens <= 900")
def section_cap(spark, sf_dir):
    return chunks.capped(_chunks(spark, sf_dir).select("conv_id", "chunk_index", "token_count"), [F.desc("token_count"), "conv_id", "chunk_index"], "token_count", 30, 900)


# --- vectors ----------------------------------------------------------------------------------------

_EDGES = f"with v as (select vec_id, embedding::double[] e from embeddings), ed as (select a.vec_id left_id, b.vec_id right_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) cosine from v a join v b on a.vec_id < b.vec_id), edges as (select * from ed where cosine >= {COSINE})"
_BITS = "with b as (select vec_id, label, list_sum(list_transform(range(0, 64), lambda i: case when embedding[i + 1] > 0 then 1::hugeint << i else 0::hugeint end))::hugeint bits from embeddings)"


def _edges(spark, sf_dir) -> DataFrame:
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE)


def _links(spark, sf_dir) -> DataFrame:
    """What joins the same vectors as _edges() does."""
    return similarity.near_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", COSINE)


@query(_EDGES + " select left_id, right_id, round(cosine, 6) cosine from edges")
def near_dup_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))


@query(_BITS + f" select a.vec_id left_id, b.vec_id right_id, bit_count(xor(a.bits, b.bits))::bigint distance from b a join b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= {HAMMING}")
def hamming_pairs(spark, sf_dir):
    return similarity.hamming_pairs(table(spark, sf_dir, "embeddings").select("vec_id", similarity.sign_bits("embedding").alias("bits")), "vec_id", "bits", HAMMING)


_REACH = _EDGES.replace("with v", "with recursive v") + ", s as (select left_id a, right_id b from edges union all select right_id, left_id from edges), r(a, b) as (select distinct a, a from s union select r.a, s.b from r join s on s.a = r.b), comp as (select a node, min(b) component from r group by 1)"


@query(_REACH + " select * from comp")
def near_dup_components(spark, sf_dir):
    return connected_components(_links(spark, sf_dir), "left_id", "right_id")


@query(_REACH + ", sz as (select component, count(*) size from comp group by 1) select size::bigint size, count(*)::bigint n from sz group by 1")
def component_sizes(spark, sf_dir):
    return connected_components(_links(spark, sf_dir), "left_id", "right_id").groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(_EDGES + ", p as (select *, case when a.label <> b.label then 'cross_channel' when a.vec_id // 20 = b.vec_id // 20 then 'intra_session' else 'cross_session' end pool from ed join embeddings a on a.vec_id = left_id join embeddings b on b.vec_id = right_id) select pool, count(*)::bigint pairs, count(*) filter (cosine >= 0.2)::bigint ge_20, count(*) filter (cosine >= 0.3)::bigint ge_30, count(*) filter (cosine >= 0.4)::bigint ge_40 from p group by 1")
def similarity_pools(spark, sf_dir):
    def pool(a, b):
        return np.where(a["label"] != b["label"], 0, np.where(a["vec_id"] // 20 == b["vec_id"] // 20, 1, 2))

    found = similarity.pool_counts(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", pool, ("cross_channel", "intra_session", "cross_session"), (0.2, 0.3, 0.4), ("vec_id", "label"))
    return found.filter("pairs > 0").select("pool", "pairs", *(F.col("at_or_above")[k].alias(f"ge_{t}") for k, t in enumerate((20, 30, 40))))


@query(_EDGES + " select b.range as bin, coalesce(n, 0)::bigint n from range(0, 20) b left join (select least(floor((cosine + 1) * 10), 19)::bigint bin, count(*) n from ed group by 1) h on h.bin = b.range")
def similarity_histogram(spark, sf_dir):
    return similarity.cosine_histogram(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("with v as (select vec_id, embedding::double[] e from embeddings), s as (select q.vec_id query_id, v.vec_id id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return similarity.vector_top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", TOP_K)


@query("with v as (select vec_id, label, embedding::double[] e from embeddings), s as (select q.vec_id query_id, v.vec_id id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0 and v.label < 3) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10")
def media_in_context(spark, sf_dir):
    """Media are ranked only inside the sections that survived (labels 0 to 2)."""
    e = table(spark, sf_dir, "embeddings")
    inside = e.join(e.filter("label < 3").select("label").distinct(), "label", "left_semi")
    return similarity.vector_top_k(inside, e.filter("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", TOP_K)


@query("with e as (select vec_id, embedding::double[] e, label from embeddings), p as (select label, i, avg(e[i]) m from e, range(1, 65) r(i) group by all) select label, round(sqrt(sum(m * m)), 6) norm from p group by 1")
def mean_pool_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


# --- gates, metrics, text -----------------------------------------------------------------------------


@query("select doc_id, concat_ws(',', case when regexp_matches(text, '\\d') then '0' end, case when regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') then '1' end) patterns from documents where regexp_matches(text, '\\d') or regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')")
def vocabulary_gate(spark, sf_dir):
    return gates.vocabulary_gate(table(spark, sf_dir, "documents"), "doc_id", ["text"], PATTERNS).select("doc_id", F.array_join(F.transform("patterns", lambda x: x.cast("string")), ",").alias("patterns"))


@query("""with g as (select doc_id, case doc_id % 4 when 0 then 'return_result' when 1 then 'clarify' when 2 then 'no_result' else 'return_result' end a, toxic = 1 media, quality = 1 answer from labels)
select 'q' || doc_id query_id, case when a = 'return_result' and media and answer then 'media_answer' when a = 'return_result' and not media and not answer then 'text_answer' when a = 'clarify' then 'clarify' else 'no_result' end violation
from g where (a = 'return_result' and ((media and answer) or (not media and not answer))) or (a = 'clarify' and (media or answer)) or (a = 'no_result' and (media or answer))""")
def gold_contract(spark, sf_dir):
    media, none = F.array(F.lit("m")), F.array().cast("array<string>")
    action = F.when(F.col("doc_id") % 4 == 1, "clarify").when(F.col("doc_id") % 4 == 2, "no_result").otherwise("return_result")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), "doc_id").alias("query_id"), action.alias("expected_action"), F.when(F.col("toxic") == 1, media).otherwise(none).alias("gold_media_ids"), F.when(F.col("quality") == 1, "yes").otherwise("").alias("gold_answer"), (F.col("toxic") == 1).alias("answer_is_media"), media.alias("acceptable_clarification_targets"))
    return gates.gold_contract(rows)


@query("with a as (select o_custkey k, count(*) n from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey k, count(*) n from orders where o_orderkey % 3 = 0 group by 1) select coalesce(a.k, b.k) o_custkey, coalesce(a.n, 0)::bigint n_left, coalesce(b.n, 0)::bigint n_right from a full join b on a.k = b.k where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def multiset_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return gates.multiset_difference(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), "o_custkey")


@query("select sha256(text) content_sha256, count(*)::bigint n, min(doc_id) first_id from documents where text is not null group by 1 having count(*) > 1")
def duplicate_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("select quality, count(*) filter (toxic = 0)::bigint dev, count(*) filter (toxic = 1)::bigint test from labels group by 1")
def strata_split_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("split", F.when(F.col("toxic") == 0, "dev").otherwise("test"))
    return rows.groupBy("quality").pivot("split", ["dev", "test"]).agg(F.count(F.lit(1))).select("quality", F.coalesce("dev", F.lit(0)).alias("dev"), F.coalesce("test", F.lit(0)).alias("test"))


@query("select event_type, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.95) p95, median(value) med, list_sort(list(value))[floor(greatest(0.95 * count(*) - 1, 0))::bigint + 1] p95_trunc from events group by 1")
def percentiles(spark, sf_dir):
    p, events = evaluate.percentile_nearest, table(spark, sf_dir, "events")
    near = events.groupBy("event_type").agg(p("value", 0.5).alias("p50"), p("value", 0.95).alias("p95"), F.median("value").alias("med"))
    return near.join(evaluate.values_at(events, "event_type", "value", {"p95_trunc": evaluate.truncating(0.95)}), "event_type", "left")


@query("select event_type, round(avg(case when value > 50 then 1.0 else 0 end), 6) rate, count(*)::bigint sample_size, count(distinct user_id)::bigint users, count(*) filter (value > 50)::bigint hits from events group by 1")
def metric_rates(spark, sf_dir):
    big = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.try_divide(F.count_if(big), F.count("*")), 6).alias("rate"), F.count("*").alias("sample_size"), F.count_distinct("user_id").alias("users"), F.count_if(big).alias("hits"))


@query("select sha256(string_agg(doc_id || ':' || quality || ':' || toxic, chr(10) order by doc_id)) as digest, quality from labels group by quality")
def content_digest(spark, sf_dir):
    line = F.concat_ws(":", "doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "labels").groupBy("quality").agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("x"))
    return rows.select(F.sha2(F.array_join(F.transform("x", lambda x: x["l"]), "\n"), 256).alias("digest"), "quality")


@query("select c_custkey, 'sender_' || regexp_replace(regexp_replace(replace(replace(lower(c_name), '.', ' dot '), '''', ' apostrophe '), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') sender_id from customer")
def sender_slug(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.sender_slug(F.col("c_name")).alias("sender_id"))


@query("with c as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[!#$%&*]{2,}', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) t from documents) select doc_id, md5(upper(t[1:1]) || t[2:]) cleaned from c")
def text_clean(spark, sf_dir):
    t = T.capitalised(T.squashed(T.substituted(F.col("text"), [(r"[0-9]+", "0"), (r"[!#$%&*]{2,}", "")])))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("cleaned"))


@query("select split_part(source, 'c', 2) as family, count(*)::bigint n, count(distinct lang)::bigint langs, sum(n_chars)::bigint chars from documents group by 1")
def family_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.split_part("source", F.lit("c"), F.lit(2)).alias("family")).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("chars"))


@query("select l_orderkey from lineitem where l_orderkey % 11 = 0 and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F') group by 1")
def set_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 11 = 0").select(F.col("l_orderkey")).distinct()
    return lines.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


@query("select item_id, 'tier_a' as tier from benchmark union all select doc_id, 'tier_b' from labels where quality = 0 union all select conv_id, 'tier_c' from conversations where turn = 0")
def tier_union(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select("item_id", F.lit("tier_a").alias("tier"))
    b = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("item_id"), F.lit("tier_b").alias("tier"))
    return a.unionByName(b).unionByName(table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("item_id"), F.lit("tier_c").alias("tier")))


@query("""with s as (select item_id, doc_id, row_number() over (partition by item_id order by doc_id) k, doc_id % 5 session from (select item_id, doc_id from benchmark, documents where (item_id * 7 + doc_id) % 23 = 0)),
a as (select *, row_number() over (partition by item_id, session order by k) nth from s), b as (select *, sum(case when nth = 1 then 1 else 0 end) over (partition by item_id order by k) news from a),
c as (select *, row_number() over (partition by item_id order by k) as pos from b)
select item_id, doc_id from c where pos <= 3 or (pos > 3 and nth = 1 and not exists (select 1 from c d where d.item_id = c.item_id and d.pos < c.pos and d.nth = 1 and d.pos >= 3))""")
def diverse_evidence(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.pmod(F.col("item_id") * 7, F.lit(23)).alias("residue"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 5).alias("session"), F.pmod(-F.col("doc_id"), F.lit(23)).alias("residue"))
    rows = docs.join(items, "residue").drop("residue")
    return windows.diverse_evidence(rows, "item_id", "session", ["doc_id"]).select("item_id", "doc_id")


_TRACE = """with e as (select event_id, user_id, event_type, value from events),
t as (select event_id id, 'q' || user_id % 40 query_id, case event_id % 5 when 0 then 'query_completed' when 1 then 'result' when 2 then 'llm_call' else 'round' end record_type, event_id % 3 m, value v from e)"""


def _trace(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "query_completed").when(F.col("event_id") % 5 == 1, "result").when(F.col("event_id") % 5 == 2, "llm_call").otherwise("round")
    ids = lambda c: F.array(c.cast("string"))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("q"), F.col("user_id") % 40).alias("query_id"), kind.alias("record_type"),
        F.when(F.col("event_id") % 3 == 0, "jump").when(F.col("event_id") % 3 == 1, "retrieve_dense").otherwise("stop").alias("action"), F.lit("executed").alias("outcome"),
        F.when(F.col("event_id") % 3 == 0, "vlm_extract").otherwise("rewrite").alias("role"), ids(F.col("event_id") + 2).alias("supporting"), ids(F.col("user_id") % 7).alias("used"),
        F.when(F.col("event_id") % 2 == 0, ids(F.lit(1))).alias("gained"), F.array().cast("array<string>").alias("anchors"), (F.col("event_id") + 1).cast("string").alias("result_event_id"),
        F.round("value", 2).alias("latency_ms"), F.round("value", 2).cast("decimal(18,2)").alias("cost_usd"),
    )


@query(_TRACE + """, j as (select id, query_id, m from t where record_type = 'round' and id % 3 = 0),
fin as (select query_id, id + 1 f from t where record_type = 'query_completed'), sup as (select distinct fin.query_id, r.id + 2 id from fin join t r on r.id = fin.f and r.record_type = 'result'),
g as (select j.id, (select user_id % 7 from events where event_id = j.id) clue, exists (select 1 from sup where sup.query_id = j.query_id and sup.id = j.id) ok from j),
s as (select count(*) n, count(*) filter (ok) good, count(*) filter (id % 2 <> 0) ng from g), c as (select count(*) u, count(*) filter (k) uf from (select clue, bool_or(ok) k from g group by 1)),
x as (select count(*) filter (record_type = 'query_completed') q, count(*) filter (record_type = 'round') r, count(*) filter (record_type = 'round' and id % 3 = 1) se, count(*) filter (record_type = 'llm_call' and id % 3 <> 0) l, count(*) filter (record_type = 'llm_call' and id % 3 = 0) vl,
  count(*) filter (record_type = 'llm_call') ca, quantile_disc(round(v, 2), 0.5) filter (record_type = 'query_completed') s50, quantile_disc(round(v, 2), 0.95) filter (record_type = 'query_completed') s95, quantile_disc(round(v, 2), 0.5) filter (record_type = 'llm_call') c50, quantile_disc(round(v, 2), 0.95) filter (record_type = 'llm_call') c95,
  sum(round(v, 2)::decimal(18,2)) filter (record_type = 'llm_call') co from t)
select metric, value::double value, sample_size::bigint sample_size from (
select 'jump_success_rate' metric, good / n as value, n sample_size from s union all select 'no_gain_jump_rate', ng / n, n from s union all select 'useful_clue_precision', uf / u, u from c
union all select 'average_jumps_per_query', n / q, q from s, x union all select 'average_rounds', r / q, q from x union all select 'search_calls', se, q from x union all select 'llm_calls', l, q from x union all select 'vlm_calls', vl, q from x
union all select 'system_latency_p50', s50, q from x union all select 'system_latency_p95', s95, q from x union all select 'per_call_latency_p50', c50, ca from x union all select 'per_call_latency_p95', c95, ca from x union all select 'total_cost', co, q from x)""")
def trace_metrics(spark, sf_dir):
    return evaluate.trace_metrics(_trace(spark, sf_dir))


@query(_TRACE + " select d.query_id, coalesce(c, 0)::decimal(38,2)::double as cost from (select distinct query_id from t where record_type = 'query_completed') d left join (select query_id, sum(round(v, 2)::decimal(18,2)) c from t where record_type = 'llm_call' group by 1) using (query_id)")
def cost_per_query(spark, sf_dir):
    return evaluate.cost_per_query(_trace(spark, sf_dir)).withColumn("cost", F.col("cost").cast("double"))


@query("select event_id::varchar event_id, 'parent' as violation from events e where event_id % 10 = 0 and not exists (select 1 from events p where p.event_id = e.event_id - 1 and p.user_id = e.user_id and e.event_id > 0)")
def trace_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("query_id"), F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 10 == 0, (F.col("event_id") - 1).cast("string")).alias("parent_event_id"),
        F.lit("query_started").alias("record_type"), *(F.lit(None).cast("string").alias(c) for c in ("action", "outcome", "block_reason", "result_event_id", "payload")),
    )
    return gates.trace_violations(rows)


@query("select doc_id, case when not quality_ok then 'retrieval_miss' when not toxic_ok then 'selection_miss' when not even then 'context_miss' end stage from (select doc_id, quality = 1 quality_ok, toxic = 0 toxic_ok, doc_id % 2 = 0 even from labels)")
def failure_attribution(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"), (F.col("doc_id") % 2 == 0).alias("c"))
    return rows.select("doc_id", evaluate.failure_stage([("a", "retrieval_miss"), ("b", "selection_miss"), ("c", "context_miss")]).alias("stage"))


# --- queue, drafts, mentions, agreement ------------------------------------------------------------


@query("""select event_id, case event_type when 'view' then 'processing' else 'pending' end status from events
where event_type = 'view' or (event_type in ('click', 'error') and ts <= timestamp '2024-01-15') order by case event_type when 'view' then 0 else 1 end, event_id limit 250""")
def queue_head(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type").isin("click", "error"), "pending").otherwise("done")
    outbox = table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.col("ts").alias("next_attempt_at"))
    return feed.queue_head(outbox, F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), 250).select("event_id", "status")


@query("select o_orderkey media_id from orders where o_custkey is not null and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') order by o_orderdate, o_orderkey limit 1")
def next_pending_media(spark, sf_dir):
    media = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("parent_message_id"), F.col("o_orderdate").alias("created_at"))
    encoded = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("media_id"))
    return feed.next_pending_media(media, encoded).select("media_id")


@query("select o_orderkey media_id from orders where o_totalprice <= 100000 and o_orderpriority = '1-URGENT' and o_orderstatus = 'O' and o_orderdate + interval 900 day > timestamp '2000-01-01'")
def live_drafts(spark, sf_dir):
    parent = F.when(F.col("o_totalprice") > 100000, F.col("o_custkey"))
    media = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), parent.alias("parent_message_id"), F.col("o_orderpriority").alias("uploader_id"), F.col("o_orderstatus").alias("channel_id"), F.col("o_orderdate").alias("created_at"))
    return feed.live_drafts(media, "1-URGENT", "O", F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), 900 * 86_400).select("media_id")


@query("""select event_id feed_ordinal, 'id: ' || event_id || chr(10) || 'event: message' || chr(10) || 'data: {"message_id":"e' || event_id || '","channel_id":' || user_id || ',"event_type":"' || event_type || '"}' || chr(10) || chr(10) frame from events""")
def event_frames(spark, sf_dir):
    return feed.event_stream(_feed(spark, sf_dir), "message", ["message_id", "channel_id", "event_type"])


@query("""with m as (select s_suppkey message_id, s_name || ' asks @' || n_name || ' now, then @' || r_name || '!' t from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
known as (select n_name name, n_nationkey::bigint sender_id, 0.8 confidence from nation union all select r_name, 100 + r_regionkey, 0.8 from region),
x as (select message_id, unnest(string_split(t, '@')[2:]) piece, unnest(range(1, len(string_split(t, '@')))) i, string_split(t, '@') ps from m),
y as (select message_id, i, regexp_extract(piece, '^([^,!.?;:\n]+)', 1) raw, len(array_to_string(ps[1:i], '@')) st from x),
z as (select *, count(*) over (partition by message_id, i) n, row_number() over (partition by message_id, i order by len(name) desc, name) k
  from y join known on starts_with(replace(lower(trim(raw)), ' ', ''), replace(lower(name), ' ', '')))
select message_id, st::bigint as "start", (st + 1 + len(raw))::bigint as "end", sender_id, case when n > 1 then round(0.8 / n, 2) else 0.8 end::double confidence from z where k = 1""")
def mention_links(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat("s_name", F.lit(" asks @"), "n_name", F.lit(" now, then @"), "r_name", F.lit("!"))
    rows = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("message_id"), text.alias("text"))
    name = lambda t, n, k: table(spark, sf_dir, t).select(F.col(n).alias("name"), k.cast("long").alias("sender_id"), F.lit(0.8).alias("confidence"))
    return normalize.mentions(rows, name("nation", "n_name", F.col("n_nationkey")).unionByName(name("region", "r_name", 100 + F.col("r_regionkey"))))


@query(_EDGES + " select left_id, right_id from edges where (left_id % 5 = 0) <> (right_id % 5 = 0)")
def cross_split_edges(spark, sf_dir):
    split = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("component"), F.when(F.col("vec_id") % 5 == 0, "dev").otherwise("test").alias("split"))
    return evaluate.cross_split_edges(_edges(spark, sf_dir), split, "left_id", "right_id").select("left_id", "right_id")


@query("""select r.x block_reason, count(event_id)::bigint n from (select unnest(['click', 'view', 'no_scope']) x) r
left join events on event_type = r.x and value < 50 group by 1""")
def blocked_by_reason(spark, sf_dir):
    outcome = F.when(F.col("value") < 50, "blocked").otherwise("done")
    trace = table(spark, sf_dir, "events").select(F.lit("jump").alias("action"), outcome.alias("outcome"), F.col("event_type").alias("block_reason"))
    return evaluate.blocked_counts(trace, ("click", "view", "no_scope"))


@query("select lang, count(*) filter (regexp_matches(text, '[㐀-鿿]'))::bigint cjk, count(*)::bigint n from documents group by 1")
def cjk_by_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike(T.CJK)).alias("cjk"), F.count("*").alias("n"))


@query(r"""with x as (select doc_id, case when doc_id % 5 = 0 then 'key: sk-abcdefghij then ' || coalesce(text, '') || ' Bearer a.b_c-9' when doc_id % 5 = 1 then 'xOR-12345678 sk-1234567' else text end t from documents)
select doc_id, sha256(regexp_replace(t, '(sk-|or-)[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._-]+', '[REDACTED]', 'gi')) digest, regexp_matches(t, '(sk-|or-)[A-Za-z0-9_-]{8,}|bearer\s+[A-Za-z0-9._-]+', 'i') has_secret from x""")
def secrets_redacted(spark, sf_dir):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("key: sk-abcdefghij then "), F.coalesce("text", F.lit("")), F.lit(" Bearer a.b_c-9"))).when(F.col("doc_id") % 5 == 1, F.lit("xOR-12345678 sk-1234567")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redacted(t), 256).alias("digest"), t.rlike(T.REDACT).alias("has_secret"))


@query("select doc_id, sha256(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')) digest from documents")
def accents_folded(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.folded_accents(F.col("text")), 256).alias("digest"))


@query("select conv_id, 'c' || conv_id || ':' || min(turn) || '-' || max(turn) chunk_id from conversations where turn is not null group by 1")
def chunk_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    ids = F.transform("turns", lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit(":"), t))
    return rows.select("conv_id", T.chunk_id(F.concat(F.lit("c"), "conv_id"), ids).alias("chunk_id"))


@query("with c as (select distinct conv_id from conversations) select conv_id, row_number() over (order by sha256('split-1:' || conv_id), conv_id) - 1 as position from c")
def salted_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rows = rows.withColumn("salted", F.sha2(F.concat(F.lit("split-1:"), "conv_id"), 256))
    return windows.global_rank(rows, ["salted", "conv_id"], "position").select("conv_id", "position")


@query("with t as (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from documents) select term, count(*)::bigint n from t group by 1 order by n desc, term limit 50")
def most_common_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(lexical.terms(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


@query(f"with a as ({_FOUND['raw_at_k'][1]}), b as ({_FOUND['distinct_at_k'][1]}) select case when a.hit > 0 and b.hit > 0 then 'both_hit' when b.hit > 0 then 'fixed' when a.hit > 0 then 'broken' else 'both_miss' end outcome, count(*)::bigint n from a join b using (item_id) group by 1")
def hit_changes(spark, sf_dir):
    return evaluate.hit_changes(raw_at_k(spark, sf_dir), distinct_at_k(spark, sf_dir), "item_id", "hit")


@query("""with n as (select count(*) n, avg((quality = toxic)::int) same, avg(quality) q, avg(toxic) t from labels where quality is not null and toxic is not null)
select round((same - (q * t + (1 - q) * (1 - t))) / (1 - (q * t + (1 - q) * (1 - t))), 6) kappa from n""")
def rater_agreement(spark, sf_dir):
    value = evaluate.kappa(table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null"), "quality", "toxic")
    return spark.createDataFrame([(None if value is None else round(value, 6),)], "kappa double")


# --- context, routing, lookups ---------------------------------------------------------------------


@query("""with a as (select conv_id, turn from conversations where conv_id % 5 = 0 and turn % 7 = 3)
select conv_id, turn, role from conversations c where exists (select 1 from a where a.conv_id = c.conv_id and abs(a.turn - c.turn) <= 2)""")
def context_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return context.turns_around(rows, rows.filter("conv_id % 5 = 0 and turn % 7 = 3"), "conv_id", "turn", 2)


@query("""with a as (select user_id, ts from events where event_id % 50 = 0)
select event_id, user_id from events e where exists (select 1 from a where a.user_id = e.user_id and abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 600 * 60000000::bigint)""")
def context_minutes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return context.minutes_around(rows, rows.filter("event_id % 50 = 0"), "user_id", "ts", 600).select("event_id", "user_id")


@query("""with p as (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn) k from conversations where turn is not null)
select conv_id, turn, role from p where exists (select 1 from p a where a.conv_id = p.conv_id and a.role is not distinct from p.role and a.turn % 6 = 2 and abs(a.k - p.k) <= 1)""")
def context_same_sender(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("turn is not null").select("conv_id", "turn", "role").withColumn("anchor", F.col("turn") % 6 == 2)
    return context.same_sender_around(rows, "conv_id", "role", "turn", "anchor", 1).drop("anchor")


@query("""with m as (select event_id, case when event_id % 3 <> 0 then event_id - 1 - event_id % 2 end parent from events), a as (select * from m where event_id % 20 = 2)
select event_id from m where event_id in (select event_id from a) or event_id in (select parent from a) or parent in (select event_id from a)""")
def context_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") - 1 - F.col("event_id") % 2).alias("parent"))
    return context.replies_around(rows, rows.filter("event_id % 20 = 2"), "event_id", "parent").select("event_id")


@query("select doc_id, case when quality = 1 then 'context' when toxic = 1 then 'visual' else 'structural' end route from labels")
def route_constraints(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", context.route(F.when(F.col("quality") == 1, "trip"), F.when(F.col("toxic") == 1, "dog").otherwise(" ")).alias("route"))


@query("""with r as (select o_orderkey, o_custkey a1, case when o_custkey % 3 <> 0 then o_custkey + 40 end b1, case when o_orderkey % 2 = 0 then o_custkey - 10 end a2, o_custkey + o_orderkey % 60 b2 from orders)
select o_orderkey, greatest(a1, a2) low, least(b1, b2) high from r where greatest(a1, a2) <= least(b1, b2)""")
def narrowed_range(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c.alias("a1"), F.when(c % 3 != 0, c + 40).alias("b1"), F.when(o % 2 == 0, c - 10).alias("a2"), (c + o % 60).alias("b2"))
    low, high = context.narrowed(("a1", "a2"), ("b1", "b2"))
    return rows.select("o_orderkey", low.alias("low"), high.alias("high")).filter("low <= high")


@query("""with s as (select user_id, event_id, row_number() over (partition by user_id, event_type, event_id % 3 order by event_id) k from events)
select * from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as cycle from s where k = 1) where cycle <= 6""")
def search_cycles(spark, sf_dir):
    kind, place = F.col("event_type"), F.concat(F.lit("place"), F.col("event_id") % 3)
    words = F.when(F.col("event_id") % 2 == 0, F.array(kind, place)).otherwise(F.array(place, kind, place))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", words.alias("keywords"))
    return context.fresh_searches(rows, "user_id", "event_id", "keywords").select("user_id", "event_id", "cycle")


@query("""with m as (select p_partkey media_id, p_brand ch, 'session' || p_size % 4 s, (p_partkey % 9)::varchar || '.jpg' f from part),
q as (select o_orderkey question_id, 'Brand#' || (1 + o_custkey % 5) || (1 + o_orderkey % 5) ch, 'session' || o_orderkey % 7 s, case when o_custkey % 2 = 0 then 'session' || o_custkey % 6 end n, (o_custkey % 9)::varchar || '.jpg' f from orders),
j as (select question_id, media_id, case when m.s = q.n then 1 when m.s = q.s then 2 else 3 end as rule from q join m using (ch, f))
select question_id, media_id, rule from j qualify row_number() over (partition by question_id order by rule, media_id) = 1""")
def media_lookup(spark, sf_dir):
    p, o, c = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    file = lambda k: F.concat((k % 9).cast("string"), F.lit(".jpg"))
    media = table(spark, sf_dir, "part").select(p.alias("media_id"), F.col("p_brand").alias("channel_id"), F.concat(F.lit("raw/x/session"), F.col("p_size") % 4, F.lit("/image/"), file(p)).alias("path"))
    image = F.when(c % 2 == 0, F.concat(F.lit("session"), c % 6, F.lit("/"), file(c))).otherwise(file(c))
    asked = table(spark, sf_dir, "orders").select(o.alias("question_id"), F.concat(F.lit("Brand#"), 1 + c % 5, 1 + o % 5).alias("channel_id"), F.concat(F.lit("session"), o % 7).alias("session"), image.alias("image"))
    return context.resolve_media(asked, media)


@query("""with r as (select distinct doc_id % 50 q, doc_id from labels where quality = 1), g as (select distinct doc_id % 50 q, doc_id from labels where toxic = 0),
b as (select coalesce(r.q, g.q) query_id, r.doc_id r, g.doc_id g from r full join g on r.q = g.q and r.doc_id = g.doc_id)
select query_id, count(r)::bigint n_retrieved, count(g)::bigint n_gold, round(count(*) filter (r is not null and g is not null) / nullif(count(g), 0), 6) recall, round(count(*) filter (r is not null and g is not null) / nullif(count(r), 0), 6) as precision from b group by 1""")
def retrieval_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").filter("doc_id is not null").withColumn("query_id", F.col("doc_id") % 50)
    return evaluate.retrieval_metrics(rows.filter("quality = 1"), rows.filter("toxic = 0"), "query_id", "doc_id")


@query("select c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || c_name || ', an ' || c_mktsegment || '!'), '[^a-z0-9 ]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g')) answer from customer")
def normalised_answers(spark, sf_dir):
    text = F.concat(F.lit("The "), "c_name", F.lit(", an "), "c_mktsegment", F.lit("!"))
    return table(spark, sf_dir, "customer").select("c_custkey", evaluate.normalised_answer(text).alias("answer"))


@query("""select event_type, list_sort(list(value))[least(count(value), floor(count(value) * 0.5)::bigint + 1)] p50, list_sort(list(value))[least(count(value), floor(count(value) * 0.9)::bigint + 1)] p90 from events where value is not null group by 1""")
def percentiles_positional(spark, sf_dir):
    return evaluate.values_at(table(spark, sf_dir, "events"), "event_type", "value", {"p50": evaluate.positional(0.5), "p90": evaluate.positional(0.9)})


@query("""with m as (select vec_id, vec_id // (2 + label % 12) cluster, vec_id % 7 g from embeddings), s as (select cluster from m group by 1 having count(*) between 2 and 10)
select distinct a.g as "left", b.g as "right" from m a join m b using (cluster) where a.g < b.g and cluster in (select cluster from s)""")
def cluster_group_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / (2 + F.col("label") % 12)).alias("cluster"), (F.col("vec_id") % 7).alias("g"))
    return evaluate.cluster_edges(rows, "cluster", "g")


@query("""with w as (select p_partkey k from part where p_partkey % 3 <> 0), f as (select distinct l_partkey k from lineitem where l_linenumber > 2 and l_quantity > 40)
select k, 'missing' side from w where k not in (select k from f) union all select k, 'extra' from f where k not in (select k from w)""")
def missing_and_extra(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"))
    return gates.set_report(wanted, table(spark, sf_dir, "lineitem").filter("l_linenumber > 2 and l_quantity > 40").select(F.col("l_partkey").alias("k")), "k")


@query("""select doc_id query_id, case when doc_id % 13 = 0 then 'count' when doc_id % 7 = 0 then 'message_id' when doc_id % 5 = 0 then 'unknown_message' when doc_id % 11 = 0 then 'hash' end violation
from documents where doc_id % 13 = 0 or doc_id % 7 = 0 or doc_id % 5 = 0 or doc_id % 11 = 0""")
def binding_violations(spark, sf_dir):
    d, digest = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    own = F.struct((d + F.when(d % 7 == 0, 1).otherwise(0)).alias("message_id"), F.when(d % 11 == 0, F.lit("x")).otherwise(digest).alias("message_hash"))
    bound = F.array(own)
    rows = docs.select(d.alias("query_id"), F.array(d).alias("gold_ids"), F.when(d % 13 == 0, F.slice(bound, 1, 0)).otherwise(bound).alias("bindings"))
    return gates.binding_violations(rows, docs.filter(d % 5 != 0).select(d.alias("message_id"), digest.alias("hash")))


@query("select c_custkey channel_id, greatest(c_nationkey * 100, m)::bigint last_ordinal from customer left join (select o_custkey c_custkey, max(o_orderkey) m from orders group by 1) using (c_custkey)")
def raised_last(spark, sf_dir):
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), (F.col("c_nationkey") * 100).cast("long").alias("last_ordinal"))
    return feed.raised_last(channels, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("ordinal")))


@query("""with l as (select epoch_us(o_orderdate + to_hours((o_orderkey % 48)::int)) - epoch_us(o_orderdate) us, o_orderpriority p from orders where o_orderkey % 3 = 0)
select p priority, count(*)::bigint n, quantile_disc(us / 1000.0, 0.5)::double p50, quantile_disc(us / 1000.0, 0.95)::double p95 from l group by 1""")
def visibility_latency(spark, sf_dir):
    acks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("acked_at"), F.col("o_orderpriority").alias("priority"))
    commits = acks.filter("event_id % 3 = 0").select("event_id", (F.col("acked_at") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("committed_at"))
    late = conversations.visibility_latency(acks, commits).join(acks, "event_id")
    return late.groupBy("priority").agg(F.count("*").alias("n"), *(evaluate.percentile_nearest("latency_ms", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)))
