"""More registered queries: identifiers, predicates, joins, gates and commands, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import commands, context, evaluate, gates, lexical, normalize, scope, similarity
from chatloom.plans.catalog import COSINE, _BITS, _BM25, _CHUNKS, _EDGES, _GOLD, _GRANTS, _REACH, HAMMING, _grants, _judged, _links, _placed, query, table

# --- identifiers and predicates ------------------------------------------------------------------


@query("""select doc_id, case when doc_id % 2 = 1 then 'multiparty' else 'dyadic' end || '_d' || (doc_id % 7) channel_id, (doc_id % 11)::int session_index from documents""")
def channel_of_path(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 1, "multi-party").otherwise("dyadic"), F.lit("/dialogue0"), F.col("doc_id") % 7, F.lit("/scenes/session"), F.col("doc_id") % 11, F.lit("/session.json")).alias("path"))
    return rows.select("doc_id", T.channel_id(F.col("path")).alias("channel_id"), T.session_number(F.col("path")).alias("session_index"))


@query(_GRANTS + "select channel_id from gr where valid_to is null")
def strictly_active_grants(spark, sf_dir):
    return scope.grants_of(_grants(spark, sf_dir), 1, F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00")), open_only=True)


@query(r"""with x as (select doc_id, case doc_id % 6 when 0 then 'It is Not  mentioned here' when 1 then 'see photo_12 there' when 2 then 'nonetheless fine' when 3 then 'a 12.PNG file' when 4 then text end t from documents)
select doc_id from x where t is not null and not regexp_matches(t, '\b(not\s+mentioned|not\s+specified|not\s+stated|unmentioned|not\s+clear|cannot\s+be\s+determined|no\s+mention|none|n/a|false|unknown)\b', 'i')
and not regexp_matches(t, '\b(session\s*[0-9]+|meeting\s*[0-9]+|photo_[0-9]+|section_[0-9]+|[0-9]+\.(png|jpe?g))\b', 'i')""")
def accepted_answers(spark, sf_dir):
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "It is Not  mentioned here").when(k == 1, "see photo_12 there").when(k == 2, "nonetheless fine").when(k == 3, "a 12.PNG file").when(k == 4, F.col("text"))
    return table(spark, sf_dir, "documents").filter(~T.rejected(t)).select("doc_id")


@query(r"""select c_custkey, regexp_replace(regexp_replace(c_name || ' of the ' || c_mktsegment || ' and Customers', '\bcustomer\b', 'client', 'gi'), '\b(building|household)\b', 'home', 'gi') t from customer""")
def synonyms_rewritten(spark, sf_dir):
    t = F.concat("c_name", F.lit(" of the "), "c_mktsegment", F.lit(" and Customers"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.synonyms(t, [("customer", "client"), ("building|household", "home")]).alias("t"))


@query("select doc_id, nullif(case when doc_id % 3 = 0 then '' else source end, '') source from documents")
def empty_as_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.null_if_empty(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source"))).alias("source"))


@query("select doc_id, not regexp_matches(text, '[^\\x00-\\x7F]|[<>&]') safe from documents")
def ascii_safe_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.is_ascii_safe(F.col("text")).alias("safe"))


@query("select user_id, string_agg(event_type, ',' order by f) kinds from (select user_id, event_type, min(event_id) f from events group by 1, 2) group by 1")
def kinds_in_order(spark, sf_dir):
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(T.first_occurrences(kinds), ",").alias("kinds"))


@query("select doc_id, (len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) - len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: x not in ('the', 'of', 'image'))))::bigint score from documents")
def keyword_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexical.keyword_score(F.col("text"), ["the", "of", "image"]).alias("score"))


@query("select doc_id, item_id, 'return_result' expected_action from documents join benchmark on item_id = doc_id where doc_id % 3 = 0")
def released_results(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "benchmark").select("item_id"), F.col("item_id") == F.col("doc_id"))
    rows = rows.withColumn("expected_action", F.when(F.col("doc_id") % 3 == 0, "return_result").when(F.col("doc_id") % 3 == 1, "clarify").otherwise("no_result"))
    return gates.returning(rows).select("doc_id", "item_id", "expected_action")


# --- joins -----------------------------------------------------------------------------------------


@query("select n_name message_id, n_nationkey sender_id, c_custkey target_message_id from nation join customer on c_nationkey = n_nationkey")
def mention_targets(spark, sf_dir):
    mentions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("message_id"), F.col("n_nationkey").alias("sender_id"))
    return normalize.mention_targets(mentions, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("message_id"), F.col("c_nationkey").alias("sender_id")))


@query("select o_orderpriority, count(*)::bigint n, count(*) filter (exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'))::bigint with_image from orders group by 1")
def questions_with_session_image(spark, sf_dir):
    media = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    found = context.sessions_with_image(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), media, ["o_orderkey"])
    return found.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("has_image").alias("with_image"))


@query("select (l_orderkey || ':' || l_linenumber) media_id, coalesce(c_name, 'Unknown') || ': ' || coalesce(o_orderpriority, '') text from lineitem left join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P' left join customer on c_custkey = o_custkey and c_custkey % 5 <> 0")
def media_documents(spark, sf_dir):
    media = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("media_id"), F.col("l_orderkey").alias("parent_message_id"))
    messages = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("sender_id"), F.col("o_orderpriority").alias("text"))
    return context.media_documents(media, messages, table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("sender_id"), F.col("c_name").alias("display_name")))


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus <> 'F')")
def dangling_references(spark, sf_dir):
    return gates.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'"), "o_orderkey")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) has_large from customer")
def exists_flags(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return context.sessions_with_image(table(spark, sf_dir, "customer").select("c_custkey"), large, ["c_custkey"]).withColumnRenamed("has_image", "has_large")


# --- aggregates, orders, sets ----------------------------------------------------------------------


@query("select greatest(max(event_id), 500)::bigint as counter from events")
def global_counter(spark, sf_dir):
    return commands.raised_counter(table(spark, sf_dir, "events"), "event_id", 500)


@query(_EDGES + ", " + _BITS.removeprefix("with ") + f""", h as (select a.vec_id left_id, b.vec_id right_id from b a join b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= {HAMMING})
select count(edges.left_id)::bigint cosine, count(h.left_id)::bigint phash, count(*) filter (edges.left_id is not null and h.left_id is not null)::bigint as both, count(*)::bigint edges
from edges full join h on edges.left_id = h.left_id and edges.right_id = h.right_id""")
def edge_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("bits", similarity.sign_bits("embedding"))
    return similarity.measure_counts(rows, "vec_id", "embedding", "bits", COSINE, HAMMING)


@query("""select event_type, count(*)::bigint n, percentile_disc(0.5) within group (order by value) p50, round(avg((event_id % 5 = 0)::int), 6) rejection_rate,
event_type = (select event_type from events order by value, event_type limit 1) chosen from events group by 1""")
def probe_summary(spark, sf_dir):
    return evaluate.probe_summary(table(spark, sf_dir, "events").withColumn("rejected", F.col("event_id") % 5 == 0), "event_type", "value", "rejected")


@query("select c_custkey, row_number() over (order by lower(x), x, c_custkey) - 1 as place from (select c_custkey, case when c_custkey % 2 = 0 then upper(c_mktsegment) else lower(c_mktsegment) end x from customer)")
def sender_order(spark, sf_dir):
    x = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return normalize.by_folded_name(table(spark, sf_dir, "customer").select("c_custkey", x.alias("x")), "x", "c_custkey").select("c_custkey", "place")


@query("select count(*)::bigint n_shared, count(*) = 0 disjoint from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')")
def splits_disjoint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return evaluate.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query(_REACH + ", k as (select component, row_number() over (order by component) - 1 i from (select distinct component from comp)) select node, component, 'comp_' || lpad(i::varchar, greatest(3, length(i::varchar))::int, '0') || '_' || component component_id from comp join k using (component)")
def group_components(spark, sf_dir):
    return evaluate.group_components(_links(spark, sf_dir), "left_id", "right_id")


# --- retrieval gates -------------------------------------------------------------------------------

_TOP1 = _BM25 + _GOLD + ", t as (select b.item_id, bool_or(gold.doc_id is not null) hit from benchmark b left join r on r.item_id = b.item_id and rank = 1 left join gold on gold.item_id = b.item_id and gold.doc_id = r.doc_id group by all)"


def _hits(spark, sf_dir):
    found = _judged(spark, sf_dir, 1).groupBy("item_id").agg(F.max("gold").alias("hit"))
    return table(spark, sf_dir, "benchmark").select("item_id").distinct().join(found, "item_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query(_TOP1 + "select count(*)::bigint n, count(*) filter (hit)::bigint hits, round(avg(hit::int), 6) rate, coalesce(round(avg(hit::int), 6) >= 0.7, false) saturated from t where item_id % 3 = 0")
def dev_saturation(spark, sf_dir):
    return evaluate.saturation(_hits(spark, sf_dir), "hit", F.col("item_id") % 3 == 0)


@query(_TOP1 + """select count(*)::bigint n, count(*) filter (hit)::bigint leaked, count(*) filter (hit and item_id % 2 = 0)::bigint rewritten, count(*) filter (hit and not (item_id % 4 = 0))::bigint released_leaks,
round(avg((hit and not (item_id % 4 = 0))::int), 6) rate, coalesce(round(avg((hit and not (item_id % 4 = 0))::int), 6) <= 0.15, true) passes from t""")
def released_leaks(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumnRenamed("hit", "leak")
    return evaluate.released_leaks(hits, hits.filter("item_id % 2 = 0").withColumn("leak", F.col("item_id") % 4 != 0), "item_id")


# --- artifacts and commands ------------------------------------------------------------------------


@query("""select p_partkey, case when p_size % 2 = 0 then 'MEDIA_INPUT_SET_MISMATCH' when p_size % 3 = 0 then 'VISUAL_MODEL_MISMATCH' when p_size % 5 = 0 then 'VISUAL_PREPROCESSING_MISMATCH'
when p_size % 7 = 0 then 'VISUAL_DEVICE_MISMATCH' when p_size % 11 = 0 then 'MATRIX_SHA256_MISMATCH' when p_size % 13 = 0 then 'MEDIA_COUNT_MISMATCH' end code from part""")
def artifact_errors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", gates.artifact_error([F.col("p_size") % k != 0 for k in (2, 3, 5, 7, 11, 13)]).alias("code"))


@query(_CHUNKS + ", w as (select conv_id, turn, chunk_index, lag(chunk_index) over (partition by conv_id order by turn) b from p) select conv_id, turn, b closed_chunk, chunk_index opened_chunk from w where b < chunk_index")
def chunk_transitions(spark, sf_dir):
    return commands.chunk_transitions(_placed(spark, sf_dir), "conv_id", "turn")


@query("select event_id, min(event_id) over w first_id, event_id <> min(event_id) over w replayed from events window w as (partition by user_id, event_type)")
def idempotent_commands(spark, sf_dir):
    return commands.first_of_each_key(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id").select("event_id", "first_id", "replayed")


@query("""select event_id, (event_id % 5) + 1 attempt_count, case when event_id % 5 = 4 then 'dead_letter' else 'pending' end status, case when event_id % 5 < 4 then epoch_us(ts + interval 2 second) else -1 end next_attempt_at from events""")
def outbox_retried(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 5).alias("attempt_count"))
    return commands.retried(rows, F.col("ts")).select("event_id", "attempt_count", "status", F.coalesce(F.unix_micros(F.col("next_attempt_at").cast("timestamp")), F.lit(-1)).alias("next_attempt_at"))


@query("""with s as (select o_orderkey send_id, o_custkey channel_id from orders), g as (select distinct c_custkey channel_id from customer where c_custkey % 3 <> 0),
w as (select send_id, channel_id, l_partkey draft_id from s join g using (channel_id) join lineitem on l_orderkey = send_id),
d as (select distinct l_partkey draft_id, o_custkey channel_id from lineitem join orders on o_orderkey = l_orderkey where l_linestatus = 'F'),
b as (select *, row_number() over (partition by draft_id, channel_id order by send_id) k from w),
bad as (select distinct send_id from b where k > 1 or not exists (select 1 from d where d.draft_id = b.draft_id and d.channel_id = b.channel_id)),
st as (select send_id, channel_id, case when channel_id not in (select channel_id from g) then 'denied' when send_id in (select send_id from bad) then 'draft_conflict' else 'sent' end status from s)
select send_id, channel_id, status, case when status = 'sent' then (channel_id % 4) + row_number() over (partition by channel_id, status order by send_id) else -1 end::bigint as ordinal from st""")
def sends_applied(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    channel = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("channel_id"))
    lists = items.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("draft_ids"))
    sends = channel.join(lists, "l_orderkey", "left").select(F.col("l_orderkey").alias("send_id"), "channel_id", F.coalesce("draft_ids", F.array().cast("array<bigint>")).alias("draft_ids"))
    drafts = items.filter("l_linestatus = 'F'").join(channel, "l_orderkey").select(F.col("l_partkey").alias("draft_id"), "channel_id")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"))
    existing = customers.withColumn("ordinal", F.col("channel_id") % 4)
    return commands.apply_sends(sends, customers.filter("channel_id % 3 <> 0"), drafts, existing).withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))
