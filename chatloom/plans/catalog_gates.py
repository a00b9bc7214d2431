"""Queries of the release gates: answers and questions that are kept, internal vocabulary, artifacts held against their data, digests in key order."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import text as T
from chatloom.operators import evaluate, gates, release
from chatloom.plans.catalog import query, table


def _sql_text(pattern: str) -> str:
    return "'" + pattern.removeprefix("(?i)").replace("'", "''") + "'"


@query(rf"""with x as (select doc_id, case doc_id % 8 when 0 then 'Yes' when 1 then ' no ' when 2 then 'TRUE' when 3 then '' when 4 then 'It is not specified' when 5 then 'see photo_7' else 'a blue door' end answer,
case doc_id % 5 when 0 then 'According to the chat, which door?' when 1 then 'Where was session 12 held?' when 2 then null else 'Which door is blue?' end question from documents)
select doc_id, case when lower(trim(answer)) in ('no', 'yes', 'none', 'n/a', 'false', 'true', '') or regexp_matches(answer, {_sql_text(T.NEGATIVE_ANSWER)}, 'i') then 'answer'
when regexp_matches(coalesce(question, ''), {_sql_text(T.META_PREAMBLE)}, 'i') or regexp_matches(answer, {_sql_text(T.META_PREAMBLE)}, 'i') then 'preamble'
when regexp_matches(coalesce(question, ''), {_sql_text(T.NAMED_FILES)}, 'i') or regexp_matches(answer, {_sql_text(T.NAMED_FILES)}, 'i') then 'vocabulary' end reason from x""")
def question_rejections(spark, sf_dir):
    """Bare and negative answers, preambles and file names, each with its reason."""
    k, j = F.col("doc_id") % 8, F.col("doc_id") % 5
    answer = F.when(k == 0, "Yes").when(k == 1, " no ").when(k == 2, "TRUE").when(k == 3, "").when(k == 4, "It is not specified").when(k == 5, "see photo_7").otherwise("a blue door")
    question = F.when(j == 0, "According to the chat, which door?").when(j == 1, "Where was session 12 held?").when(j != 2, "Which door is blue?")
    return table(spark, sf_dir, "documents").select("doc_id", T.rejection(question, answer).alias("reason"))


@query(rf"""with x as (select doc_id, case doc_id % 6 when 0 then 'from Session 12 on' when 1 then 'the file IMG12.PNG' when 2 then 'session4/image' when 3 then 'in this conversation, we' when 4 then 'sessions and pngs' else text end t, lang from documents),
p as (select doc_id, list_filter([case when regexp_matches(t, '[Ss]ession\s*\d+') or regexp_matches(coalesce(lang, ''), '[Ss]ession\s*\d+') then 0 end, case when regexp_matches(t, '\b\w*\d+\.(png|jpe?g)\b', 'i') then 1 end, case when regexp_matches(t, 'session\d+/', 'i') then 2 end], lambda x: x is not null) hard, regexp_matches(t, '\bIn this conversation,', 'i') soft from x)
select doc_id, case when len(hard) > 0 then 'fail' else 'review' end outcome, case when len(hard) > 0 then array_to_string(hard, ',') else '0' end patterns from p where len(hard) > 0 or soft""")
def vocabulary_outcomes(spark, sf_dir):
    """The patterns of releases: rows that fail, and those that are only reviewed."""
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "from Session 12 on").when(k == 1, "the file IMG12.PNG").when(k == 2, "session4/image").when(k == 3, "in this conversation, we").when(k == 4, "sessions and pngs").otherwise(F.col("text"))
    found = gates.vocabulary_outcomes(table(spark, sf_dir, "documents").withColumn("t", t), "doc_id", ["t", "lang"])
    return found.select("doc_id", "outcome", F.array_join(F.col("patterns").cast("array<string>"), ",").alias("patterns"))


_LEVEL = "select g, pos // 1024 as pos, sha256(string_agg(d, '' order by pos)) d, max(n) n from {} group by g, pos // 1024"
_DIGEST = """with r as (select {group} g, row_number() over (partition by {group} order by {key}) - 1 as pos, sha256({line}) d, count(*) over (partition by {group}) n from {table}),
l1 as (""" + _LEVEL.format("r") + "), l2 as (" + _LEVEL.format("l1") + "), l3 as (" + _LEVEL.format("l2") + "), l4 as (" + _LEVEL.format("l3") + ") "


@query(_DIGEST.format(group="quality", key="doc_id", line="doc_id || chr(0) || quality || chr(0) || toxic", table="labels") + "select g quality, n::bigint n, d digest from l4")
def manifest_digest(spark, sf_dir):
    """A digest of each group in key order, the same for any cut of files."""
    return release.ordered_digests(table(spark, sf_dir, "labels"), "quality", "doc_id", ["quality", "toxic"])


_EXPECTED = {"model_name": "encoder", "model_version": "1", "preprocessing": "resize 224", "device": "cpu"}


@query("""select label artifact, case label % 7 when 1 then 'MEDIA_INPUT_SET_MISMATCH' when 2 then 'VISUAL_MODEL_MISMATCH' when 3 then 'VISUAL_PREPROCESSING_MISMATCH' when 4 then 'VISUAL_DEVICE_MISMATCH' when 5 then 'MATRIX_SHA256_MISMATCH' when 6 then 'MEDIA_COUNT_MISMATCH' end code
from embeddings group by label""")
def artifacts_verified(spark, sf_dir):
    """Manifests of one artifact a label, six in seven with one fault each, against digests of what is there."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("artifact"), F.col("vec_id").alias("media_id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("content"), F.col("embedding").alias("vector"))
    kind = F.col("artifact") % 7
    # A manifest of other media, or of another matrix, is one that was made before a row changed.
    old = gates.artifact_manifests(rows.withColumn("content", F.when(kind == 1, F.upper("content")).otherwise(F.col("content"))), rows.withColumn("vector", F.when(kind == 5, F.reverse("vector")).otherwise(F.col("vector"))))
    other = lambda k, name: F.when(kind == k, "other").otherwise(_EXPECTED[name]).alias(name)
    manifests = old.select("artifact", "media_input_sha256", (F.col("media_count") + F.when(kind == 6, 1).otherwise(0)).alias("media_count"), "matrix_sha256", other(2, "model_name"), F.lit("1").alias("model_version"), other(3, "preprocessing"), other(4, "device"))
    return gates.artifact_errors(manifests, rows, rows, _EXPECTED)


_NAMES = "case c_custkey % 6 when 0 then 'Nguyễn Đức ' when 1 then 'Őszi Åse ' when 2 then 'ȘERBAN ' when 3 then 'żółć ' when 4 then 'Crème ' else 'Øyvind ' end || c_mktsegment"


def _names(spark, sf_dir):
    k = F.col("c_custkey") % 6
    first = F.when(k == 0, "Nguyễn Đức ").when(k == 1, "Őszi Åse ").when(k == 2, "ȘERBAN ").when(k == 3, "żółć ").when(k == 4, "Crème ").otherwise("Øyvind ")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(first, "c_mktsegment").alias("name"))


@query(f"select c_custkey, translate(lower(strip_accents(translate({_NAMES}, 'ĐøØł', 'DoOl'))), 'đ', 'd') name from customer")
def accents_stripped(spark, sf_dir):
    return _names(spark, sf_dir).select("c_custkey", T.folded_accents(F.col("name")).alias("name"))


@query(f"with n as (select c_custkey, {_NAMES} nm from customer), m as (select c_custkey, case when c_custkey % 2 = 0 then upper(nm) else lower(nm) end nm from n) select min(c_custkey) first_id, count(*)::bigint n from m group by lower(strip_accents(translate(lower(nm), 'đøł', 'dol')))")
def senders_of_any_accent(spark, sf_dir):
    """Names that differ in case and accents alone are one sender, by collation."""
    rows = _names(spark, sf_dir).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("name")).otherwise(F.lower("name")).alias("name"))
    return rows.groupBy(T.any_accent(F.col("name")).alias("name")).agg(F.min("c_custkey").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


@query("""with c as (select doc_id // 3 component, coalesce('s' || quality, 'none') stratum, count(*) n from labels where doc_id is not null group by all)
select count(distinct component)::bigint components, floor(sum(n) * 0.4)::bigint dev_rows, true quotas_met, 0::bigint in_both from c""")
def split_assignment(spark, sf_dir):
    """Dev holds two fifths of the rows to the row, and of each stratum nearly so; no component is in both."""
    rows = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy(F.floor(F.col("doc_id") / 3).alias("component"), F.coalesce(F.concat(F.lit("s"), "quality"), F.lit("none")).alias("stratum")).agg(F.count("*").alias("n"))
    sums = {r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.sum("n").alias("n")).collect()}  # a row a stratum
    quotas = {s: int(n * 0.4) for s, n in sums.items()}
    split = evaluate.assign_splits(rows, int(sum(sums.values()) * 0.4), quotas, "salt")
    split = spark.createDataFrame(list(split.items()) or [], "component long, split string")
    dev = rows.join(split, "component").filter("split = 'dev'")
    limits = F.create_map(*(F.lit(x) for s, q in quotas.items() for x in (s, q)))
    near = dev.groupBy("stratum").agg(F.sum("n").alias("n")).agg(F.coalesce(F.bool_and(F.abs(F.col("n") - limits[F.col("stratum")]) <= F.greatest(F.lit(8), 0.15 * limits[F.col("stratum")])), F.lit(False)).alias("quotas_met"))
    twice = split.groupBy("component").agg(F.count_distinct("split").alias("k")).agg(F.count("*").alias("components"), F.count_if(F.col("k") > 1).alias("in_both"))
    return twice.crossJoin(dev.agg(F.sum("n").alias("dev_rows"))).crossJoin(near).select("components", "dev_rows", "quotas_met", "in_both")  # one row each
