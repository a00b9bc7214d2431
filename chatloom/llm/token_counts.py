"""Delta-maintained token counts by source, language and tokenizer version.

Changes carry a sign: an insert adds its counts, a delete takes its old counts away, a
revision does both. A batch is reduced to one row a (source, language, version) before it
is written, so totals are sums of small additive rows and never need the documents
again. A batch is committed once: its folder counts only with the success marker that
Spark writes last, a second commit of the same id changes nothing, and one that was cut
off is written anew.

Defined cases: null sources, languages and texts are groups and counts (0) of their own;
repeated rows count as often as they occur; an empty batch commits and adds nothing; extra
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm.common import documents
from chatloom.session import shared_dir, staged

KEYS = ("source", "lang", "version")
# What a token is in each tokenizer version.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"\p{L}+|[0-9]+|[^\x20\x09-\x0D\p{L}0-9]"}
FEW_WORDS = 20


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows (source, lang, version, docs, tokens) of changes.

    changes: `new` and `old`, each a struct (source, lang, version, tokens) or null: an
    insert has only new, a delete only old, a revision both.
    """
    side = lambda c, sign: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{k}").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), (sign * F.col(f"{c}.tokens")).cast("long").alias("tokens")))
    rows = changes.select(F.explode(F.array_compact(F.array(side("new", 1), side("old", -1)))).alias("x")).select("x.*")
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Committed batches of additive rows under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, batch: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{batch}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(root)
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()]
        return sorted(b for b in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{b}/_SUCCESS")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """False, and no effect, if the batch has been committed before."""
        if batch in self.committed():
            return False
        signed(changes).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all committed batches; groups without documents are left out."""
        kind = "source string, lang string, version string, docs long, tokens long"
        paths = [f"{self.root}/{b}" for b in self.committed()]
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's life: four batches of inserts, the deletion of short documents, a new
    tokenizer version for all languages but English, and batch 0 sent twice."""
    docs = documents(spark, sf_dir)
    counts = staged(docs.select("doc_id", "source", "lang", *(count_tokens(F.col("text"), v).alias(v) for v in VERSIONS)))
    old, new = list(VERSIONS)
    record = lambda v: F.struct("source", "lang", F.lit(v).alias("version"), F.col(f"`{v}`").alias("tokens"))
    none = F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>")
    rollup = Rollup(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(4)), F.lit(0))
    short = F.col(f"`{old}`") < FEW_WORDS
    for k in (0, 1, 2, 3, 0):
        rollup.commit(f"insert-{k}", counts.filter(part == k).select(record(old).alias("new"), none.alias("old")))
    rollup.commit("delete-short", counts.filter(short).select(none.alias("new"), record(old).alias("old")))
    rollup.commit("revise", counts.filter(~short & ~F.col("lang").eqNullSafe("en")).select(record(new).alias("new"), record(old).alias("old")))
    return rollup.totals()


OP2_SQL = f"""
with c as (select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) a,
  len(regexp_extract_all(coalesce(text, ''), '\\pL+|[0-9]+|[^\\x20\\x09-\\x0D\\pL0-9]')) b from documents)
select source, lang, case when lang = 'en' then 'words-1' else 'words-2' end as version, count(*)::bigint as docs,
  sum(case when lang = 'en' then a else b end)::bigint as tokens
from c where a >= {FEW_WORDS} group by all
"""
