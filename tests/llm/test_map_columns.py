"""Columns that Spark cannot order pass the near-duplicate stage unharmed."""

from pyspark.sql import functions as F

from chatloom.llm import near_copies as N
from chatloom.llm import simhash as S

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_maps_are_kept(spark):
    rows = spark.createDataFrame([(1, TEXT, 5), (2, TEXT, 6), (1, "alpha beta gamma delta epsilon zeta eta", 7), (1, TEXT, 4), (3, "something else altogether is written here today", 1), (None, TEXT, 9)], "doc_id long, text string, n int")
    rows = rows.withColumns({"m": F.create_map(F.lit("k"), F.col("n")), "deep": F.array(F.struct(F.create_map(F.lit("k"), F.col("n")).alias("x"))), "null_map": F.lit(None).cast("map<string,int>")})
    for stage in (N.without_near_copies, S.without_near_duplicates):
        got = stage(rows)
        assert got.schema.simpleString() == rows.schema.simpleString()
        assert sorted((str(r["doc_id"]), r["n"], r["m"]["k"], r["deep"][0]["x"]["k"]) for r in got.collect()) == [("1", 7, 7, 7), ("3", 1, 1, 1), ("None", 9, 9, 9)]
