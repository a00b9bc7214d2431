from chatloom.operators import inverted as I


def test_segments_hold_bounded_postings_and_answers_stay(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 7 + j}" for j in range(9))) for k in range(600)], "id long, t string").coalesce(1)
    asked = spark.createDataFrame([(1, "w3 w4"), (2, "w14 w1")], "q long, t string")
    answers = lambda: sorted(map(tuple, I.best(docs, asked, "id", "t", "q", "t", 5).collect()))
    want = answers()
    monkeypatch.setattr(I, "HELD", 900)
    found = I.segments(docs, None, "id", "t").filter("term <> ''").selectExpr("segment", "size(tfs) as n").groupBy("segment").sum("n").collect()
    assert len(found) == 6 and all(r[1] <= 900 for r in found) and answers() == want
