"""The matrix and trace data sources: round trips, torn writes, errors of shape, id and place."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.sources import tables


@pytest.fixture()
def sources(spark):
    spark.dataSource.register(tables.MatrixSource)
    spark.dataSource.register(tables.TraceSource)
    return spark


def _matrix(tmp_path, m, ids, name="m"):
    np.save(tmp_path / f"{name}.npy", m)
    (tmp_path / f"{name}_index.json").write_text(json.dumps(ids))
    return str(tmp_path / f"{name}.npy")


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_matrix_is_read_by_ranges(sources, tmp_path, kind):
    m = np.random.default_rng(1).normal(size=(103, 7)).astype(kind)
    path = _matrix(tmp_path, m, [f"media_{k}" for k in range(103)])
    rows = sources.read.format("matrix").option("rows", 10).load(path)
    assert rows.rdd.getNumPartitions() == 11
    got = rows.orderBy("place").collect()
    assert [r["id"] for r in got] == [f"media_{k}" for k in range(103)] and np.array_equal(np.array([r["vector"] for r in got], np.float32), m.astype(np.float32))
    assert sources.read.format("matrix").load(f"file://{path}").filter("id = 'media_5'").count() == 1
    assert sources.read.format("matrix").load(_matrix(tmp_path, np.zeros((0, 3)), [], "none")).count() == 0


def test_matrix_errors(sources, tmp_path):
    m = np.zeros((4, 2), np.float32)
    read = lambda path: sources.read.format("matrix").load(path).count()
    with pytest.raises(Exception, match="3 ids"):
        read(_matrix(tmp_path, m, ["a", "b", "c"], "few"))
    with pytest.raises(Exception, match="of them different"):
        read(_matrix(tmp_path, m, ["a", "b", "c", "c"], "twice"))
    with pytest.raises(Exception, match="row order"):
        read(_matrix(tmp_path, np.zeros(4), list("abcd"), "flat"))
    torn = _matrix(tmp_path, m, list("abcd"), "torn")
    with open(torn, "r+b") as f:
        f.truncate(os.path.getsize(torn) - 4)
    with pytest.raises(Exception, match="bytes of numbers"):
        read(torn)


def _records(spark, a, b, **other):
    rows = spark.range(a, b).select(F.col("id").alias("pos"), F.lit("q").alias("query_id"), F.format_string("e%d", "id").alias("event_id"), F.lit("round").alias("record_type"), F.lit("payload é\n").alias("payload"))
    return rows.withColumns(other).repartition(3)


def test_trace_goes_on_where_it_ended(sources, tmp_path):
    path = str(tmp_path / "trace")
    save = lambda rows: rows.write.format("trace").mode("append").save(path)
    read = lambda: sorted(r["pos"] for r in sources.read.format("trace").load(path).collect())
    save(_records(sources, 0, 20))
    save(_records(sources, 20, 31))
    save(_records(sources, 31, 31))
    assert read() == list(range(31)) and len(tables.commits(path)) == 2
    assert sources.read.format("trace").load(path).filter("pos = 7").first()["payload"] == "payload é\n"
    for wrong in (_records(sources, 40, 45), _records(sources, 30, 35), _records(sources, 31, 40).filter("pos <> 35"), _records(sources, 31, 33, payload=F.lit("Bearer abc")), _records(sources, 31, 33, event_id=F.lit(None).cast("string"))):
        with pytest.raises(Exception):  # noqa: B017  Spark wraps it
            save(wrong)
        assert read() == list(range(31))
    (tmp_path / "trace" / "records" / "torn.jsonl").write_text('{"pos": 31, ')  # a writer that was lost
    (tmp_path / "trace" / "_commits" / "000000000002.tmp").write_text("{")
    assert read() == list(range(31))
    save(_records(sources, 31, 33))
    assert read() == list(range(33))
    with pytest.raises(Exception, match="overwritten"):
        _records(sources, 33, 34).write.format("trace").mode("overwrite").save(path)
