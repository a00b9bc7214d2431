"""Pruned cosine joins, counts in tiles and Hamming joins by bands against all pairs."""

import numpy as np
import pytest

from chatloom.operators import similarity as S


def _vectors(seed, clusters, each, spread, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    m = (centres[:, None, :] + spread * r.normal(size=(clusters, each, dims))).reshape(-1, dims)
    return r.permutation(m)


def _frame(spark, m):
    return spark.createDataFrame([(k, v.tolist(), int(k % 5)) for k, v in enumerate(m)], "id long, v array<double>, label int")


def _cosines(m):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return u @ u.T


@pytest.mark.parametrize(("least", "block"), [(0.9, 20), (0.4, 50), (0.9, 5000), (-0.2, 37)])
def test_cosine_join_equals_all_pairs(spark, least, block):
    m = _vectors(1, 40, 10, 0.05)
    m[7] = 0
    c = _cosines(m)
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if c[i, j] >= least}
    got = [(r["left_id"], r["right_id"]) for r in S.cosine_pairs(_frame(spark, m), "id", "v", least, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_tiles_meet_on_clustered_data(spark):
    m = _vectors(2, 60, 20, 0.03)
    rows = _frame(spark, m).repartition(3)
    dealt, pairs = S.tiles(rows, "id", "v", 0.9, (), 20)
    n = dealt.select("tile").distinct().count()
    assert pairs.count() < n * (n + 1) / 2 / 10 and dealt.count() == len(m)
    assert max(r["count"] for r in dealt.groupBy("tile").count().collect()) <= 20


def test_counts_in_tiles_equal_counts_over_all_pairs(spark):
    m = _vectors(3, 12, 12, 0.4, 64)
    c, n = _cosines(m), len(m)
    upper = np.triu_indices(n, 1)
    rows = _frame(spark, m).withColumn("bits", S.sign_bits("v"))
    bits = np.array([sum(1 << k for k, x in enumerate(v) if x > 0) for v in m], np.uint64)
    far = np.bitwise_count(bits[:, None] ^ bits[None, :])[upper]
    got = S.measure_counts(rows, "id", "v", "bits", 0.5, 12, block=25).first()
    assert tuple(got) == tuple(int(x.sum()) for x in (c[upper] >= 0.5, far <= 12, (c[upper] >= 0.5) & (far <= 12), (c[upper] >= 0.5) | (far <= 12)))
    want = np.bincount(np.minimum(np.floor((c[upper] + 1) * 10), 19).astype(int), minlength=20)
    assert [r["n"] for r in S.cosine_histogram(rows, "id", "v", block=25).orderBy("bin").collect()] == want.tolist()
    label = np.arange(n) % 5
    same = (label[:, None] == label[None, :])[upper]
    pools = {r["pool"]: r for r in S.pool_counts(rows, "id", "v", lambda a, b: np.where(a["label"] == b["label"], 0, 1), ("same", "other", "none"), (0.5, 2.0), ("label",), block=25).collect()}
    assert [pools[p]["pairs"] for p in ("same", "other", "none")] == [int(same.sum()), int((~same).sum()), 0]
    assert pools["same"]["at_or_above"] == [int((c[upper][same] >= 0.5).sum()), 0] and sum(pools["other"]["histogram"]) == int((~same).sum())
    assert [pools[p]["warning"] for p in ("same", "none")] == [None, "EMPTY_STRUCTURAL_POOL"]
    empty = rows.filter("id < 0")
    assert S.cosine_pairs(empty, "id", "v", 0.5).count() == 0 and S.measure_counts(empty, "id", "v", "bits", 0.5, 12).first()["edges"] == 0


@pytest.mark.parametrize("most", [0, 1, 4, 8, 18])
def test_hamming_join_equals_all_pairs(spark, most):
    r = np.random.default_rng(5)
    fp = r.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    flips = [x ^ np.int64(sum(1 << int(b) for b in r.choice(63, r.integers(0, 10), replace=False))) for x in fp for _ in range(4)]
    every = np.concatenate([fp, np.array(flips, np.int64), fp[:5], np.zeros(9, np.int64), np.full(3, -1)])
    far = np.bitwise_count((every[:, None] ^ every[None, :]).view(np.uint64))
    want = {(i, j, int(far[i, j])) for i in range(len(every)) for j in range(i + 1, len(every)) if far[i, j] <= most}
    rows = spark.createDataFrame([*((k, int(x)) for k, x in enumerate(every)), (10_000, None)], "id long, fp long")
    got = [tuple(x) for x in S.hamming_pairs(rows, "id", "fp", most, block=50).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if most in (4, 8):
        for k in (1, 2):
            bands = most + k
            cuts = [64 * j // bands for j in range(bands + 1)]
            masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
            again = [tuple(x) for x in S._by_bands(rows.filter("fp is not null"), most, masks, k).collect()]
            assert len(again) == len(set(again)) and set(again) == want


def test_bands_follow_the_number_of_fingerprints():
    few, many = S.band_plan(1000, 4), S.band_plan(1 << 34, 4)
    assert few[1] == 1 and many[1] > 1 and len(many[0]) == 4 + many[1] and S.band_plan(1000, 18) is None
    assert sum(many[0]) == (1 << 64) - 1


def test_top_k_equals_a_plain_sort(spark):
    m = _vectors(6, 10, 30, 0.3)
    m[11] = m[12]
    rows = _frame(spark, m).repartition(4)
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in S.vector_top_k(rows, rows.filter("id % 50 = 0"), "id", "id", "v", 7, most_queries=2).collect())
    c = np.round(_cosines(m), 6)
    want = [(q, n + 1, i) for q in range(0, 300, 50) for n, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-c[q, i], i))[:7])]
    assert got == sorted(want)
