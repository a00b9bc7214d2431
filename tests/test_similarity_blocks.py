"""Blocks of tiles: what travels follows the rows, and links join what all pairs join."""

import numpy as np
import pytest

from chatloom.operators import similarity as S
from chatloom.operators.graph import connected_components


def _frame(spark, n, dims=6, copies=0):
    m = np.random.default_rng(n).normal(size=(n, dims))
    m[:copies] = m[0]
    return spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")


@pytest.mark.parametrize(("least", "copies"), [(0.9, 40), (0.97, 0), (0.6, 3), (1.1, 0)])
def test_links_join_what_all_pairs_join(spark, least, copies):
    rows = _frame(spark, 260, copies=copies)
    links = S.near_links(rows, "id", "v", least, block=9)
    got, want = (sorted(map(tuple, connected_components(x, "left_id", "right_id").collect())) for x in (links, S.cosine_pairs(rows, "id", "v", least, 1000)))
    assert got == want and (least > 1) == (not want)


def test_each_row_is_sent_to_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "STRIPES", 3)
    monkeypatch.setattr(S, "LEAST_TILES", 1)
    _, met = S.blocks(_frame(spark, 300), "id", "v", -1.0, (), 10)
    rows = met.collect()
    assert len(rows) <= 3 * 4 // 2 and sum(len(r["meet"]) for r in rows) >= 30 * 31 // 2
