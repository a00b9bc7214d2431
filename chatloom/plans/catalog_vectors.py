"""Queries on vectors: fingerprints within a few bits, structural pools, sizes of near-duplicate clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chatloom.operators import similarity
from chatloom.operators.graph import connected_components
from chatloom.plans.catalog import _BITS, _EDGES, _REACH, COSINE, _links, query, table

NEAR_BITS = 8


@query(_BITS + f" select a.vec_id left_id, b.vec_id right_id, bit_count(xor(a.bits, b.bits))::bigint distance from b a join b on a.vec_id < b.vec_id where bit_count(xor(a.bits, b.bits)) <= {NEAR_BITS}")
def hamming_near(spark, sf_dir):
    """Few differing bits: fingerprints are joined by the bands in which they agree."""
    return similarity.hamming_pairs(table(spark, sf_dir, "embeddings").select("vec_id", similarity.sign_bits("embedding").alias("bits")), "vec_id", "bits", NEAR_BITS)


_POOLS = ("intra_session", "same_sender_cross_session", "cross_channel")


@query(_EDGES + f""", p as (select cosine, case when a.label <> b.label then 'cross_channel' when a.vec_id // 20 = b.vec_id // 20 then 'intra_session' when a.vec_id % 7 = b.vec_id % 7 then 'same_sender_cross_session' end pool
from ed join embeddings a on a.vec_id = left_id join embeddings b on b.vec_id = right_id),
n as (select unnest({list(_POOLS)}) pool), t as (select unnest([0.7, 0.8, 0.9]) t),
above as (select n.pool, string_agg(c::varchar, ',' order by t) at_or_above, sum(c) = 0 as none from (select n.pool, t, count(*) filter (cosine >= t) c from n cross join t left join p using (pool) group by all) n group by 1),
hist as (select pool, string_agg(c::varchar, ',' order by bin) histogram from (select n.pool, b.range bin, count(cosine) filter (least(floor((cosine + 1) * 10), 19) = b.range) c from n cross join range(0, 20) b left join p using (pool) group by all) group by 1)
select n.pool, (select count(*) from p where p.pool = n.pool)::bigint pair_count, at_or_above, histogram, case when none then 'EMPTY_STRUCTURAL_POOL' end warning from n join above using (pool) join hist using (pool)""")
def distractor_pools(spark, sf_dir):
    """Pairs in a session, of a sender over sessions, and over channels, apart; a pool without a near pair is flagged."""

    def pool(a, b):
        return np.where(a["label"] != b["label"], 2, np.where(a["vec_id"] // 20 == b["vec_id"] // 20, 0, np.where(a["vec_id"] % 7 == b["vec_id"] % 7, 1, -1)))

    found = similarity.pool_counts(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", pool, _POOLS, (0.7, 0.8, 0.9), ("vec_id", "label"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return found.select("pool", F.col("pairs").alias("pair_count"), joined("at_or_above").alias("at_or_above"), joined("histogram").alias("histogram"), "warning")


@query(_REACH + ", sz as (select count(*) size from comp group by component union all select 1 from embeddings where vec_id not in (select node from comp)) select size::bigint size, count(*)::bigint n from sz group by 1")
def cluster_histogram(spark, sf_dir):
    """Sizes of near-duplicate clusters, vectors without a near one counted as clusters of one."""
    parts = connected_components(_links(spark, sf_dir), "left_id", "right_id")
    every = table(spark, sf_dir, "embeddings").select("vec_id").join(parts, F.col("vec_id") == F.col("node"), "left")
    return every.groupBy(F.coalesce("component", "vec_id").alias("c")).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
