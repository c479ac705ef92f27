"""The k best of each query, whatever groups, shards and tiles the vectors are dealt into."""

import numpy as np
from pyspark.sql import functions as F

from changeflow.llm import topk


def rows_of(n=240, seed=3):
    """Ids that repeat, several lengths, widths of 2, 4 and 8 bytes in one table, and many equal vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        dim, scale = (2, 3, 3)[i % 3], (1, 1, 1, 1 << 9, 1 << 24)[i % 5]
        rows.append((i // 2 if i % 7 == 0 else i, [0.5] * dim if i % 4 == 0 else [float(x) for x in np.float32(rng.normal(0, scale, dim))]))
    return rows


def by_hand(rows, every, k):
    whole = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows]
    out = []
    for query_id, q in sorted({(i, v) for i, v in whole if i % every == 0}):
        scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), topk.LOW), topk.HIGH), i) for i, v in whole if i != query_id and len(v) == len(q))
        out += [(query_id, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(table, **options):
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 3 == 0, k=4, **options).collect()))


def test_groups_and_shards_of_any_size_give_the_same_rows(spark):
    rows = rows_of()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = by_hand(rows, 3, 4)
    assert got(table) == want
    assert got(table, group_bytes=4000, query_block=3, shard_rows=10, fan_in=2) == want


def test_no_vector_is_copied_per_block(spark, monkeypatch):
    """What is shuffled is each vector once and a list per query and shard, not blocks per pair of blocks."""
    plans, saved = [], topk.common.saved
    monkeypatch.setattr(topk.common, "saved", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or saved(df, name))
    got(spark.createDataFrame(rows_of(60), "vec_id long, embedding array<float>"), group_bytes=1000, query_block=2, shard_rows=8)
    assert len(plans) > 3 and not any("Join" in p or "explode" in p.lower() for p in plans)


def test_a_task_keeps_k_of_each_query_in_any_order_of_the_candidates():
    rng = np.random.default_rng(4)
    vectors, ids = rng.integers(-3, 4, (6000, 5)).astype(np.int16), rng.permutation(6000)
    queries, scores = vectors[:40], vectors[:40].astype(int) @ vectors.astype(int).T
    for order in (rng.permutation(6000), np.argsort(scores[0]), np.argsort(-ids)):      # the best last, and equal scores by falling ids
        best = topk.Best(ids[:40], queries, 4, 16)
        for n in range(0, 6000, 1500):
            best.add(ids[order[n:n + 1500]], vectors[order[n:n + 1500]])
        for q in range(40):
            want = sorted((-s, i) for s, i in zip(scores[q].tolist(), ids.tolist()) if i != ids[q])[:4]
            assert list(zip((-best.score[q]).tolist(), best.vec_id[q].tolist())) == want and best.score.shape == (40, 4)
