import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lathework.llm.packing import Capacity, fill_contexts, pack_classes


def check(rows, sizes, capacity, loss=None):
    tokens, segments, most_loss = capacity.vector
    used, seen, parts = defaultdict(lambda: [0, 0, 0]), defaultdict(list), defaultdict(int)
    for r in rows:
        bears = loss is None or loss[r.doc_id]
        # a piece over the allowance takes all of it and is not cut
        assert r.loss == (min(r.tokens, most_loss) if bears else 0)
        for i, v in enumerate((r.tokens, 1, r.loss)):
            used[r.context_no][i] += v
        seen[r.doc_id].append((r.first_token, r.tokens))
        parts[r.doc_id] += 1
    for u in used.values():
        assert u[0] <= tokens and u[1] <= segments and u[2] <= most_loss
    assert set(seen) == set(sizes)
    for doc, spans in seen.items():
        spans.sort()
        assert sum(s for _, s in spans) == (sizes[doc] or 0)
        at = 0
        for first, size in spans:
            assert first == at
            at += size
        if (sizes[doc] or 0) <= tokens:
            assert len(spans) == 1
    return used


def test_limits_hold_and_little_room_is_left(spark):
    rnd = random.Random(5)
    sizes = {i: rnd.choice([0, 1, 5, 60, 200, 300, 900, 1100, 5000, None]) if i % 3 else rnd.randint(1, 2000) for i in range(3000)}
    frame = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens int")
    capacity = Capacity(2048, 64)
    used = check(fill_contexts(frame, capacity, shard_items=700).collect(), sizes, capacity)
    total = sum(v or 0 for v in sizes.values())
    assert len(used) <= np.ceil(total / 2048) * 1.03 + 2


def test_three_limits(spark):
    rnd = random.Random(6)
    sizes = {i: rnd.randint(1, 120) for i in range(800)}
    loss = {i: i % 2 == 0 for i in sizes}
    frame = spark.createDataFrame([(i, s, loss[i]) for i, s in sizes.items()], "doc_id long, tokens int, bears boolean")
    capacity = Capacity(100, 4, 40)
    check(fill_contexts(frame, capacity, bears_loss=F.col("bears"), shard_items=300).collect(), sizes, capacity, loss)


def test_each_limit_can_bind_and_is_filled(spark):
    """Whichever limit is scarce, contexts are few: near the bound that the scarce one sets."""
    rnd = random.Random(8)
    sizes = {i: rnd.randint(1, 400) for i in range(2500)}
    loss = {i: i % 3 == 0 for i in sizes}
    frame = spark.createDataFrame([(i, s, loss[i]) for i, s in sizes.items()], "doc_id long, tokens int, bears boolean")
    whole, bearing = sum(sizes.values()), sum(s for i, s in sizes.items() if loss[i])
    for capacity in (Capacity(2000, 64, 1800), Capacity(2000, 64, 450), Capacity(2000, 5, 1800)):
        rows = fill_contexts(frame, capacity, bears_loss=F.col("bears"), shard_items=400).collect()
        used = check(rows, sizes, capacity, loss)
        least = max(whole / capacity.tokens, len(sizes) / capacity.segments, bearing / capacity.loss_tokens)
        assert len(used) <= least * 1.06 + 2


def test_second_pass_is_sharded_too(spark):
    """Nothing closes when segments bind alone, so every item is packed twice; still no shard is larger than asked for."""
    frame = spark.range(4000).selectExpr("id AS doc_id", "1 AS tokens")
    rows = fill_contexts(frame, Capacity(1000, 7, 1000), shard_items=500, closed_at=2.0).collect()
    shards = defaultdict(int)
    for r in rows:
        shards[r.context_no >> 32] += 1
    assert len(rows) == 4000 and max(shards.values()) < 1000
    assert len({r.context_no for r in rows}) <= 4000 / 7 + len(shards)


def test_empty_and_null(spark):
    frame = spark.createDataFrame([], "doc_id long, tokens int")
    assert fill_contexts(frame, Capacity(10)).collect() == []
    one = spark.createDataFrame([(None, None)], "doc_id long, tokens int")
    (row,) = fill_contexts(one, Capacity(10)).collect()
    assert row.tokens == 0 and row.context_no is not None


def test_classes_use_every_item_once():
    demand = np.array([[10, 1, 10], [4, 1, 0], [3, 1, 3]])
    count = np.array([3, 7, 5])
    contexts = pack_classes(demand, count, (12, 3, 12))
    placed = np.zeros(3, int)
    for content in contexts:
        total = sum(demand[k] * t for k, t in content)
        assert (total <= (12, 3, 12)).all()
        for k, t in content:
            placed[k] += t
    assert (placed == count).all()
