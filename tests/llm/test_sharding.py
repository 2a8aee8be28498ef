import random
from collections import defaultdict
from itertools import product

import numpy as np

from plumbline.llm import sharding

from .helpers import awkward, documents, empty


def test_two_way_differencing_follows_the_rule():
    partials = np.zeros((5, 2), np.int64)
    partials[:, 0] = [8, 7, 6, 5, 4]  # 1, 1, then 4 against them: the textbook differences leave 2
    sums, place = sharding.difference(partials)
    assert sums.tolist() == [16, 14]
    assert sorted(sum(v for v, p in zip([8, 7, 6, 5, 4], place[:, 0]) if p == k) for k in (0, 1)) == [14, 16]


def test_many_way_differencing_is_consistent_and_tight():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 10_000, 500)
    partials = np.zeros((500, 7), np.int64)
    partials[:, 0] = values
    sums, place = sharding.difference(partials)
    assert sums.tolist() == sorted((int(values[place[:, 0] == k].sum()) for k in range(7)), reverse=True)
    assert sums[0] - sums[-1] <= 50
    assert all(sorted(row) == list(range(7)) for row in place)


def test_small_case_near_the_best():
    values = [9, 8, 7, 5, 4, 3]
    best = min(max(sums) - min(sums) for pick in product(range(3), repeat=6) for sums in [[sum(v for v, p in zip(values, pick) if p == k) for k in range(3)]])
    partials = np.zeros((6, 3), np.int64)
    partials[:, 0] = values
    sums, _ = sharding.difference(partials)
    assert sums[0] - sums[-1] <= best + 2


def test_shards_of_documents(spark):
    rng = random.Random(2)
    texts = [(i, "x" * rng.randint(1, 400) + str(i)) for i in range(300)] + [(1000 + i, "same text") for i in range(40)] + [(2000 + i, None) for i in range(3)]
    for fan_in, most in ((4096, 64), (16, 300)):  # one level, and three
        rows = sharding.shard(documents(spark, texts), n_shards=8, fan_in=fan_in, keep=("lang",)).collect()
        assert len(rows) == len(texts) and {r.lang for r in rows} == {"en"}
        total, where, slots = defaultdict(int), defaultdict(set), defaultdict(list)
        text = dict(texts)
        for r in rows:
            assert r.size == len((text[r.doc_id] or "").encode()) + 16
            total[r.shard] += r.size
            where[text[r.doc_id]].add(r.shard)
            slots[r.shard].append(r.slot)
        assert all(len(x) == 1 for x in where.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= most


def test_awkward_tables(spark):
    assert sharding.shard(empty(spark)).count() == 0
    rows = sharding.shard(awkward(spark), n_shards=3).collect()
    assert len(rows) == 10 and len({r.shard for r in rows if r.size == 16 and r.doc_id == 2 or r.size == 16 and r.doc_id is None}) == 1


def test_whole_rows_go_to_their_shards(spark):
    docs = awkward(spark)
    found = sharding.sharded(docs, n_shards=3)
    assert found.columns == [{"size": "size_input", "shard": "shard_input", "slot": "slot_input"}.get(c, c) for c in docs.columns] + list(sharding.ADDED)
    rows = found.collect()
    plain = sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, n_shards=3).collect())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.slot) for r in rows) == plain
    assert sorted((r.doc_id or -1, r.text or "") for r in rows) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert all(r.size == len((r.text or "").encode()) + 16 and r.size_input == "x" for r in rows)
    assert sharding.sharded(empty(spark)).count() == 0
