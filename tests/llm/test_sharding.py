import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sharding


def brute(sizes, shards):
    loads = [0] * shards
    for size, n in sorted(sizes, reverse=True):
        for _ in range(n):
            loads[loads.index(min(loads))] += size
    return sorted(loads)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_lpt_is_the_greedy_schedule(sizes, shards):
    plan, loads = sharding.lpt(list(sizes.items()), shards)
    assert sorted(loads) == brute(list(sizes.items()), shards)
    assert {s: sum(g) for s, g in plan} == sizes


def check(rows, texts):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    where, slots = defaultdict(set), defaultdict(list)
    by_id = dict(texts)
    for r in rows:
        where[by_id[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.size == len((by_id[r.doc_id] or "").encode()) + 1
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_groups_stay_together(frame):
    draw = random.Random(1)
    texts = [(i, draw.choice(["same"] * 3 + ["x" * draw.randrange(60), "é" * draw.randrange(9), "", None])) for i in range(150)]
    check(sharding.assign(frame(texts)).collect(), texts)


def test_sizes_are_near_equal(sample):
    load = Counter()
    for r in sharding.assign(sample).collect():
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 8


def test_empty_and_repeated(frame):
    assert sharding.assign(frame([])).collect() == []
    rows = sharding.assign(frame([(7, "a"), (7, "a"), (7, "b"), (None, "c")])).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.text_crc32 == rows[0].text_crc32}) == 1
