"""Groups as large as shards and larger."""

from collections import Counter, defaultdict

import pytest

from lodestone.llm import sharding


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_large_groups_take_as_few_shards_as_hold_them(spark, law):
    sizes = {"a": 1333, "b": 200, "c": 150, "d": 90}  # of 4000 rows; a shard holds 100
    texts = [name for name, n in sizes.items() for _ in range(n)]
    texts += [f"{i:04d}" if i % 2 else f"twin{i // 4 % 300}" for i in range(4000 - len(texts))]
    docs = spark.createDataFrame([(i * 7919 % 4001, (t * 40)[:40] + t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = defaultdict(Counter)
    loads = Counter()
    for r in sharding.shard(docs, 40, law).collect():
        found[r.text_crc32][r.shard] += 1
        loads[r.shard] += 1 if law == "rows" else r.size
    largest = sorted((sorted(c.values(), reverse=True) for c in found.values()), key=sum, reverse=True)[:4]
    assert [sum(x) for x in largest] == list(sizes.values())
    for got in largest:
        assert len(got) <= -(-sum(got) // 100) + 1
        whole = sum(got) // (100 if law == "rows" else 105)  # shorter texts than the others
        assert sum(n >= 95 for n in got) >= whole
    assert max(loads.values()) - min(loads.values()) <= (1 if law == "rows" else 200)


def test_pieces_fill_shards():
    assert sharding._pieces([(1, 25, 25), (2, 10, 5)], [10, 10, 10, 10]) == [(1, 0, 10, 0), (1, 10, 20, 1), (1, 20, 25, 2), (2, 0, 5, 3)]
    assert sharding._pieces([(1, 12, 4)], [2, 8]) == [(1, 0, 2, 1)]
