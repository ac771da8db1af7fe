from __future__ import annotations

import zlib

import pytest
from conftest import SF
from llm_tables import awkward, plain

from skylag.llm import exact_dedup, sharding
from skylag.llm.queries import QUERIES


class _Exact:
    """Greedy walk over all group ends, as the planner's blocks answer it."""

    def __init__(self, sizes):
        self.ends, total = [0], 0
        for s in sizes:
            total += s
            self.ends.append(total)

    def shards(self, capacity):
        start, n = 0, 0
        while start < self.ends[-1]:
            best = max(e for e in self.ends if e <= start + capacity)
            if best == start:
                return 10**9
            start, n = best, n + 1
        return n


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_largest_shard_is_as_small_as_can_be(spark, shards):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(docs, shards).collect()
    place = {r["doc_id"]: r["place"] for r in sharding._rows(docs).select("doc_id", "place").collect()}
    groups: dict[int, int] = {}
    for r in rows:
        groups[place[r["doc_id"]]] = groups.get(place[r["doc_id"]], 0) + r["size"]
    exact = _Exact([groups[p] for p in sorted(groups)])
    sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)]
    low, high = max(groups.values()), exact.ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if exact.shards(mid) <= shards else (mid + 1, high)
    assert max(sums) <= low and min(sums) > 0
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_equal_texts_stay_together_and_a_hot_group_is_whole(spark):
    docs = plain(spark, ["same text"] * 40 + [f"text {i}" for i in range(80)])
    rows = sharding.shard(docs, 4).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] < 40}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == 120
    others = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
    assert min(others) > 0


def test_contract_columns_of_op1(spark):
    out = QUERIES["op1_sharding"](spark, SF)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in out.collect():
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_directory_doubles_until_buckets_fit():
    weights = {0: 10, 1: 10, 1 << 15: 5, 3 << 14: 100}
    directory = exact_dedup.plan_directory(weights, 30)
    assert len(directory) == 1 << 16 or len(directory) & (len(directory) - 1) == 0
    shift = exact_dedup.DIRECTORY_BITS - (len(directory).bit_length() - 1)
    loads: dict[int, dict[int, int]] = {}
    for prefix, w in weights.items():
        loads.setdefault(directory[prefix >> shift], {})[prefix] = w
    assert all(sum(load.values()) <= 30 or len(load) == 1 for load in loads.values())
    assert exact_dedup.plan_directory({}, 30) == [0]
    assert exact_dedup.plan_directory({5: 29}, 30) == [0]


def test_many_buckets_give_the_same_groups(spark):
    texts = [f"copy {i % 7}" for i in range(60)] + [f"lone {i}" for i in range(30)] + [None, ""]
    docs = plain(spark, texts)
    seen = {r["doc_id"]: r for r in exact_dedup.duplicates(docs, bucket_bytes=40).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (seen[i]["keep_id"], seen[i]["group_size"], seen[i]["kept"]) == (max(same), len(same), i == max(same))
    assert exact_dedup.Index(docs, bucket_bytes=40).depth > 0
    kept = exact_dedup.deduplicate(docs, bucket_bytes=40).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i in seen if seen[i]["kept"])


def test_repeated_rows_keep_exactly_one(spark):
    docs = awkward(spark)
    rows = exact_dedup.duplicates(docs).collect()
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    kept = exact_dedup.deduplicate(docs).collect()
    assert len(kept) == len({(r["text"] or "") for r in docs.collect()})
