import zlib

from folio.llm.sharding import assign_shards
from tests.llm.rows import HARD, docs


def test_like_a_plain_prefix_sum(spark):
    texts = HARD * 7
    got = {r.doc_id: r for r in assign_shards(docs(spark, texts), shards=5, partitions=3).collect()}
    total = sum(len((t or "").encode()) + 8 for t in texts)
    at, slots = 0, {}
    for i, t in enumerate(texts, 1):
        size, shard = len((t or "").encode()) + 8, at * 5 // total
        slots[shard] = slots.get(shard, -1) + 1
        assert (got[i].size, got[i].text_crc32, got[i].shard, got[i].slot, got[i].first_byte) == (size, zlib.crc32((t or "").encode()), shard, slots[shard], at)
        at += size


def test_null_ids_repeats_and_empty_table(spark):
    frame = docs(spark, ["a", "b", "c"]).selectExpr("cast(null as long) doc_id", "text", "shard")
    rows = assign_shards(frame.union(frame), shards=2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert assign_shards(docs(spark, [])).count() == 0
