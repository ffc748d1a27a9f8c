import zlib
from collections import defaultdict

from ponderloom.llm import sharding


def laws(rows, texts, shards):
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for k, members in by.items():
        assert 0 <= k < shards and sorted(r.slot for r in members) == list(range(len(members)))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    return [sum(r.size for r in m) for m in by.values()]


def test_near_equal_bytes_and_whole_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs, 4).collect()
    sizes = laws(rows, [r.text for r in docs.collect()], 4)
    assert max(sizes) < 1.15 * sum(sizes) / 4
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_hot_text_is_subdivided(spark):
    docs = spark.createDataFrame([(k, "hot " * 50 if k % 3 == 0 else f"text {k} " * 20) for k in range(3000)], "doc_id long, text string")
    sizes = laws(sharding.shard(docs, 8).collect(), [r.text for r in docs.collect()], 8)
    assert len(sizes) == 8 and max(sizes) < 1.03 * sum(sizes) / 8 and min(sizes) > 0.97 * sum(sizes) / 8


def test_odd_rows(odd, no_rows):
    laws(sharding.shard(odd, 16).collect(), [r.text for r in odd.collect()], 16)
    assert sharding.shard(no_rows).collect() == []


def homes(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.text_crc32].add(r.shard)
    return out


def test_groups_stay_whole_where_the_law_allows(spark):
    """200 pairs of equal texts, each 8 % of a shard: none is split, and sizes are as near as whole pairs allow."""
    docs = spark.createDataFrame([(k, f"text {k % 200:04} " * 30) for k in range(400)], "doc_id long, text string")
    rows = sharding.shard(docs, 16).collect()
    sizes = laws(rows, [r.text for r in docs.collect()], 16)
    assert all(len(h) == 1 for h in homes(rows).values())
    assert max(sizes) - min(sizes) <= 2 * rows[0].size


def test_wholly_equal_rows_are_split_by_number(spark):
    docs = spark.createDataFrame([(None, None)] * 4000 + [(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    sizes = laws(sharding.shard(docs, 8).collect(), [r.text for r in docs.collect()], 8)
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8


def test_equals_brute_force_law(spark, sf):
    """No better shard for a whole group: every split group is larger than what a shard may be over its share."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs.union(docs).union(docs), 16).collect()
    sizes = laws(rows, [r.text for r in docs.collect()] * 3, 16)
    share = sum(sizes) / 16
    bytes_of = defaultdict(int)
    for r in rows:
        bytes_of[r.text_crc32] += r.size
    assert all(len(h) == 1 or bytes_of[c] > sharding.SPARE * share for c, h in homes(rows).items())
    assert max(sizes) <= share * (1 + sharding.SPARE) + max(r.size for r in rows)


def test_deal_keeps_bytes_and_rows():
    groups = [(1, 900, 9), (2, 100, 1), (3, 300, 3), (4, 40, 4)]
    dealt, load = sharding.deal(groups, 4, 2000)
    by = defaultdict(list)
    for k, pieces in enumerate(dealt):
        for key, row, n in pieces:
            by[key] += range(row, row + n)
    assert {k: sorted(v) for k, v in by.items()} == {g[0]: list(range(g[2])) for g in groups} and sum(load) == 1340


def test_query_contract(spark, sf):
    from ponderloom.llm import queries

    got = queries.op2_sharding(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
