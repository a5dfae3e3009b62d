import zlib
from collections import Counter, defaultdict

from tidebars.llm import sharding

from .conftest import odd_rows


def check(rows, texts, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(texts) and max(counts) - min(counts) <= 1
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_counts_even_and_groups_whole(spark):
    texts = [(i, f"text {i}") for i in range(600)] + [(1000 + i, f"group {i % 60}") for i in range(240)]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 8).collect()
    check(rows, texts, 8)
    where = defaultdict(set)
    for r in rows:
        where[r.g].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) <= 3


def test_group_beyond_a_quota(spark):
    texts = [(i, "all the same") for i in range(90)] + [(100 + i, f"own {i}") for i in range(70)]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string"), 8).collect()
    check(rows, texts, 8)
    # 90 rows of one text need five shards of 20 at least
    same = Counter(r.g for r in rows).most_common(1)[0][0]
    assert len({r.shard for r in rows if r.g == same}) <= 6


def test_small_groups_beside_a_hot_one(spark):
    texts = [(i, "hot text") for i in range(1500)] + [(2000 + i, f"group {i % 300}") for i in range(1200)] + [(4000 + i, f"own {i}") for i in range(900)]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), 24).collect()
    check(rows, texts, 24)
    where, sizes = defaultdict(set), Counter(r.g for r in rows)
    for r in rows:
        where[r.g].add(r.shard)
    hot = sizes.most_common(1)[0][0]
    assert len(where.pop(hot)) == 10      # quota 150
    assert sum(len(w) > 1 for w in where.values()) <= 6


def test_fewer_rows_than_shards_and_one_text_only(spark):
    for n in (5, 24, 50, 71):
        texts = [(i, "same") for i in range(n)]
        check(sharding.assign(spark.createDataFrame(texts, "doc_id long, text string"), 24).collect(), texts, 24)


def test_odd_and_empty_tables(spark, odd, none):
    check(sharding.report(odd).collect(), [r[:2] for r in odd_rows()], 24)
    assert sharding.report(none).count() == 0
