"""Fixed fixtures, edge cases and seeded random inputs against plain Python."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.functions import hash_mod, hash_offset, hash_polynomial, hash_universal, murmur3, slab_buckets
from grainmill.operators import aggregate, join, membership, ordering, project, report, scan

MAX32 = 2**32 - 1



def pairs(seed, n, keys, values):
    """Seeded (key, value) rows; few keys, so many have duplicates."""
    r = random.Random(seed)
    return [(r.randint(0, keys), r.randint(0, values)) for _ in range(n)]


JOIN_A, JOIN_B = pairs(11, 9, 8, 9), pairs(12, 9, 8, 9)
JOINED = [(k, v, w) for k, v in JOIN_A for m, w in JOIN_B if k == m]
GROUPED = pairs(13, 60, 8, 100)
SUMS = Counter()
for _k, _v in GROUPED:
    SUMS[_k] += _v


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("strategy", [None, "broadcast", "shuffle_hash", "merge"])
def test_join_fixture_in_all_variants(spark, strategy):
    a, b = frame(spark, JOIN_A, "k long, va long"), frame(spark, JOIN_B, "k long, vb long")
    assert bag(join.inner_join(a, b, "k", strategy)) == Counter(JOINED)


def test_nested_loop_join_fixture(spark):
    a, b = frame(spark, JOIN_A, "k long, va long"), frame(spark, JOIN_B, "k2 long, vb long")
    assert bag(join.nested_loop_join(a, b, "k", "k2").select("k", "va", "vb")) == Counter(JOINED)


def test_nested_loop_join_compares_blocks_on_all_cores(spark):
    b = spark.range(0, 5000, 1, 1).selectExpr("if(id < 4000, 0, id % 3) k2", "id DIV 2 vb")
    parts = join.blocks(b, F.col("k2"), "k", "rows", 100)
    assert parts.count() <= 53 and parts.agg(F.max(F.size("rows")), F.sum(F.size("rows"))).first() == (100, 5000)
    out = join.nested_loop_join(spark.range(0, 40, 1, 1).selectExpr("id % 5 k", "id va"), b, "k", "k2")
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.columns == ["k", "va", "k2", "vb"]
    want = Counter((i % 5, i, k, j // 2) for i in range(40) for j in range(5000) if (k := 0 if j < 4000 else j % 3) == i % 5)
    assert bag(out) == want


def test_nested_loop_join_of_odd_keys_and_names(spark):
    nan = float("nan")
    a = frame(spark, [(None, 1), (0.0, 2), (nan, 3), (2.0, 4), (2.0, 4)], "k double, block_key int")
    b = frame(spark, [(None, {1: 1}), (-0.0, {1: 2}), (nan, None), (2.0, {}), (2.0, {})], "k2 double, block_rows map<int,int>")
    out = join.nested_loop_join(a, b, "k", "k2")
    assert Counter((x, None if m is None else len(m)) for _, x, _, m in out.collect()) == Counter({(2, 1): 1, (3, None): 1, (4, 0): 4})
    assert join.nested_loop_join(a.limit(0), b, "k", "k2").count() == join.nested_loop_join(a, b.limit(0), "k", "k2").count() == 0
    strings = frame(spark, [("2",), ("3",)], "k2 string")
    assert join.nested_loop_join(a, strings, "k", "k2").count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 1000])
def test_random_joins_agree(spark, n):
    r = random.Random(n)
    a = [(r.choice([0, MAX32, r.randint(0, n)]), i) for i in range(n)]
    b = [(r.choice([0, MAX32, r.randint(0, n)]), i) for i in range(n // 8)]
    x, y = frame(spark, a, "k long, va long"), frame(spark, b, "k long, vb long")
    want = Counter((k, v, w) for k, v in a for m, w in b if k == m)
    got = [join.inner_join(x, y, "k", s) for s in (None, "shuffle_hash", "merge")]
    assert bag(got[0]) == want and all(join.same_bag(got[0], g) for g in got[1:])


def test_one_to_many_keeps_misses_and_duplicates(spark):
    build = frame(spark, [(1, 10, 0), (1, 11, 1), (2, 5, 2)], "k long, v long, id long")
    probe = frame(spark, [(1,), (3,), (1,), (None,)], "k long")
    assert bag(join.one_to_many(probe, build, "k", "v")) == Counter({(1, 2, 21): 2, (3, 0, 0): 1, (None, 0, 0): 1})
    got = Counter((r["k"], tuple(r["ids"])) for r in join.one_to_many_ids(probe, build, "k", "id").collect())
    assert got == Counter({(1, (0, 1)): 2, (3, ()): 1, (None, ()): 1})


def test_first_match_takes_the_least_order(spark):
    build = frame(spark, [(1, 1, 0), (1, 5, 1), (4, 55, 2)], "k long, v long, id long")
    got = join.first_match(frame(spark, [(1,), (4,), (9,)], "k long"), build, "k", "v", "id")
    assert bag(got) == Counter([(1, 1), (4, 55)])


def test_membership_with_misses_and_extreme_keys(spark):
    build = frame(spark, [(1,), (65,), (129,), (193,), (4,), (0,), (MAX32,), (65,)], "k long")
    probe = frame(spark, [(1,), (65,), (64,), (4,), (129,), (193,), (0,), (MAX32,), (MAX32 - 1,)], "k long")
    assert bag(membership.members(probe, build, "k")) == Counter((k,) for k in [1, 65, 4, 129, 193, 0, MAX32])
    assert bag(membership.strangers(probe, build, "k")) == Counter([(64,), (MAX32 - 1,)])
    assert {r["k"] for r in membership.flags(probe, build, "k").where("found").collect()} == {1, 65, 4, 129, 193, 0, MAX32}
    assert membership.flags(probe, build, "k").count() == 9
    assert membership.build_set(build, "k").count() == 7 and membership.build_multiset(build, "k").count() == 8


def test_group_sum_fixture_in_all_variants(spark):
    df = frame(spark, GROUPED, "k long, v int")
    want = Counter(SUMS.items())
    assert bag(aggregate.group_sum(df, "k", "v")) == want
    assert bag(aggregate.group_sum_two_phase(df, "k", "v", 7)) == want
    assert bag(aggregate.upsert_add(df, "k", "v")) == want
    dense = aggregate.group_sum_dense(df, "k", F.col("v"), 12)
    assert bag(dense) == Counter((k, SUMS[k]) for k in range(12))
    clashing = df.withColumn("slice", F.lit(1)).withColumn("part", F.lit(2))
    assert bag(aggregate.group_sum_two_phase(clashing, "slice", "v", 3)) == Counter([(1, sum(SUMS.values()))])


def test_sums_widen_and_wrap(spark):
    df = frame(spark, [(1, 2**31 - 1)] * 4, "k int, v int")
    assert bag(aggregate.group_sum(df, "k", "v")) == Counter([(1, 4 * (2**31 - 1))])
    assert bag(aggregate.group_sum_wrap32(df, "k", F.col("v").cast("long"))) == Counter([(1, 4 * (2**31 - 1) % 2**32)])
    assert aggregate.reduce_sum(df, "v").first()["s"] == 4 * (2**31 - 1)
    assert aggregate.reduce_sum(df.limit(0), "v").first()["s"] == 0
    assert bag(project.vector_add(df.limit(1), "v", "v").select("total")) == Counter([(2**32 - 2,)])


def test_upsert_last_and_fold(spark):
    df = frame(spark, [(1, 5, 0), (1, 7, 2), (1, 6, 1), (2, 9, 0)], "k long, v long, seq long")
    assert bag(aggregate.upsert_last(df, "k", "v", "seq")) == Counter([(1, 7), (2, 9)])
    folded = aggregate.fold(df, "k", "v", F.lit(0).cast("long"), lambda a, b: a * 10 + b, "seq")
    assert bag(folded) == Counter([(1, 567), (2, 9)])


@pytest.mark.parametrize("n", [0, 1, 2, 128, 1000])
def test_sort_and_row_numbers(spark, n):
    r = random.Random(n)
    rows = [(r.choice([-5, 0, 3, r.randint(-10000, 10000)]), i) for i in range(n)]
    df = frame(spark, rows, "x long, id long")
    assert [tuple(x) for x in ordering.sort_ascending(df, "x", "id").collect()] == sorted(rows)
    got = [(x["x"], x["id"]) for x in sorted(ordering.row_numbers(df, ["x", "id"], buckets=8).collect(), key=lambda x: x["rn"])]
    assert got == sorted(rows)
    assert sorted(x["rn"] for x in ordering.row_numbers(df, ["x", "id"], buckets=8).collect()) == list(range(1, n + 1))


def test_row_numbers_of_strings_nulls_and_clashing_names(spark):
    r = random.Random(3)
    rows = [(r.choice([None, "", "a", "é", "zz"]), i, i) for i in range(300)]
    df = frame(spark, rows, "bucket string, inside long, found long")
    got = [(x["bucket"], x["inside"]) for x in sorted(ordering.row_numbers(df, ["bucket", "inside"], buckets=5).collect(), key=lambda x: x["rn"])]
    assert got == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    frequent = frame(spark, [("same", i) for i in range(500)], "x string, id long")
    for buckets in (10, 50):
        parts = ordering._in_buckets(frequent, ["x", "id"], buckets, "b").groupBy("b").count().collect()
        assert len(parts) == buckets and max(p["count"] for p in parts) < 2000 / buckets  # one value is cut by the next key
        many = ordering.row_numbers(df, ["bucket", "inside"], buckets=buckets).collect()
        assert [(x["bucket"], x["inside"]) for x in sorted(many, key=lambda x: x["rn"])] == got


def test_prefix_sum(spark):
    values = [v for _, v in pairs(5, 40, 1, 3)]
    df = frame(spark, list(enumerate(values)), "i long, v long")
    before = list(itertools.accumulate(values, initial=0))
    got = ordering.prefix_sum(df, "i", "v", buckets=3)
    assert [r["before"] for r in sorted(got.collect(), key=lambda r: r["i"])] == before[:-1]
    got = ordering.prefix_sum(df, "i", "v", buckets=3, inclusive=True, initial=10)
    assert [r["before"] for r in sorted(got.collect(), key=lambda r: r["i"])] == [10 + b for b in before[1:]]
    assert ordering.prefix_sum(df.limit(0), "i", "v").count() == 0


def test_scan_keeps_the_tail(spark):
    df = frame(spark, [(i, i % 10) for i in range(1003)] + [(2000, None)], "i long, x int")
    assert bag(scan.scan_less_than(df, "x", 5)) == Counter((i, i % 10) for i in range(1003) if i % 10 < 5)
    got = scan.compaction_offsets(df.where("i < 1003"), F.expr("i div 100"), F.col("x") < 5)
    rows = sorted(map(tuple, got.collect()))
    assert [r[1] for r in rows] == [50] * 10 + [3] and [r[2] for r in rows] == [50 * k for k in range(11)]


def test_layout_round_trip(spark):
    df = frame(spark, [*JOIN_A, (3, None)], "k long, va long")
    columns = project.to_columns(project.to_rows(df, F.col("k") % 2), ["k", "va"])
    assert all(len(r["k"]) == len(r["va"]) for r in columns.collect()) and columns.count() == 2
    assert bag(project.flat(columns, ["k", "va"])) == Counter([*JOIN_A, (3, None)])
    assert bag(project.constant(df.select("k"))) == Counter((k, 42) for k, _ in [*JOIN_A, (3, None)])
    zipped = spark.range(1).select(project.zip_columns(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(3), F.lit(4)).alias("b")).alias("z")).first()["z"]
    assert [tuple(x) for x in zipped] == [(1, 3), (2, 4)]


def _murmur(key, seed):
    rotl = lambda a, n: (a << n | a >> 32 - n) & MAX32
    h = seed
    for word in (key & MAX32, key >> 32):
        h = (rotl(h ^ rotl(word * 0xCC9E2D51 & MAX32, 15) * 0x1B873593 & MAX32, 13) * 5 + 0xE6546B64) & MAX32
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & MAX32
    h = (h ^ h >> 13) * 0xC2B2AE35 & MAX32
    return h ^ h >> 16


def test_hash_functions(spark):
    keys = [0, 1, 9, 10, 12345, MAX32]
    df = frame(spark, [(k,) for k in keys], "k long")
    k = F.col("k")
    got = df.select("k", hash_mod(k, 7), hash_offset(k, 7, 3), hash_universal(k, 242792921, 653019598, 2147483647, 100), hash_polynomial(k, 1009, 7)).collect()
    for row in got:
        x = row[0]
        digits = [int(c) for c in reversed(str(x))]
        assert tuple(row)[1:] == (x % 7, (x % 7 + 3) % 7, ((242792921 * x + 653019598) % 2147483647) % 100, sum(d * 7 ** (i + 1) for i, d in enumerate(digits)) % 1009)
    seeded = [r[0] for r in df.select(murmur3(k, 42), murmur3(k, 1)).collect()]
    assert seeded == [r[0] % (1 << 32) for r in df.select(F.hash("k")).collect()]
    assert [r[0] for r in df.select(murmur3(k, 2)).collect()] == [_murmur(x, 2) for x in keys] and seeded == [_murmur(x, 42) for x in keys]
    assert slab_buckets(1000, 60) == 50 and slab_buckets(1000, 99) == 31 and slab_buckets(640, 50) == 36


def test_trimmed_mean_drops_all_ties(spark):
    df = frame(spark, [(1, "a", 5), (1, "a", 9), (1, "a", 9), (1, "a", 1), (1, "b", 2), (2, "a", 4), (2, "a", 6)], "size long, device string, t long")
    got = report.trimmed_mean(df, "size", "device", "t", ["a", "b"])
    assert bag(got) == Counter([(1, 3.0, None), (2, 4.0, None)])
    rows = [(i % 3, "ab"[i % 2], v) for i, (_, v) in enumerate(pairs(8, 200, 1, 12))] + [(7, "a", None)]
    got = {r["size"]: r for r in report.trimmed_mean(frame(spark, rows, "size long, device string, t long"), "size", "device", "t", ["a", "b"]).collect()}
    assert sorted(got) == [0, 1, 2]
    for size, device in itertools.product(range(3), "ab"):
        own = [t for s, d, t in rows if (s, d) == (size, device)]
        rest = [t for t in own if t != max(own)]
        assert abs(got[size][device] - sum(rest) / len(rest)) < 1e-9
