"""Every query over the driver's tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill import sources
from grainmill.functions import hash_mod, hash_murmur, hash_offset, hash_polynomial, hash_universal, slab_buckets_of
from grainmill.operators import aggregate, join, membership, ordering, project, report, scan
from grainmill.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Fixed values of the universal hash.
UNIVERSAL = {"a": 242792921, "b": 653019598, "p": 2147483647}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, 42 AS c FROM orders")
def const_projection(spark, d):
    return project.constant(read_table(spark, d, "orders").select("o_orderkey"))


@query("SELECT l_orderkey, l_partkey + l_suppkey AS total FROM lineitem")
def vector_add(spark, d):
    return project.vector_add(read_table(spark, d, "lineitem"), "l_partkey", "l_suppkey").select("l_orderkey", "total")


@query("SELECT o_orderkey, o_custkey FROM orders")
def layout_roundtrip(spark, d):
    """Rows, chunk by chunk, to columns and back."""
    orders, columns = read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"]
    return project.flat(project.to_columns(project.to_rows(orders, F.expr("o_orderkey div 64")), columns), columns)


@query("SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS key, unnest(['part', 'supplier']) AS kind FROM lineitem")
def zip_columns(spark, d):
    items = read_table(spark, d, "lineitem").select("l_orderkey", F.array("l_partkey", "l_suppkey").alias("key"), F.array(F.lit("part"), F.lit("supplier")).alias("kind"))
    return items.select("l_orderkey", F.inline(project.zip_columns(F.col("key"), F.col("kind"))))


@query("SELECT count(*) AS n, count(DISTINCT x) AS d, min(x) >= 0 AND max(x) < 100000 AS fits FROM range(10000) t(x)")
def unique_ints(spark, d):
    """A source that needs no table: 10,000 distinct numbers below 100,000."""
    return sources.unique_ints(spark, 10_000, seed=3).agg(F.count("*").alias("n"), F.count_distinct("x").alias("d"), ((F.min("x") >= 0) & (F.max("x") < 100_000)).alias("fits"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5")
def scan_lt(spark, d):
    return scan.scan_less_than(read_table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", 5)


@query("""
WITH c AS (SELECT o_orderkey // 1000 AS chunk, count(*) FILTER (o_totalprice < 100000) AS n FROM orders GROUP BY 1)
SELECT chunk, n, coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c""")
def compaction_offsets(spark, d):
    return scan.compaction_offsets(read_table(spark, d, "orders"), F.expr("o_orderkey div 1000"), F.col("o_totalprice") < 100000)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem")
def reduce_sum(spark, d):
    return aggregate.reduce_sum(read_table(spark, d, "lineitem"), "l_linenumber")


def _group_kv(spark, d):
    return read_table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("k"), F.col("l_linenumber").alias("v"))


_GROUP_SQL = "SELECT l_partkey % 64 AS k, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1"


@query(_GROUP_SQL)
def group_sum(spark, d):
    return aggregate.group_sum(_group_kv(spark, d), "k", "v")


@query(_GROUP_SQL)
def group_sum_two_phase(spark, d):
    return aggregate.group_sum_two_phase(_group_kv(spark, d), "k", "v")


@query("SELECT r.range AS k, CAST(count(o_orderkey) AS BIGINT) AS s FROM range(64) r LEFT JOIN orders ON o_custkey % 50 = r.range GROUP BY 1")
def group_sum_dense(spark, d):
    orders = read_table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"))
    return aggregate.group_sum_dense(orders, "k", F.lit(1).cast("long"), 64)


@query("SELECT l_partkey % 64 AS k, CAST(sum(l_partkey * 100000) % 4294967296 AS BIGINT) AS s FROM lineitem GROUP BY 1")
def group_sum_wrap32(spark, d):
    rows = read_table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("k"), "l_partkey")
    return aggregate.group_sum_wrap32(rows, "k", F.col("l_partkey") * 100000)


@query("SELECT user_id, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def upsert_last(spark, d):
    return aggregate.upsert_last(read_table(spark, d, "events"), "user_id", "value", "event_id")


@query("SELECT user_id, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1")
def upsert_add(spark, d):
    return aggregate.upsert_add(read_table(spark, d, "events"), "user_id", "event_id")


@query("SELECT o_custkey AS k, list_reduce(list(o_orderkey % 97 ORDER BY o_orderkey), lambda a, b: (a * 31 + b) % 1000003, 7)::BIGINT AS folded FROM orders GROUP BY 1")
def group_fold(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") % 97).alias("v"))
    return aggregate.fold(orders, "k", "v", F.lit(7).cast("long"), lambda a, b: (a * 31 + b) % 1000003, "o_orderkey")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def distinct_count(spark, d):
    return aggregate.distinct_count(read_table(spark, d, "lineitem"), "l_partkey")


@query("SELECT count(*) AS n FROM lineitem")
def counter(spark, d):
    return aggregate.counter(read_table(spark, d, "lineitem"))


_JOIN_SQL = "SELECT o_orderkey AS k, o_custkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _join(spark, d, strategy):
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_linenumber")
    return join.inner_join(items, orders, "k", strategy)


@query("SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hash_join_broadcast(spark, d):
    """The build side is a table of fixed size."""
    nation = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return join.inner_join(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "broadcast")


@query(_JOIN_SQL)
def hash_join_shuffle(spark, d):
    return _join(spark, d, "shuffle_hash")


@query(_JOIN_SQL)
def hash_join_merge(spark, d):
    return _join(spark, d, "merge")


@query(_JOIN_SQL)
def hash_join_planned(spark, d):
    return _join(spark, d, None)


@query("SELECT l_orderkey, l_linenumber, l_partkey, first_event FROM lineitem JOIN (SELECT user_id, arg_min(event_type, event_id) AS first_event FROM events GROUP BY 1) ON l_suppkey = user_id")
def join_first_match(spark, d):
    items = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("user_id"), "l_orderkey", "l_linenumber", "l_partkey")
    events = read_table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("first_event"))
    return join.first_match(items, events, "user_id", "first_event", "event_id").drop("user_id")


@query("SELECT c_custkey, s_suppkey, c_nationkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def nested_loop_join(spark, d):
    a = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    b = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return join.nested_loop_join(a, b, "c_nationkey", "s_nationkey").drop("s_nationkey")


@query("SELECT o_orderkey AS k, count(l_orderkey) AS n, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_one_to_many(spark, d):
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    return join.one_to_many(orders, items, "k", "l_partkey")


@query("SELECT c_custkey AS k, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_one_to_many_ids(spark, d):
    customers = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return join.one_to_many_ids(customers, orders, "k", "o_orderkey").select("k", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def membership_hit(spark, d):
    big = read_table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return membership.members(read_table(spark, d, "customer").select("c_custkey"), big, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def membership_miss(spark, d):
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.strangers(read_table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders")
def membership_flags(spark, d):
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.flags(read_table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey")


@query("SELECT DISTINCT l_partkey FROM lineitem")
def build_set(spark, d):
    return membership.build_set(read_table(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def build_multiset(spark, d):
    """The build keeps duplicates; counting them shows it, on the build's own partitioning."""
    return membership.build_multiset(read_table(spark, d, "lineitem").select("l_partkey"), "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("(SELECT l_orderkey % 100 AS k FROM lineitem EXCEPT ALL SELECT o_orderkey % 100 FROM orders) UNION ALL (SELECT o_orderkey % 100 FROM orders EXCEPT ALL SELECT l_orderkey % 100 FROM lineitem)")
def bag_difference(spark, d):
    items = read_table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("k"))
    return join.bag_difference(items, read_table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("k")))


@query("SELECT o_orderkey AS n, CAST(floor(o_orderkey / (32 * 0.625)) AS BIGINT) AS buckets FROM orders")
def slab_bucket_counts(spark, d):
    """Buckets that n keys need, for many n."""
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), slab_buckets_of(F.col("o_orderkey"), 60).alias("buckets"))


def _hashed(spark, d, f):
    return read_table(spark, d, "orders").select("o_orderkey", f(F.col("o_orderkey")).alias("bucket"))


@query("SELECT o_orderkey, o_orderkey % 64 AS bucket FROM orders")
def hash_modulo(spark, d):
    return _hashed(spark, d, lambda k: hash_mod(k, 64))


@query("SELECT o_orderkey, (o_orderkey % 64 + 17) % 64 AS bucket FROM orders")
def hash_with_offset(spark, d):
    return _hashed(spark, d, lambda k: hash_offset(k, 64, 17))


@query("SELECT o_orderkey, ((242792921::BIGINT * o_orderkey + 653019598) % 2147483647) % 1009 AS bucket FROM orders")
def hash_universal_buckets(spark, d):
    return _hashed(spark, d, lambda k: hash_universal(k, **UNIVERSAL, n=1009))


@query("SELECT o_orderkey, (" + " + ".join(f"(o_orderkey // {10**i}) % 10 * {pow(7, i + 1, 1009)}" for i in range(10)) + ") % 1009 AS bucket FROM orders")
def hash_polynomial_buckets(spark, d):
    return _hashed(spark, d, lambda k: hash_polynomial(k, 1009, 7))


def _murmur_sql(seed: int, buckets: int) -> str:
    """Murmur3_x86_32 of a bigint, with 128-bit products cut to 32 bits."""
    mul = lambda a, b: f"(({a})::HUGEINT * {b} % 4294967296)::BIGINT"
    rotl = lambda a, n: f"((({a}) << {n}) & 4294967295 | (({a}) >> {32 - n}))"
    steps = [f"SELECT o_orderkey, (o_orderkey & 4294967295) AS lo, ((o_orderkey >> 32) & 4294967295) AS hi, {seed}::BIGINT AS h FROM orders"]
    for word in ("lo", "hi"):
        steps.append(f"SELECT *, {mul(word, 3432918353)} AS k FROM ({steps[-1]})")
        steps.append(f"SELECT *, xor(h, {mul(rotl('k', 15), 461845907)}) AS g FROM ({steps[-1]})")
        steps.append(f"SELECT o_orderkey, lo, hi, ({mul(rotl('g', 13), 5)} + 3864292196) % 4294967296 AS h FROM ({steps[-1]})")
    steps.append(f"SELECT o_orderkey, xor(h, 8) AS h FROM ({steps[-1]})")
    steps.append(f"SELECT o_orderkey, {mul('xor(h, h >> 16)', 2246822507)} AS h FROM ({steps[-1]})")
    steps.append(f"SELECT o_orderkey, {mul('xor(h, h >> 13)', 3266489909)} AS h FROM ({steps[-1]})")
    return f"SELECT o_orderkey, xor(h, h >> 16) % {buckets} AS bucket FROM ({steps[-1]})"


@query(_murmur_sql(42, 64))
def hash_murmur_buckets(spark, d):
    return _hashed(spark, d, lambda k: hash_murmur(k, 64))


@query(_murmur_sql(7, 64))
def hash_murmur_seeded(spark, d):
    return _hashed(spark, d, lambda k: hash_murmur(k, 64, seed=7))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders")
def sort_asc(spark, d):
    return ordering.row_numbers(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


_PREFIX_SQL = "SELECT event_id, CAST({} AS BIGINT) AS before FROM events"


@query(_PREFIX_SQL.format("coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
def prefix_exclusive(spark, d):
    return ordering.prefix_sum(read_table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "before")


@query(_PREFIX_SQL.format("sum(user_id) OVER (ORDER BY event_id)"))
def prefix_inclusive(spark, d):
    return ordering.prefix_sum(read_table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id", inclusive=True).select("event_id", "before")


@query(
    "WITH e AS (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), "
    "m AS (SELECT *, max(v) OVER (PARTITION BY user_id, event_type) AS worst FROM e) "
    "SELECT user_id, " + ", ".join(f"avg(v) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + " FROM m WHERE v <> worst GROUP BY 1"
)
def trimmed_mean_report(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return report.trimmed_mean(rows, "user_id", "event_type", "v", EVENT_TYPES)
