"""What the vector searches share: which vectors take part, shards and query blocks, where they meet, and the merge.

Vectors have a distance or product only with vectors of their own length, so shards hold vectors of one length. Rows go
to shards by a hash of their id, so copies and clusters spread evenly. A shard's index travels once for every
QUERIES_PER_INDEX queries: it is the first row of its part, the query blocks follow it in the same task's stream (a
stated query set against all rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm._common import stored

QUERY_ROWS, QUERIES_PER_INDEX = 512, 16_384
INDEX = "dim int, shard long, arrays array<binary>"


def usable(df: DataFrame, id_col: str, vector: str, zero: bool = False) -> DataFrame:
    """(id, v as doubles) of the rows that take part; zero: whether zero vectors do."""
    x = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(fine if zero else fine & F.exists("v", lambda c: c != 0))


def layout(vectors: DataFrame, queries: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """A row for each length of vector that queries have: dim, first (shard), shards, blocks (of queries), parts (of a
    shard's work), task (the first one)."""
    n = F.count(F.when(~F.col("query"), 1))
    both = vectors.select(F.size("v").alias("dim"), F.lit(False).alias("query")).unionAll(queries.select(F.size("v"), F.lit(True)))
    by_dim = both.groupBy("dim").agg(n.alias("n"), F.count(F.when(F.col("query"), 1)).alias("m")).where("n > 0 AND m > 0")
    rows = F.greatest(F.lit(1), F.least(F.lit(most_rows), F.floor(F.lit(most_bytes) / (F.col("dim") * 8 + 160))))
    by_dim = by_dim.withColumn("shards", F.ceil(F.col("n") / rows)).withColumn("blocks", F.ceil(F.col("m") / QUERY_ROWS)).withColumn("parts", F.ceil(F.col("m") / QUERIES_PER_INDEX))
    before = Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)  # one row for each length
    return stored(by_dim.withColumns({"first": F.coalesce(F.sum("shards").over(before), F.lit(0)), "task": F.coalesce(F.sum(F.expr("shards * parts")).over(before), F.lit(0))}))


def in_shards(vectors: DataFrame, at: DataFrame) -> DataFrame:
    """(dim, shard, id, v), a shard's rows in a task of their own, in order of id."""
    dealt = vectors.join(F.broadcast(at), F.size("v") == F.col("dim"))  # a row for each length
    dealt = dealt.select("dim", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shards"))).alias("shard"), "id", "v")
    shards = at.agg(F.sum("shards")).first()[0] or 1
    return dealt.repartitionById(int(shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "id")


def stacked(vectors: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Matrix of the given rows' vectors, which have one length."""
    return vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, ids, vectors) of rows (..., key, id, v) sorted by key."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None
    whole = lambda: (current, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    for batch in batches:
        *_, key, ids, vectors = batch.columns
        key, ids = key.to_numpy(), ids.to_numpy()
        for s in np.unique(key).tolist():
            if s != current and held:
                yield whole()
                held = []
            current, own = s, np.flatnonzero(key == s)
            held.append((ids[own], stacked(vectors, own)))
    if held:
        yield whole()


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def meet(index: DataFrame, queries: DataFrame, at: DataFrame, search: Callable) -> DataFrame:
    """index: rows of INDEX. search(arrays) -> function of (query ids, query vectors) -> (query_id, vec_id, score) arrays."""
    q = queries.join(F.broadcast(at), F.size("v") == F.col("dim")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    q = q.select("dim", (F.col("dim") * F.lit(1 << 40) + F.col("block")).alias("block"), "id", "v").repartition("block").sortWithinPartitions("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, x in by_key(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([block]), pa.array([packed(ids.astype(np.int64), x.astype(np.float64))], pa.list_(pa.binary()))], ["dim", "block", "arrays"])

    blocks = q.mapInArrow(pack, "dim int, block long, arrays array<binary>").join(F.broadcast(at), "dim")
    blocks = blocks.withColumns({"shard": F.explode(F.expr("sequence(first, first + shards - 1)")), "part": F.expr("block % parts"), "kind": F.lit(1)})
    parts = index.join(F.broadcast(at), "dim").withColumns({"part": F.explode(F.expr("sequence(0L, parts - 1)")), "kind": F.lit(0)})
    task = F.expr("task + (shard - first) * parts + part").cast("int").alias("task")
    columns = [task, "kind", "arrays"]
    tasks = at.agg(F.sum(F.expr("shards * parts"))).first()[0] or 1
    work = parts.select(columns).unionAll(blocks.select(columns)).repartitionById(int(tasks), "task").sortWithinPartitions("task", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None
        for batch in batches:
            for k in range(batch.num_rows):
                got = batch.column(2)[k].as_py()
                if batch.column(1)[k].as_py() == 0:
                    arrays = search(got)
                    continue
                ids = np.frombuffer(got[0], np.int64)
                found = arrays(ids, np.frombuffer(got[1], np.float64).reshape(len(ids), -1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return work.mapInArrow(run, f"query_id long, vec_id long, score {search.score}")


def top_k(found: DataFrame, k: int, best_first) -> DataFrame:
    """Merges shard results; Spark cuts each partition's groups to k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
