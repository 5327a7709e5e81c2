"""Operator 6: exact top-k by inner product of integer vectors with MaxScore.

A term is a dimension; its postings are the places and impacts of the shard's rows that are not 0 there; a list that
holds most rows is stored as one impact for each row. What a term
can add to a query's score lies between a least and a largest product; a query's terms are ordered by that range.

For each query a threshold, its k-th best score so far, splits them: the essential terms are the shortest beginning of
that order for which a row with the least products there, and the largest ones in all others, stays below the
threshold. Essential postings are traversed into accumulators. The other terms are probed in order, for the rows that
are still competitive, which is to say whose sum and the largest products of the terms that remain reach the
threshold. The threshold is raised along the way by scoring the rows that lead.

Rows are in shards (see _shards); a per-query top-k merges the shards' results, ties to the smaller id.

Scores are whole numbers: 32-bit while every possible sum is below 2**31, which is checked for each shard and block of
queries, else 64-bit; sums that could reach 2**63 raise an OverflowError.

Defined cases: rows whose vector is null, empty, or has null or non-finite components take no part; zero vectors do;
a query's candidates are the vectors of its length; null ids take no part; equal rows are candidates each, and a
query's own id is never one; several rows of a query's id give the k best of all their results; fewer candidates than k
give all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._common import stored, table
from grainmill.llm._shards import INDEX, by_key, in_shards, layout, meet, packed, top_k, usable

SHARD_ROWS, SHARD_BYTES = 16_384, 64 << 20
FIRST, STEP = 8, 4  # terms before the first threshold; terms between checks of what is still competitive
DENSE = 8  # a list is probed by a pass over it where more than one row in DENSE is competitive


class Postings:
    """Of one shard. rows: the impacts by row; lists: (places or None for all, impacts) by dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type = np.int64) -> None:
        self.ids, self.rows = ids, np.ascontiguousarray(rows.astype(kind))
        self.least, self.most = rows.min(0), rows.max(0)
        self.lists = []
        for column in np.ascontiguousarray(self.rows.T):
            places = np.flatnonzero(column)
            self.lists.append((None, column) if 2 * len(places) >= len(column) else (places, column[places]))
        self.sparse = any(places is not None for places, _ in self.lists)
        self.traversed = self.probed = 0  # postings

    def _add(self, acc: np.ndarray, term: int, weight) -> int:
        places, impacts = self.lists[term]
        if places is None:
            acc += impacts * weight
        else:
            acc[places] += impacts * weight
        return len(impacts)

    def _probe(self, term: int, rows: np.ndarray) -> np.ndarray:
        places, impacts = self.lists[term]
        if places is None:
            return impacts[rows]
        at = np.minimum(np.searchsorted(places, rows), max(len(places) - 1, 0))
        return np.where(places[at] == rows, impacts[at], 0) if len(places) else np.zeros(len(rows), impacts.dtype)

    def top(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows for one query, without the places `own`."""
        n, dims = self.rows.shape
        k = min(k, n - len(own))
        if k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = q.astype(np.int64) * self.least, q.astype(np.int64) * self.most
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(low - high, kind="stable")
        rest = np.append(np.cumsum(high[order][::-1])[::-1], 0)  # the most that terms from each on can add
        least = np.append(0, np.cumsum(low[order]))  # the least that terms before each add
        acc, q = np.zeros(n, self.rows.dtype), q.astype(self.rows.dtype)
        best_place, best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def lead(rows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The k best of those scored before and of the rows that lead by their sums, scored now."""
            m = 2 * k + len(own)
            more = rows[np.argpartition(sums, len(sums) - m)[-m:]] if len(rows) > m else rows
            more = np.setdiff1d(more, np.append(best_place, own))
            places, scores = np.append(best_place, more), np.append(best, (self.rows[more] @ q).astype(np.int64))
            self.probed += len(more) * dims
            by = np.lexsort((self.ids[places], -scores))[:k]
            return places[by], scores[by]

        used, every = 0, np.arange(n)
        while used < dims and (len(best) < k or least[used] + rest[used] >= best[-1]):  # essential terms
            for t in order[used : used + STEP]:
                self.traversed += self._add(acc, t, q[t])
            used = min(dims, used + STEP)
            if used >= min(FIRST, dims) and len(best) < k:
                best_place, best = lead(every, acc)
        best_place, best = lead(every, acc)
        some = acc >= best[-1] - rest[used]
        many = int(np.count_nonzero(some))
        while used < dims and DENSE * many > n:  # probes of most rows
            for t in order[used : used + STEP]:
                self.probed += self._add(acc, t, q[t])
            used = min(dims, used + STEP)
            some = acc >= best[-1] - rest[used]
            many = int(np.count_nonzero(some))
        live = np.flatnonzero(some)
        sums = acc[live]
        if used < dims:
            best_place, best = lead(live, sums)
        while used < dims and len(live):  # probes of few
            ok = sums >= best[-1] - rest[used]
            live, sums = live[ok], sums[ok]
            terms = order[used : used + STEP]
            sums = sums + self.rows[live[:, None], terms[None]] @ q[terms] if not self.sparse else sums + sum(self._probe(t, live) * q[t] for t in terms)
            self.probed += len(live) * len(terms)
            used = min(dims, used + STEP)
        live, sums = np.append(live, best_place), np.append(sums.astype(np.int64), best)
        live, first = np.unique(live, return_index=True)
        sums = sums[first]
        ok = ~np.isin(live, own)
        live, sums = live[ok], sums[ok]
        by = np.lexsort((self.ids[live], -sums))[:k]
        return live[by], sums[by]


def kind_for(rows: np.ndarray, q: np.ndarray) -> type:
    most = sum(max(abs(int(a)), abs(int(b))) * int(c) for a, b, c in zip(rows.min(0), rows.max(0), np.abs(q).max(0), strict=True)) if len(rows) and len(q) else 0
    if most >= 1 << 63:
        raise OverflowError("inner products of these vectors can exceed 64 bits")
    return np.int32 if most < 1 << 31 else np.int64


class Search:
    """arrays of a shard's index -> function of (query ids, query vectors)."""

    score = "long"

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, arrays: list[bytes]):
        ids = np.frombuffer(arrays[0], np.int64)
        rows = np.frombuffer(arrays[1], np.int64).reshape(len(ids), -1)
        made: dict[type, Postings] = {}

        def run(qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q = q.astype(np.int64)
            kind = kind_for(rows, q)
            if kind not in made:
                made[kind] = Postings(ids, rows, kind)
            shard, out = made[kind], []
            for i, v in zip(qid, q, strict=True):
                own = np.arange(np.searchsorted(ids, i), np.searchsorted(ids, i, "right"))
                places, scores = shard.top(v, own, self.k)
                out.append((np.full(len(places), i), ids[places], scores))
            return tuple(np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(3))

        return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """INDEX rows from (dim, shard, id, v) sorted by shard and id: ids and vectors."""
    for shard, ids, x in by_key(batches):
        if np.abs(x).max(initial=0) >= 1 << 63:
            raise OverflowError("a component exceeds 64 bits")
        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([shard]), pa.array([packed(ids.astype(np.int64), x.astype(np.int64))], pa.list_(pa.binary()))], ["dim", "shard", "arrays"])


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors, queries: (id, v) of whole numbers. query_id, rank, vec_id, score, best first."""
    at = layout(vectors, queries, SHARD_ROWS, SHARD_BYTES)
    index = stored(in_shards(vectors, at).mapInArrow(_index, INDEX))
    return top_k(meet(index, queries, at, Search(k)), k, F.desc("score"))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)
    vectors = vectors.withColumn("v", F.transform("v", lambda c: F.floor(c * 64.0).cast("double")))
    return search(vectors, vectors.where(F.col("id") % 20 == 0), 20)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
