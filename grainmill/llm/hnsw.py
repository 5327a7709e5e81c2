"""Operator 3: approximate nearest neighbours by a navigable small-world graph per shard.

Vectors go to shards of at most SHARD_ROWS rows and SHARD_BYTES by a hash of their id (see _shards). Each shard builds a
hierarchical navigable small-world graph over its distinct vectors and stores it as flat arrays: one neighbour array
per level, vectors as one matrix, ids as offsets into one list. Levels are built from the top: a new node descends
through the finished levels above and searches on from where it arrives. A vector's copies keep their smallest ids
only, as many as a result can name, since ties go to the smaller id; so copies never fill a neighbourhood. Blocks of
queries follow the shard's index in its task's stream, are searched, measured exactly in double precision on the
original vectors, and merged by a per-query top-k.

The graph is walked for a whole block of queries at once: each step expands one node of every query's beam.

Defined cases: rows whose vector is null, empty, zero, or has null or non-finite components take no part, as query or
candidate; a query's candidates are the vectors of its length; null ids take no part; equal rows are candidates each;
fewer candidates than k give all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._common import stored, table
from grainmill.llm._shards import INDEX, by_key, in_shards, layout, meet, packed, top_k, usable

SHARD_ROWS, SHARD_BYTES = 8192, 64 << 20
M, EF_BUILD, EF_SEARCH = 16, 64, 160


class Graph:
    """Flat arrays of one shard. Level l has levels[l] (places, ascending) and near[l] (their neighbours as offsets into
    levels[l], -1 for none)."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        self.x = x.astype(np.float32)
        self.norm = (self.x**2).sum(1)
        n = len(x)
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(rng.random(n)) / np.log(M)).astype(int), 6)
        self.levels = [np.flatnonzero(top >= level) for level in range(int(top.max()) + 1)] if n else []
        self.near: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(self.levels)
        for level in range(len(self.levels) - 1, -1, -1):
            self.near[level] = self._link(level, 2 * M)

    def _distances(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Squared, of each query to its own row of places."""
        return self.norm[places] - 2 * np.einsum("qd,qkd->qk", q, self.x[places]) + (q**2).sum(1)[:, None]

    def _link(self, level: int, width: int) -> np.ndarray:
        """Neighbour lists of one level, those above being finished. The nodes of the level above come first. Nodes are
        inserted in rounds that grow the graph by a quarter: each round's nodes search the graph built so far, and their
        mutual distances within the round are known from one matrix product."""
        nodes = self.levels[level]
        upper = self.levels[level + 1] if level + 1 < len(self.levels) else nodes[:0]
        above = np.isin(nodes, upper)
        order = np.concatenate([np.flatnonzero(above), np.flatnonzero(~above)])
        n, held = len(nodes), int(above.sum())
        near = np.full((n, width), -1, np.int32)
        x, norm = self.x[nodes[order]], self.norm[nodes[order]]
        done = 0
        while done < n:
            step = min(n - done, max(64, done // 4))
            if done < held:
                step = min(step, held - done)
            new = np.arange(done, done + step)
            own = norm[new][:, None] + norm[new][None] - 2 * x[new] @ x[new].T
            np.fill_diagonal(own, np.inf)
            k = min(EF_BUILD, step)
            part = np.argpartition(own, k - 1, axis=1)[:, :k]
            found, dist = new[part], np.take_along_axis(own, part, 1)
            if done:
                # the nodes above are this level's first, in the same order
                entry = self._descend(x[new], level + 1) if done >= held > 0 else np.zeros((step, 1), np.int64)
                f, d = self._walk(x[new], entry, near, x, norm, EF_BUILD)
                found, dist = np.concatenate([found, f], 1), np.concatenate([dist, d], 1)
            by = np.argsort(dist, axis=1, kind="stable")
            found, dist = np.take_along_axis(found, by, 1), np.take_along_axis(dist, by, 1)
            for row, i in enumerate(new):
                ok = np.isfinite(dist[row]) & (found[row] >= 0)
                self._connect(i, found[row][ok], dist[row][ok], near, x, M)
            done += step
            for i in new:  # back links, pruned by the same rule when a list is full
                for j in near[i][near[i] >= 0]:
                    self._back(int(j), int(i), near, x)
        out = np.empty_like(near)
        out[order] = np.where(near >= 0, order[near], -1)
        return out

    def _descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """The nearest node that a narrow walk from the top finds in a level, as an offset into it."""
        entry = np.zeros((len(q), 1), np.int64)
        for at in range(len(self.levels) - 1, level - 1, -1):
            nodes = self.levels[at]
            place, _ = self._walk(q, entry, self.near[at], self.x[nodes], self.norm[nodes], 4)
            entry = place[:, :1]
            if at > level:
                entry = np.searchsorted(self.levels[at - 1], nodes[entry])
        return entry

    @staticmethod
    def _diverse(found: np.ndarray, dist: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
        """A candidate is kept if it is nearer to the node than to any kept one; the nearest others fill up."""
        found, dist = found[: max(3 * keep, 40)], dist[: max(3 * keep, 40)]
        rows = x[found]
        norm = (rows**2).sum(1)
        between = norm[:, None] + norm[None] - 2 * rows @ rows.T
        kept: list[int] = []
        alive = np.ones(len(found), bool)
        for k in range(len(found)):
            if alive[k]:
                kept.append(k)
                if len(kept) == keep:
                    break
                alive &= between[k] > dist
        if len(kept) < keep:
            have = set(kept)
            kept += [k for k in range(len(found)) if k not in have][: keep - len(kept)]
        return found[kept]

    def _connect(self, i: int, found: np.ndarray, dist: np.ndarray, near: np.ndarray, x: np.ndarray, keep: int) -> None:
        if len(found):
            kept = self._diverse(found, dist, x, keep)
            near[i, : len(kept)] = kept

    def _back(self, j: int, i: int, near: np.ndarray, x: np.ndarray) -> None:
        row = near[j]
        if i in row:
            return
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        all_ = np.append(row, i)
        d = ((x[all_] - x[j]) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        kept = self._diverse(all_[order], d[order], x, len(row))
        row[:] = -1
        row[: len(kept)] = kept

    @staticmethod
    def _walk(q: np.ndarray, entry: np.ndarray, near: np.ndarray, x: np.ndarray, norm: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of every query at once: (places, squared distances), nearest first, -1 and inf for none."""
        m, n = len(q), len(x)
        qq = (q**2).sum(1)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # place -1
        rows = np.arange(m)
        np.put_along_axis(seen, entry, True, 1)
        ef = min(ef, n)
        place = np.full((m, ef), -1, np.int64)
        dist = np.full((m, ef), np.inf, np.float32)
        place[:, : entry.shape[1]] = entry[:, :ef]
        dist[:, : entry.shape[1]] = (norm[entry] - 2 * np.einsum("qd,qkd->qk", q, x[entry]) + qq[:, None])[:, :ef]
        open_ = np.isfinite(dist)
        live = rows
        while len(live):
            d = np.where(open_[live], dist[live], np.inf)
            best = d.argmin(1)
            going = np.isfinite(d[np.arange(len(live)), best])
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            around = near[place[live, best]].astype(np.int64)
            fresh = ~seen[live[:, None], around]
            seen[live[:, None], around] = True
            d = np.where(fresh, norm[around] - 2 * np.einsum("qd,qkd->qk", q[live], x[around]) + qq[live][:, None], np.inf)
            all_d = np.concatenate([dist[live], d], 1)
            all_p = np.concatenate([place[live], around], 1)
            all_o = np.concatenate([open_[live], fresh], 1)
            pick = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            dist[live], place[live] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_p, pick, 1)
            open_[live] = np.take_along_axis(all_o, pick, 1) & np.isfinite(dist[live])
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), np.take_along_axis(place, order, 1), -1), dist

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Places of near vectors of each query, -1 for none."""
        q = q.astype(np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        if len(self.levels) > 1:
            entry = np.searchsorted(self.levels[0], self.levels[1][self._descend(q, 1)])
        return self._walk(q, entry, self.near[0], self.x, self.norm, ef)[0]


def _build(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """INDEX rows from (dim, shard, id, v) sorted by shard. arrays: distinct vectors, ids, where each vector's ids start,
    and for each level its nodes and their neighbours."""
    for shard, ids, x in by_key(batches):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        plain = x + 0.0  # -0.0 and 0.0 are one
        _, first, owner = np.unique(np.ascontiguousarray(plain).view(np.dtype((np.void, plain.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(owner, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
        by = by[rank < keep]
        starts = np.searchsorted(owner[by], np.arange(len(first) + 1))
        g = Graph(x[first])
        arrays = packed(x[first], ids[by].astype(np.int64), starts.astype(np.int64))
        for nodes, near in zip(g.levels, g.near, strict=True):
            arrays += packed(nodes.astype(np.int64), near.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([shard]), pa.array([arrays], pa.list_(pa.binary()))], ["dim", "shard", "arrays"])


def load(arrays: list[bytes]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, vectors in double precision, ids, and where each vector's ids start."""
    ids, starts = (np.frombuffer(a, np.int64) for a in arrays[1:3])
    x = np.frombuffer(arrays[0], np.float64).reshape(len(starts) - 1, -1)
    g = Graph.__new__(Graph)
    g.x = x.astype(np.float32)
    g.norm = (g.x**2).sum(1)
    g.levels = [np.frombuffer(a, np.int64) for a in arrays[3::2]]
    g.near = [np.frombuffer(a, np.int32).reshape(len(n), -1) for a, n in zip(arrays[4::2], g.levels, strict=True)]
    return g, x, ids, starts


class Search:
    """arrays of a shard's index -> function of (query ids, query vectors): the k best of each query in the shard."""

    score = "double"

    def __init__(self, k: int, ef: int) -> None:
        self.k, self.ef = k, ef

    def __call__(self, arrays: list[bytes]):
        graph, x, ids, starts = load(arrays)

        def run(qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            place = graph.search(q, self.ef)
            out = []
            for j in range(len(qid)):
                p = place[j][place[j] >= 0]
                score = np.sqrt(((x[p] - q[j]) ** 2).sum(1))
                n = starts[p + 1] - starts[p]
                which = np.repeat(starts[p] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                v, s = ids[which.astype(np.int64)], np.repeat(score, n)
                ok = v != qid[j]
                v, s = v[ok], s[ok]
                best = np.lexsort((v, s))[: self.k]
                out.append((np.full(len(best), qid[j]), v[best], s[best]))
            return tuple(np.concatenate([o[c] for o in out]) for c in range(3))

        return run


def search(vectors: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """vectors, queries: (id, v). query_id, rank, vec_id, score: k nearest each, without the query's own id."""
    at = layout(vectors, queries, SHARD_ROWS, SHARD_BYTES)
    index = stored(in_shards(vectors, at).mapInArrow(lambda b: _build(b, k + 1), INDEX))
    return top_k(meet(index, queries, at, Search(k, ef)), k, F.col("score"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where(F.col("id") % 100 == 0), 10)
