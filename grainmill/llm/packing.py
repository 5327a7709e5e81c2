"""Operator 8: hierarchical multi-length packing.

Documents become token ids with an end id and are routed to context-size tiers (powers of two up to the longest
window). Whole longest windows of long documents are sequences by themselves; what is left of a document goes to
the smallest tier that holds it. Each task packs a bounded buffer at a time: a window of a tier takes one document
of that tier and its gap is filled from shorter tiers, first with the longest whole document that fits, then, when
none fits, with a piece cut from a shorter one. Windows are thus exactly full, and a full window of any tier needs
no padding. What remains of a buffer is carried into the next; the last tail of a task is cut at powers of two.
Sequences go to step groups of GROUP_TOKENS; groups that tasks leave open are dealt anew over all tasks: in descending
order of size, powers of two fill every group but one exactly.

Packing is local to each task: only the input partition is read, no text is shuffled, no task holds more than the
buffer, and a lost task is run again with the same result. What balancing moves are the few sequences of open groups.
Null text counts as empty (one end id); equal rows are
packed each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._bpe import WordEncoder
from grainmill.llm._common import WORKER_STATE, beside, small, spread, stored, table
from grainmill.operators.ordering import prefix_sum

END_ID, GROUP_TOKENS = 1, 32_768
BROADCAST_BYTES = 16 << 20
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs (doc_id, packed ids) into full windows; `pieces` holds finished rows until they are taken."""

    def __init__(self, base: int, window: int = 2048, smallest: int = 256, buffer_docs: int = 2048, group_tokens: int = GROUP_TOKENS) -> None:
        self.base, self.window, self.buffer_docs, self.group_tokens = base, window, buffer_docs, group_tokens
        self.tiers = [t for t in (1 << k for k in range(32)) if smallest <= t <= window]
        self.pool: list[tuple[int, int, tuple]] = []  # (length, serial, (doc_id, ids, start)), by length
        self.pieces: list[tuple] = []
        self.serial = self.sequences = 0
        self.groups: list[list[int]] = []  # open step groups: [tokens, id]
        self.n_groups = 0

    def _sequence(self, parts: list[tuple], tier: int) -> None:
        """parts: (doc, start, length) with doc = (doc_id, ids)"""
        total = sum(p[2] for p in parts)
        group = next((g for g in self.groups if g[0] + total <= self.group_tokens), None)
        if group is None:
            group = [0, self.base + self.n_groups]
            self.groups.append(group)
            self.n_groups += 1
        group[0] += total
        if group[0] >= self.group_tokens:
            self.groups.remove(group)
        offset, number = 0, self.base + self.sequences
        self.sequences += 1
        for (doc_id, ids), start, length in parts:
            self.pieces.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) >> 2, number, offset, tier, group[1]))
            offset += length

    def add(self, doc_id, ids: bytes) -> None:
        n, start = len(ids) >> 2, 0
        while n - start >= self.window:
            self._sequence([((doc_id, ids), start, self.window)], self.window)
            start += self.window
        if n > start:
            self._put((doc_id, ids), start, n - start)
        if len(self.pool) >= self.buffer_docs:
            self._pack(self.buffer_docs // 4)

    def _put(self, doc: tuple, start: int, length: int) -> None:
        self.serial += 1
        insort(self.pool, (length, self.serial, doc, start))

    def _pack(self, keep: int) -> None:
        """Longest first, until `keep` documents, the shortest ones, are left to fill later gaps."""
        pool = self.pool
        while len(pool) > keep:
            length, _, doc, start = pool[-1]
            tier = next(t for t in self.tiers if t >= length)
            if sum(x[0] for x in pool[-8:]) < tier and sum(x[0] for x in pool) < tier:
                break
            pool.pop()
            parts, gap = [(doc, start, length)], tier - length
            while gap:
                k = bisect_right(pool, (gap, 1 << 62))
                if k and (4 * pool[k - 1][0] >= gap or k == len(pool)):
                    n, _, other, at = pool.pop(k - 1)
                else:  # nothing fits well: cut what is needed from the next longer one
                    n, _, other, at = pool.pop(k)
                    self._put(other, at + gap, n - gap)
                    n = gap
                parts.append((other, at, n))
                gap -= n
            self._sequence(parts, tier)

    def finish(self) -> None:
        self._pack(0)
        left = [(doc, start, length) for length, _, doc, start in reversed(self.pool)]
        self.pool = []
        total = sum(p[2] for p in left)
        while total:
            size, parts = 1 << (total.bit_length() - 1), []
            total -= size
            while size:
                doc, start, length = left.pop(0)
                n = min(length, size)
                parts.append((doc, start, n))
                size -= n
                if n < length:
                    left.insert(0, (doc, start + n, length - n))
            self._sequence(parts, sum(p[2] for p in parts))

    def take(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack_frame(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see op8's contract. tier: the window's size; step_group: sequences that make one step."""
    schema = beside(docs.schema[id_col].dataType, PIECE, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("packing", tokenizer)
        words = WORKER_STATE.get(key) or WORKER_STATE.setdefault(key, WordEncoder(tokenizer))
        end = np.uint32(END_ID).astype("<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        types = [None, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]

        def out() -> pa.RecordBatch:
            cols = zip(*packer.take(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            ids = batch.column(0)
            types[0] = ids.type
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                packer.add(ids[k].as_py(), words.packed(text) + end if text else end)
            if len(packer.pieces) >= 10_000:
                yield out()
        packer.finish()
        if packer.pieces:
            yield out()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def balance_groups(pieces: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces, which should be stored, with the sequences of groups below the budget in new groups (negative
    numbers), all of them full but the last. Sequences are powers of two in length."""
    met = lambda df: F.broadcast(df) if small(df, BROADCAST_BYTES) else df
    totals = pieces.groupBy("step_group").agg(F.sum("length").alias("tokens"))
    left = stored(totals.where(F.col("tokens") < group_tokens).select("step_group"))
    sequences = pieces.join(met(left), "step_group", "left_semi").groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    ordered = stored(sequences.withColumn("order", F.struct(-F.col("tokens"), "sequence_id")))
    placed = prefix_sum(ordered, "order", "tokens").select(F.col("sequence_id").alias("_sequence"), (-1 - F.floor(F.col("before") / group_tokens)).alias("_group"))
    placed = stored(placed)
    out = pieces.join(met(placed), F.col("sequence_id") == F.col("_sequence"), "left")
    return out.withColumn("step_group", F.coalesce("_group", "step_group")).drop("_sequence", "_group")


def op8_multi_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance_groups(stored(pack_frame(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))))
