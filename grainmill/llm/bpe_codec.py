"""Operator 10: BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last eight bytes meets a mask, so equal passages give equal chunks
wherever they stand. Each distinct chunk is encoded once and kept in a worker's cache of bounded size, whose older half
goes when it is full. Joins of chunks are repaired by re-encoding until both sides agree exactly:

- Where the tokenizer drops white space and never merges across it, which is checked when its file is loaded, the
  raw fragments on both sides of a join are encoded together, reaching over further chunks until white space stands on
  either side.
- With a byte-level tokenizer, whose pieces follow from the text to their right alone, a window from the last settled
  piece on grows into the next chunk until one of its boundaries, LOOK_AHEAD pieces before its end, is one of the chunk's
  own; from there on both segmentations are the same.
- With any other tokenizer, and for texts that hold one of the added tokens, whole texts are encoded by the library.

Rows are independent: no shuffle, memory of one Arrow batch and the caches; a lost task is simply run again. Chunks are
shared by the documents that a worker meets, not between workers, which would move every text.
Null text counts as empty; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._bpe import SPACES, WordEncoder
from grainmill.llm._common import WORKER_STATE, beside, spread, table

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW = 8
LOOK_AHEAD = 4  # pieces before a window's end that more text may change


class Cache:
    """The last `most` values or more, up to twice as many: when the newer half is full it becomes the older one."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


def cut_points(data: bytes, mask: int) -> list[int]:
    """Where chunks end: after bytes whose rolling hash meets the mask, never inside a character."""
    if len(data) <= WINDOW:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    gear, n = _GEAR[raw], len(raw)
    h = gear[WINDOW - 1 :].copy()
    for k in range(1, WINDOW):
        h += gear[WINDOW - 1 - k : n - k] << np.uint32(k)
    cuts = np.flatnonzero((h >> np.uint32(8)) & np.uint32(mask) == 0) + WINDOW
    cuts = cuts[cuts < n]
    cuts = cuts[(raw[cuts] & 0xC0) != 0x80]
    return [*cuts.tolist(), n]


class ChunkCodec:
    """Encodes texts chunk by chunk. `encode` gives (count, decimal ids, tokens), the latter two joined by spaces."""

    def __init__(self, path: str | None = None, chunk_bytes: int = 1024, max_chunks: int = 8192) -> None:
        self.words = WordEncoder(path, max_words=150_000, strings=True)
        self.mask = chunk_bytes - 1
        assert chunk_bytes & self.mask == 0, "a power of two"
        self.chunks, self.reused, self.encoded = Cache(max_chunks), 0, 0
        self.pieces = None if self.words.core else Pieces(self)

    def reuse(self, data: bytes, make):
        """The chunk's value, made at its first meeting."""
        got = self.chunks.get(data)
        if got is None:
            got = make(data.decode())
            self.encoded += 1
            if len(data) <= 16 * self.mask:  # longer chunks hold no cut point: they seldom come again
                self.chunks.put(data, got)
        else:
            self.reused += 1
        return got

    def _run(self, text: str) -> tuple[int, str, str]:
        found = list(map(self.words.__getitem__, self.words.words(text)))
        return sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])

    def _chunk(self, text: str) -> tuple:
        """(head, inner run or None if there is no white space, tail)"""
        first = min((k for k in map(text.find, " \n") if k >= 0), default=-1)
        last = max(text.rfind(" "), text.rfind("\n"))
        if first < 0 or not text[:first].isascii() or not text[last:].isascii():
            at = [k for k, c in enumerate(text) if c in SPACES]
            first, last = (at[0], at[-1]) if at else (-1, -1)
        return (text[:first], self._run(text[first : last + 1]), text[last + 1 :]) if first >= 0 else (text, None, "")

    def encode(self, text: str) -> tuple[int, str, str]:
        if self.pieces:
            return self.pieces.encode(text)
        data, start, open_end, runs = text.encode(), 0, "", []
        for end in cut_points(data, self.mask):
            head, inner, tail = self.reuse(data[start:end], self._chunk)
            start = end
            open_end += head
            if inner is not None:  # white space: what stands before it is whole now
                if open_end:
                    runs.append(self._run(open_end))
                if inner[0]:
                    runs.append(inner)
                open_end = tail
        if open_end:
            runs.append(self._run(open_end))
        return sum(r[0] for r in runs), " ".join([r[1] for r in runs if r[0]]), " ".join([r[2] for r in runs if r[0]])


class Pieces:
    """Chunks of a byte-level tokenizer: (pieces' ends, ids of each piece), positions in characters."""

    def __init__(self, codec: ChunkCodec) -> None:
        self.codec, self.library = codec, codec.words.tokenizer
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not (spec["model"].get("dropout"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, tuple[int, ...]] = {}

    def cut(self, text: str) -> tuple[list[int], list[tuple[int, ...]]]:
        ends, ids = [], []
        for piece, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(text):
            got = self.known.get(piece)
            if got is None:
                got = tuple(t.id for t in self.library.model.tokenize(piece))
                if len(piece) <= 64:
                    if len(self.known) >= 150_000:
                        self.known.clear()
                    self.known[piece] = got
            ends.append(end)
            ids.append(got)
        return ends, ids

    def ids(self, text: str) -> list[int]:
        plain = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        if not self.chunked or any(a in text or a in plain for a in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        data, out, settled = plain.encode(), [], 0  # settled: a boundary of the whole text's pieces
        start = at = 0  # of the chunk, in bytes and characters
        for end in cut_points(data, self.codec.mask):
            ends, ids = self.codec.reuse(data[start:end], self.cut)
            start = end
            first, at = at, at + (ends[-1] if ends else 0)
            if settled < first:  # the join: re-encode until a boundary is the chunk's own
                own, reach = {first + e: k + 1 for k, e in enumerate(ends)}, 32
                own[first] = 0
                while True:
                    upto = min(at, first + reach)
                    w_ends, w_ids = self.cut(plain[settled:upto])
                    agreed = next((k for k, e in enumerate(w_ends[:-LOOK_AHEAD]) if settled + e in own), None)
                    if agreed is not None or upto == at:
                        break
                    reach *= 2
                if agreed is None:  # all of the chunk is open
                    whole = w_ids[:-LOOK_AHEAD]
                    for x in whole:
                        out += x
                    settled += w_ends[len(whole) - 1] if whole else 0
                    continue
                for x in w_ids[: agreed + 1]:
                    out += x
                settled += w_ends[agreed]
                k = own[settled]
            else:
                k = 0
            stop = max(k, len(ids) - LOOK_AHEAD)
            for x in ids[k:stop]:
                out += x
            if stop > k:
                settled = first + ends[stop - 1]
        for x in self.cut(plain[settled:])[1]:
            out += x
        return out

    def encode(self, text: str) -> tuple[int, str, str]:
        ids, names = self.ids(text), self.codec.words.tokens
        return len(ids), " ".join(map(str, ids)), " ".join([names[i] for i in ids])


def encode_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, digests: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, then ids and decoded text, or with `digests` their SHA-256.

    The decoded text is what the library's decode(ids, skip_special_tokens=False) gives: for a tokenizer without a
    decoder, as the word vocabulary, its tokens joined by spaces; else the library decodes. `tokenizer` is a path on every
    node; None is the word vocabulary.
    """
    kind = docs.schema[id_col].dataType
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("codec", tokenizer)
        codec = WORKER_STATE.get(key) or WORKER_STATE.setdefault(key, ChunkCodec(tokenizer))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                n, ids, decoded = [], [], []
                for text in part.column(1):
                    count, a, b = codec.encode(text.as_py() or "")
                    if codec.words.tokenizer.decoder is not None:
                        b = codec.words.tokenizer.decode([int(i) for i in a.split()], skip_special_tokens=False)
                    n.append(count)
                    ids.append(sha(a) if digests else a)
                    decoded.append(sha(b) if digests else b)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", *names])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, beside(kind, f"n_tokens long, {names[0]} string, {names[1]} string", id_col))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_frame(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), digests=True)
