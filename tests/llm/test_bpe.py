import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainmill.llm import _bpe, bpe_codec, packing
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aàÀéÉßẞöÖñÑıİŉĿŀſK'’s tTre ve\x1c\x1d\x85\xa0­<|>12²½ªºµ日本Σσς́e\u0000·ǅ_-@#\n.,"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def strange(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(r.randint(0, n))) + r.choice(["", "", "", "<|endoftext|>x"])


def test_merges_by_rank_are_the_file_s_merges():
    assert _bpe.improper_merges(PATH) == 0


def test_words_match_the_library(library):
    words, r = _bpe.WordEncoder(max_words=50), random.Random(1)
    assert words.core is not None
    for _ in range(4000):
        t = strange(r, 14)
        want = library.encode(t, add_special_tokens=False).ids
        assert words.packed(t) == b"".join(i.to_bytes(4, "little") for i in want), t


@pytest.mark.parametrize("chunk", [2, 16, 1024])
def test_chunks_match_the_library(library, chunk):
    codec, r = bpe_codec.ChunkCodec(chunk_bytes=chunk, max_chunks=64), random.Random(chunk)
    for _ in range(1500):
        t = strange(r, 80)
        want = library.encode(t, add_special_tokens=False).ids
        n, ids, decoded = codec.encode(t)
        assert (n, ids) == (len(want), " ".join(map(str, want))), t
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_copies_reuse_chunks():
    codec = bpe_codec.ChunkCodec(chunk_bytes=64)
    r = random.Random(3)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    first = codec.encode("before " + passage)
    made = codec.encoded
    assert codec.encode("something else stands here " + passage)[0] > 0 and first[0] > 0
    assert codec.encoded - made <= 4 and codec.reused > 10


BYTES = public_tokenizers.path("byte_bpe_50k.json")
BYTE_ALPHABET = "aB'sredvlltm   \n\n\t\xa0é日本²1234\u0300🙂!?._-<|>"


@pytest.mark.parametrize("chunk", [2, 8, 64, 1024])
def test_byte_level_joins_match_the_library(chunk):
    library = Tokenizer.from_file(BYTES)
    codec, r = bpe_codec.ChunkCodec(BYTES, chunk_bytes=chunk, max_chunks=64), random.Random(chunk)
    assert codec.words.core is None and codec.pieces.chunked
    for k in range(1500):
        t = "".join(r.choice(BYTE_ALPHABET) for _ in range(r.randint(0, 300 if k % 9 == 0 else 40))) + r.choice(["", "", "<|endoftext|>x", " " * 40, "a" * 90])
        want = library.encode(t, add_special_tokens=False).ids
        n, ids, _ = codec.encode(t)
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(t)
    assert _bpe.WordEncoder(BYTES).packed(t) == b"".join(i.to_bytes(4, "little") for i in want)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(1000))
    codec = bpe_codec.ChunkCodec(BYTES, chunk_bytes=chunk)
    codec.encode(text)
    before = codec.encoded
    assert codec.encode("x " + text)[1].split() == [str(i) for i in library.encode("x " + text, add_special_tokens=False).ids]
    assert codec.encoded - before <= 4


def test_tokenizers_of_other_kinds_get_whole_texts(tmp_path):
    spec = json.load(open(BYTES))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    library, codec = Tokenizer.from_file(str(tmp_path / "t.json")), bpe_codec.ChunkCodec(str(tmp_path / "t.json"), chunk_bytes=2)
    assert not codec.pieces.chunked
    for t in ("", "one two", "a  b\n"):
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t)[1] == " ".join(map(str, want))


def test_caches_keep_the_newer_half():
    c = bpe_codec.Cache(2)
    for k in "abc":
        c.put(k, k)
    assert c.get("a") == "a" and c.get("c") == "c" and len(c.new) <= 2
    c.put("d", "d")
    c.put("e", "e")
    assert c.get("b") is None and c.get("a") == "a"


@pytest.mark.parametrize("path", [None, BYTES])
def test_codec_over_tables(spark, sf_dir, path):
    tokenizer = Tokenizer.from_file(path or PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe_codec.encode_frame(docs, tokenizer=path, digests=True).collect() if path else bpe_codec.op10_bpe_codec(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_codec_cases(spark, library):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids"]) for r in bpe_codec.encode_frame(cases.documents(spark)).collect())
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(i), " ".join(map(str, i))) for r in cases.documents(spark).collect() for i in [library.encode(r["text"] or "", add_special_tokens=False).ids])
    assert got == want
    assert bpe_codec.encode_frame(cases.empty(spark)).count() == 0


def check_pieces(pieces, docs, library, window=2048):
    """docs: list of (id, text) with ids that occur once."""
    import zlib

    import numpy as np

    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    padding = total = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= 0.05 * total
    for i, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    groups = {}
    for parts in by_seq.values():
        assert len({p["step_group"] for p in parts}) == 1
        groups[parts[0]["step_group"]] = groups.get(parts[0]["step_group"], 0) + sum(p["length"] for p in parts)
    assert max(groups.values(), default=0) <= 32768


def test_packing_over_tables(spark, sf_dir, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_pieces(packing.op8_multi_length_packing(spark, sf_dir).collect(), docs, library)


def test_packing_cases(spark, library):
    docs = cases.documents(spark).dropDuplicates(["doc_id"])
    check_pieces(packing.pack_frame(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library)
    n = len(cases.TEXTS) + 2
    pieces = packing.pack_frame(cases.documents(spark)).collect()
    assert sum(p["start"] == 0 for p in pieces) == n  # each row is packed for itself
    assert packing.pack_frame(cases.empty(spark)).count() == 0
    for kind in ("int", "string", "decimal(20,0)"):
        own = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = packing.pack_frame(own)
        assert got.schema["doc_id"].dataType == own.schema["doc_id"].dataType and got.where("start = 0").count() == 5


@pytest.mark.parametrize("limit", [packing.BROADCAST_BYTES, -1])
def test_groups_are_balanced_over_tasks(spark, sf_dir, limit, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_BYTES", limit)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(5)
    pieces = packing.pack_frame(docs).persist()
    got = packing.balance_groups(pieces)
    totals = lambda df: sorted(r[0] for r in df.groupBy("step_group").agg(F.sum("length")).select("sum(length)").collect())
    assert got.columns == pieces.columns and sum(totals(got)) == sum(totals(pieces))
    assert len([t for t in totals(pieces) if t < packing.GROUP_TOKENS]) >= 5 and all(t == packing.GROUP_TOKENS for t in totals(got)[1:])
    assert got.groupBy("sequence_id").agg(F.count_distinct("step_group").alias("n")).where("n > 1").isEmpty()
    assert got.drop("step_group").exceptAll(pieces.drop("step_group")).isEmpty()
    assert packing.balance_groups(pieces.limit(0)).count() == 0
    pieces.unpersist()


def test_packing_with_another_tokenizer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    check_pieces(packing.pack_frame(docs, tokenizer=BYTES).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], Tokenizer.from_file(BYTES))


def test_packer_keeps_every_token_in_small_buffers():
    r = random.Random(5)
    for trial in range(30):
        p = packing.Packer(0, window=64, smallest=8, buffer_docs=r.choice([2, 5, 40]), group_tokens=256)
        docs = [r.choice([1, 3, 7, 8, 9, 31, 64, 65, 200, r.randint(1, 150)]) for _ in range(r.randint(0, 60))]
        for i, n in enumerate(docs):
            p.add(i, bytes(4 * n))
        p.finish()
        seen, sizes = {}, {}
        for d, start, n, _, total, seq, off, _, _ in p.take():
            seen.setdefault(d, []).append((start, n))
            sizes[seq] = sizes.get(seq, 0) + n
        assert all(s <= 64 and s & (s - 1) == 0 for s in sizes.values())
        for i, n in enumerate(docs):
            parts = sorted(seen[i])
            assert parts[0][0] == 0 and sum(x[1] for x in parts) == n and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
