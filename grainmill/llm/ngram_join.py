"""Operator 2: n-gram Jaccard join with signature trees; exact for a similarity of 0.8 or more.

1. Each distinct set gives keys (see _shingles.keys_of): two sets that link share one. A key stands for a whole
   segment of a set, several shingles at once, so sets that merely share a passage seldom meet.
2. Rows (key, set) are sorted by key; the sets that share one form part of the unit of its least set. Keys that very
   many sets hold (HOT_SHARE) are found beforehand; their rows bypass the sort with the key's unit beside them, so no
   key gathers an unbounded number of rows.
3. Units are dealt to blocks of at most BLOCK_BYTES of bitmaps, and no more than a task's mean share. Small units fill a block together; a larger one is
   cut by size classes, and two blocks of it meet only if their ranges of sizes allow a link.
4. Each block is one signature tree (see signature_tree): nodes hold OR-combined bitmaps and size ranges, and dual
   traversal prunes pairs of nodes, across units as well, by the largest overlap they allow. What remains possible
   connects sets to clusters.
5. The whole shingle sets of clusters, dealt to blocks in the same way, meet in trees again, whose remaining pairs
   are intersected exactly. A block reports its links as a spanning forest: pairs within a component are never listed.
6. Connected components by star contraction; the component id is the least doc_id.

Nothing is capped; the constants change the work's shape, not its result. Broadcasts: MAX_HOT keys, layouts of large
units and ids of sets with a possible partner only below BROADCAST_BYTES, which is counted, else they are joined by
shuffle; rows of copies more numerous than 1 / HOT_SHARE of all meet their ids by a broadcast of at most HOT_SHARE rows.

A set's identity is 120 bits of hash over its 64-bit shingle hashes, equality is not compared word by word. Defined
cases: null or wordless text has no shingles and its row is a component of its own; rows with null doc_id take part,
and a component of such rows only has a null id; equal rows are in one component and each is returned; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm._common import beside, discard, small, spread, stored, table
from grainmill.llm._shingles import fingerprints, keys_of, mix, shingle_sets
from grainmill.llm.components import components
from grainmill.llm.signature_tree import Union, bitmap, candidates

HOT_SHARE, MAX_HOT = 64, 1 << 17  # a key is hot if one in HOT_SHARE of all rows, or HOT_ROWS, hold it
HOT_ROWS, HOT_IN_CHUNK = 10_000, 16
CHUNK = 2_000_000  # keys counted at once
BLOCK_BYTES, SET_BYTES, LEAST_BYTES = 2 << 20, 24 << 20, 64 << 10
BROADCAST_BYTES = 16 << 20
CLASS_REACH = 3  # size classes that a link can span


def _runs(column, limit: int = 400_000) -> Iterator[list[bytes | None]]:
    run, size = [], 0
    for x in column:
        run.append(x.as_py())
        size += len(run[-1] or b"")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _new(fp: np.ndarray, fp2: np.ndarray, sets: list[np.ndarray], seen: set) -> list[int]:
    """Places of the sets that the task has not met before."""
    out = []
    for k, (x, y) in enumerate(zip(fp.tolist(), fp2.tolist(), strict=True)):
        if len(sets[k]) and (x, y) not in seen:
            seen.add((x, y))
            out.append(k)
    return out


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, h, t: id, hash and bytes of each text."""
    t = F.col(f"`{text}`").cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def signatures(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Per row: id, n, fp and fp2 (0 without shingles), the text's hash, and the bitmap where a task meets a set first.
    Rows with n = -1 have a key that is frequent within a chunk, how many sets there hold it (`hits`), and one of them (fp)."""
    kind = docs.schema[id_col].dataType
    names = ["id", "h", "n", "fp", "fp2", "bits", "key", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, id_type = 0, None

        def rows(ids, h, n, fp, fp2, bits, key, hits) -> pa.RecordBatch:
            long = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays([ids, h, long(n), long(fp), long(fp2), pa.array(bits, pa.binary()), long(key), long(hits)], names)

        def frequent() -> pa.RecordBatch:
            keys, fps = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            key, first, hits = np.unique(keys, return_index=True, return_counts=True)
            often = hits >= HOT_IN_CHUNK
            m = int(often.sum())
            return rows(pa.nulls(m, id_type), pa.nulls(m, pa.int64()), np.full(m, -1), fps[first[often]], np.zeros(m, np.int64), [None] * m, key[often].view(np.int64), hits[often])

        for batch in batches:
            at, id_type = 0, batch.column(0).type
            for texts in _runs(batch.column(2)):
                sets = shingle_sets(texts)
                fp, fp2 = fingerprints(sets)
                new, bits = _new(fp, fp2, sets, seen), [None] * len(sets)
                for k in new:
                    bits[k] = bitmap(sets[k]).tobytes()
                keys, owner = keys_of([sets[k] for k in new])
                held.append((keys, fp[new][owner]))
                size += len(keys)
                nothing = [None] * len(sets)
                own = [batch.column(c).slice(at, len(texts)) for c in (0, 1)]
                yield rows(*own, [len(s) for s in sets], fp, fp2, bits, nothing, nothing)
                at += len(texts)
                if size >= CHUNK:
                    yield frequent()
                    held, size = [], 0
        if size:
            yield frequent()

    return _texts(docs, id_col, text).mapInArrow(run, beside(kind, "h long, n long, fp long, fp2 long, bits binary, key long, hits long", "id"))


def hot_keys(sigs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys that very many sets hold, sorted, and the unit of each: any set that holds it, the same for every row."""
    rows = sigs.where("n > 0").count()
    counts = sigs.where("n = -1").groupBy("key").agg(F.sum("hits").alias("n"), F.min("fp").alias("fp"))
    found = counts.where(F.col("n") >= max(1, min(HOT_ROWS, rows // HOT_SHARE))).orderBy(F.desc("n"), "key").limit(MAX_HOT).select("key", "fp").toPandas()
    key, unit = (found[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("key", "fp"))
    by = np.argsort(key)
    return key[by], unit[by] | np.uint64(1)


def memberships(docs: DataFrame, text: str, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(unit, fp), distinct: each set's units. Units with one set only are left out, but for those of hot keys."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # MAX_HOT pairs of longs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_key, unit = shared.value
        seen: set = set()
        for batch in batches:
            for texts in _runs(batch.column(0)):
                sets = shingle_sets(texts)
                fp, fp2 = fingerprints(sets)
                new = _new(fp, fp2, sets, seen)
                keys, owner = keys_of([sets[k] for k in new])
                own = fp[new][owner]
                if len(hot_key):
                    at = np.minimum(np.searchsorted(hot_key, keys), len(hot_key) - 1)
                    is_hot = hot_key[at] == keys
                    pairs = np.unique(np.stack([unit[at[is_hot]].view(np.int64), own[is_hot]], 1), axis=0)
                    keys, own = np.concatenate([keys[~is_hot], pairs[:, 0].view(np.uint64)]), np.concatenate([own[~is_hot], pairs[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own)], ["key", "fp"])

    rows = docs.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(run, "key long, fp long")
    # an odd key is a hot key's unit: its rows need not meet, and go anywhere
    rows = rows.repartition(F.when(F.col("key") % 2 == 0, F.col("key")).otherwise(F.xxhash64("key", "fp"))).sortWithinPartitions("key", "fp")
    return rows.mapInArrow(_units, "unit long, fp long").distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, fp) from (key, fp) sorted by both: the sets that share a key go to its least set's unit. A run of equal keys
    may span batches."""
    last_key = last_unit = None
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        begins = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        unit = np.where(run >= 0, fp[begins[np.maximum(run, 0)]] if len(begins) else 0, last_unit or 0)
        last_key, last_unit = key[-1], int(unit[-1])
        hot = key % 2 != 0
        met = (fp != unit) & ~hot
        units, members = np.concatenate([unit[met], unit[met], key[hot]]), np.concatenate([fp[met], unit[met], fp[hot]])
        both = np.unique(np.stack([units, members], 1), axis=0)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["unit", "fp"])


def deal(members: DataFrame, weight, limit: int) -> DataFrame:
    """(unit, fp) -> (unit, i, j, block, fp): each pair of sets of a unit whose sizes allow a link meets in one (unit, i, j)
    at least, which holds two blocks of about `limit` bytes, or a task's mean share, at most; i = j = -1 where the whole
    unit is within it. weight: bytes of a set of a size class. Blocks are runs of size classes; a class beyond the limit is cut by hash."""
    c = F.col("fp").bitwiseAND(255)
    counts = members.groupBy("unit", c.alias("c")).agg(F.count("*").alias("n")).withColumn("w", F.col("n") * weight(F.col("c")))
    total, most = counts.groupBy("unit").agg(F.sum("w").alias("w")).agg(F.sum("w"), F.max("w")).first()
    limit = min(limit, max(LEAST_BYTES, (total or 0) / int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if (most or 0) <= limit:
        place = {name: F.lit(-1).cast("long") for name in ("i", "j", "block")}
        return members.withColumns(place).select("unit", "i", "j", "block", "fp")
    whole, upto = Window.partitionBy("unit"), Window.partitionBy("unit").orderBy("c")  # 256 rows of a unit at most
    near = Window.partitionBy("unit").orderBy("c").rangeBetween(-CLASS_REACH, CLASS_REACH)
    cut = counts.withColumn("total", F.sum("w").over(whole)).where(F.col("total") > limit).withColumn("end", F.sum("w").over(upto))
    cut = cut.withColumns({"first": F.floor((F.col("end") - F.col("w")) / limit), "last": F.floor((F.col("end") - 1) / limit)})
    cut = cut.select("unit", "c", "first", "last", F.min("first").over(near).alias("lo"), F.max("last").over(near).alias("hi"))
    cut = stored(cut)
    few = small(cut, BROADCAST_BYTES)
    at = members.withColumn("c", c).join(F.broadcast(cut) if few else cut, ["unit", "c"], "left")
    at = at.withColumn("block", F.col("first") + F.pmod(F.xxhash64("fp", "unit"), F.col("last") - F.col("first") + 1))
    pairs = F.transform(F.sequence("lo", "hi"), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j")))
    at = at.withColumn("p", F.explode(F.when(F.col("block").isNull(), alone).otherwise(pairs)))
    return at.select("unit", "p.i", "p.j", F.coalesce("block", F.lit(-1)).alias("block"), "fp")


def _bits_weight(c):
    return F.lit(160.0) + F.pow(F.lit(1.25), (c + 1) / 2) / 3


def _set_weight(c):
    return F.lit(160.0) + F.pow(F.lit(1.25), (c + 1) / 2) * 8


def _groups(batches: Iterator[pa.RecordBatch], limit: int, payload: int) -> Iterator[tuple[tuple | None, list[tuple]]]:
    """Runs of rows with equal (unit, i, j), each as (key, rows without it); small units follow each other in one group,
    with key None, until their payload column reaches the limit."""
    key, rows, size = None, [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = row[:3] if row[1] >= 0 else None
            if rows and (own != key or own is None and size >= limit and row[0] != last):
                yield key, rows
                rows, size = [], 0
            key, last = own, row[0]
            rows.append(row[3:])
            size += len(row[payload]) + 160
    if rows:
        yield key, rows


def _sides(key: tuple | None, rows: list[tuple]) -> list[int]:
    """Of rows (block, ...) in sub-unit (unit, i, j)."""
    return [int(key is not None and key[1] != key[2] and r[0] == key[2]) for r in rows]


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, i, j, block, fp, fp2, n, bits): (cluster, fp) of sets with a possible partner. A cluster's number is its
    least fp, and is a different one for each pair of blocks of a large unit."""
    cluster: list[int] = []
    member: list[int] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array(member, pa.int64())], ["unit", "fp"])

    for key, rows in _groups(batches, BLOCK_BYTES, 7):
        rows = sorted({(r[0], r[1], r[2]): r for r in rows}.values(), key=lambda r: r[1])
        if len(rows) < 2:
            continue
        near, met = Union(len(rows)), set()
        for a, b in candidates([np.frombuffer(r[4], np.uint64) for r in rows], _sides(key, rows), [r[3] for r in rows], near):
            near.join(a, b)
            met |= {a, b}
        for k in sorted(met):
            label = rows[near.find(k)][1]
            if key is not None and key[1] != key[2]:
                label = int(mix(np.array([hash((*key, label)) & (1 << 64) - 1], np.uint64)).view(np.int64)[0])
            cluster.append(label)
            member.append(rows[k][1])
        if len(member) >= 10_000:
            yield out()
            cluster, member = [], []
    yield out()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (unit, i, j, block, fp, fp2, tokens): (a, b), a spanning forest of each block's links; nodes are (fp, fp2)."""
    node = pa.struct([("x", pa.int64()), ("y", pa.int64())])
    left, right = [], []
    for key, rows in _groups(batches, SET_BYTES, 6):
        rows = sorted({(r[0], r[1], r[2]): r for r in rows}.values(), key=lambda r: r[1:3])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        near = Union(len(rows))
        for a, b in candidates([bitmap(s) for s in sets], _sides(key, rows), [len(s) for s in sets], near):
            if near.find(a) != near.find(b):
                x, y = (sets[a], sets[b]) if len(sets[a]) < len(sets[b]) else (sets[b], sets[a])
                k = np.searchsorted(y, x)
                shared = int(np.count_nonzero(y[np.minimum(k, len(y) - 1)] == x))
                if 9 * shared >= 4 * (len(x) + len(y)):
                    near.join(a, b)
        for k, r in enumerate(rows):
            if near.find(k) != k:
                head = rows[near.find(k)]
                left.append({"x": head[1], "y": head[2]})
                right.append({"x": r[1], "y": r[2]})
    yield pa.RecordBatch.from_arrays([pa.array(left, node), pa.array(right, node)], ["a", "b"])


def _whole_sets(texts: DataFrame) -> DataFrame:
    """From (at, t): each block that a set is for, beside the set; repeated rows of a task give it once."""
    place = "unit long, i long, j long, block long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            at = 0
            for run_ in _runs(batch.column(1)):
                sets = shingle_sets(run_)
                fp, fp2 = fingerprints(sets)
                cols: list[list] = [[] for _ in range(7)]
                places = batch.column(0).slice(at, len(run_))
                for k in _new(fp, fp2, sets, seen):
                    for p in places[k].as_py():
                        if p["fp"] == fp[k]:
                            for c, v in zip(cols, (p["unit"], p["i"], p["j"], p["block"], fp[k], fp2[k], sets[k].tobytes()), strict=True):
                                c.append(v)
                at += len(run_)
                kinds = [*[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["unit", "i", "j", "block", "fp", "fp2", "tokens"])

    return texts.mapInArrow(run, f"{place}, fp long, fp2 long, tokens binary")


def link_forest(docs: DataFrame, sigs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(a, b): links between nodes (fp, fp2) that connect all that links connect."""
    scratch: list[str] = []
    units = stored(memberships(docs, text, hot_keys(sigs)), scratch)
    first = sigs.where(F.col("bits").isNotNull())
    bits = first.join(units.select("fp").distinct(), "fp", "left_semi").groupBy("fp", "fp2").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    rows = deal(units, _bits_weight, BLOCK_BYTES).join(bits, "fp").select("unit", "i", "j", "block", "fp", "fp2", "n", "bits")
    grouped = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    near = stored(grouped.mapInArrow(_possible, "unit long, fp long").distinct(), scratch)
    # one row stands for each set: that of the least id, told by id and hash of the text
    places = deal(near, _set_weight, SET_BYTES).groupBy("fp").agg(F.collect_list(F.struct("fp", "unit", "i", "j", "block")).alias("at"))
    wanted = first.join(places, "fp").groupBy("fp", "fp2").agg(F.min(F.struct("id", "h")).alias("x"), F.first("at").alias("at"))
    wanted = stored(wanted.groupBy(F.col("x.id").alias("_id"), F.col("x.h").alias("_h")).agg(F.flatten(F.collect_set("at")).alias("at")), scratch)
    few = small(wanted, BROADCAST_BYTES)
    same = (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id"))
    texts = _texts(docs, id_col, text).join(F.broadcast(wanted) if few else wanted, same).select("at", "t")
    final = _whole_sets(texts).repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    found = stored(final.mapInArrow(_links, "a struct<x long, y long>, b struct<x long, y long>"))
    discard(docs.sparkSession, scratch)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: id, n_shingles, component_id, fp and fp2 (the set's identity), root (the component's least identity).
    Components whose rows repeat an id may share the component_id, never the root."""
    sigs = stored(signatures(docs, id_col, text))
    roots = components(link_forest(docs, sigs, id_col, text))
    own = sigs.where("n > 0").groupBy("fp", "fp2").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    own = own.withColumn("node", F.struct(F.col("fp").alias("x"), F.col("fp2").alias("y"))).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(own.join(least, "root").select("fp", "fp2", "component_id", "root", "rows"))
    rows = sigs.where("n >= 0").select("id", F.col("n").alias("n_shingles"), "fp", "fp2")
    total = ids.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(ids.where(F.col("rows") * HOT_SHARE > total).drop("rows"))  # fewer than HOT_SHARE sets
    names = [id_col, "n_shingles", "component_id", "fp", "fp2", "root"]
    many = rows.where("n_shingles > 0").join(hot, ["fp", "fp2"]).select("id", *names[1:])
    others = rows.where("n_shingles > 0").join(ids.where(F.col("rows") * HOT_SHARE <= total).drop("rows"), ["fp", "fp2"]).select("id", *names[1:])
    none = rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), "fp", "fp2", F.lit(None).cast(ids.schema["root"].dataType).alias("root"))
    return many.unionAll(others).unionAll(none).toDF(*names)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows, one of each component: that of the least id, then the least identity. Wordless texts and
    null ids stay. Ids that several rows have are told apart by their sets, and one row of equal ones stays."""
    own_id = F.col(f"`{id_col}`")
    found = stored(near_duplicates(docs, id_col, text).where(own_id.isNotNull()).toDF("id", "n", "component", "fp", "fp2", "root"))
    repeated = stored(found.where("n > 0").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    gone = stored(found.where("component <> id").select("id").unionAll(repeated).distinct())
    rows = docs.select(F.struct("*").alias("row"), own_id.alias("id"), F.col(f"`{text}`").alias("t"))
    few = small(gone, BROADCAST_BYTES)
    out = rows.join(F.broadcast(gone) if few else gone, "id", "left_anti").select("row.*")
    if not repeated.isEmpty():
        again = rows.join(repeated, "id", "left_semi").select("id", "row", F.col("t").cast("binary").alias("t"))

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [fingerprints(shingle_sets(texts)) for texts in _runs(batch.column(2))]
                both = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *both], ["id", "row", "fp", "fp2"])

        schema = T.StructType([again.schema["id"], *beside(again.schema["row"].dataType, "fp long, fp2 long").fields])
        again = again.mapInArrow(prints, schema)
        wordless = again.where("fp = 0 AND fp2 = 0").select("row.*")
        heads = found.where("n > 0 AND component = id").groupBy("component", "root").agg(F.min(F.struct("fp", "fp2")).alias("x")).select(F.col("component").alias("id"), "x.fp", "x.fp2")
        one = again.join(heads, ["id", "fp", "fp2"]).groupBy("id", "fp", "fp2").agg(F.first("row").alias("row")).select("row.*")
        out = out.unionAll(wordless).unionAll(one)
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")
