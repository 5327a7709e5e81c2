"""Operator 5 (native): line dedup by site-relative frequency.

For each host, the pages that hold a line are counted once per page and divided by the host's pages; lines above
the boilerplate ratio, and on LEAST pages at least, are dropped from that host's pages. Lines are compared without
surrounding white space (blanks, tabs, carriage returns, form feeds, vertical tabs) and case-sensitively, by two 64-bit
hashes; blank lines are layout and stay.

Counting shuffles 24 bytes per distinct line of a task, after partial aggregation, so a hot host or a hot line
costs no more than others. What is to be dropped is small: lines with a share above r can number at most
(lines per page) / r for each host. It is written once; below BROADCAST_BYTES, which is checked, it is broadcast
and texts never move. Beyond, hosts are salted on both sides of an ordinary join.

Within a page the host's list is first intersected with the page's lines by hash; only a page with a hit sorts both
together and keeps the lines that follow no equal mark, so long pages and long lists cost n log n.

Defined cases: null host: the page stays as it is; null text stays null and counts as a page; equal rows count as pages
each; an empty table gives no rows. Input columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._arrays import let, running
from grainmill.llm._common import stored, table

BROADCAST_BYTES = 8 << 20
SALTS = 32
RATIO, LEAST = 0.05, 3
SPACE = " \t\r\f\x0b"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    bare = _bare(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """Per host with any: host, sorted array of keys of the lines to drop, and the keys' first halves."""
    known = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where(F.col("host").isNotNull())
    totals = known.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _bare(x) != ""), _key))
    counts = known.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= least).withColumn("salt", F.pmod(F.col("key.a"), F.lit(SALTS)))
    totals = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    over = counts.join(totals, ["host", "salt"]).where(F.col("n") > ratio * F.col("pages"))
    keys = F.sort_array(F.collect_list("key"))  # at most (lines per page) / ratio
    return over.groupBy("host").agg(keys.alias("keys")).withColumn("firsts", F.col("keys.a"))


def _kept(lines: Column, keys: Column) -> Column:
    """The lines, in order, whose key is not among the keys."""
    marks = F.transform(keys, lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), F.lit(-1).alias("i"), F.lit(None).cast("string").alias("line")))

    def own(x: Column, i: Column) -> Column:
        key = F.when(_bare(x) != "", _key(x))  # a blank line has none
        return F.struct(key["a"].alias("a"), key["b"].alias("b"), i.alias("i"), x.alias("line"))

    def after_marks(every: Column) -> Column:
        last = running(F.transform(every, lambda x: F.when(x["i"] < 0, F.struct(x["a"], x["b"]))), "struct<a:long,b:long>", F.lit(None), F.greatest)
        rows = F.arrays_zip(every.alias("x"), last.alias("m"))
        stays = lambda z: (z["x"]["i"] >= 0) & ~F.coalesce((z["x"]["a"] == z["m"]["a"]) & (z["x"]["b"] == z["m"]["b"]), F.lit(False))
        return F.transform(F.filter(rows, stays), lambda z: F.struct(z["x"]["i"].alias("i"), z["x"]["line"].alias("line")))

    kept = let(F.array_sort(F.concat(marks, F.transform(lines, own))), after_marks)
    return F.transform(F.array_sort(kept), lambda x: x["line"])


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """row: a struct of all input columns; text: the cleaned text; n_lines and n_dropped."""
    drop = stored(boilerplate(docs, host, text, ratio, least))
    size = drop.agg(F.coalesce(F.sum(F.size("keys") * 24 + F.octet_length("host") + 32), F.lit(0)).alias("n")).first()["n"]
    df = docs.select(F.struct("*").alias("row"), F.col(f"`{host}`").alias("own"), F.col(f"`{text}`").alias("text"))
    if size <= BROADCAST_BYTES:
        df = df.join(F.broadcast(drop), F.col("own") == F.col("host"), "left")
    else:
        salted = drop.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        df = df.withColumn("own_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        df = df.join(salted, (F.col("own") == F.col("host")) & (F.col("own_salt") == F.col("salt")), "left")
    hit = F.arrays_overlap(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(_bare(x))), F.col("firsts"))
    df = df.withColumn("kept", F.when(F.col("keys").isNotNull() & hit, _kept(_lines(F.col("text")), F.col("keys"))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    gone = F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept"))
    clean = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))
    return df.withColumns({"n_lines": n, "n_dropped": gone}).select("row", clean.alias("text"), "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, SHA-256 of the cleaned text (null: of the empty text)."""
    df = drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return df.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_SPACE = "concat(' ', chr(9), chr(13), chr(12), chr(11))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
held AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT i, source, line FROM (SELECT i, source, trim(unnest(lines), {_SPACE}) AS line FROM d)) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT source, line FROM held JOIN pages USING (source) WHERE n >= {LEAST} AND n > {RATIO} * pages),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
kept AS (SELECT i, doc_id, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, trim(x, {_SPACE}))) END AS kept FROM d LEFT JOIN lists USING (source))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS text_sha256 FROM kept"""
