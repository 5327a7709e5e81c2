"""Intermediate tables, sizes, spreading, running values over arrays."""

import itertools
import os
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from grainmill.llm import _arrays, _common, line_dedup, secret_scan


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_clusters_need_a_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        _common.shared_dir(session)


def test_a_set_folder_is_used_anywhere():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/shared/"), sparkContext=SimpleNamespace(master="yarn"))
    assert _common.shared_dir(session).startswith("hdfs://x/shared/") and _common.shared_dir(session) != _common.shared_dir(session)


def test_intermediate_files_can_be_discarded(spark):
    scratch = []
    df = _common.stored(spark.range(10), scratch)
    path = scratch[0].removeprefix("file:")
    assert df.count() == 10 and os.path.isdir(path)
    _common.discard(spark, scratch)
    assert not scratch and not os.path.exists(path)


def test_sizes_are_counted_in_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 100, b"12"), (2, None, None), (None, "é", b"")], "`a.b` long, s string, t binary")
    assert _common.small(df, 3 * 8 + 102 + 2) and not _common.small(df, 3 * 8 + 102 + 1)
    assert _common.small(df.limit(0), 0) and not _common.small(df, -1)


def test_small_tables_are_spread(spark, sf_dir):
    docs = _common.table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    assert _common.spread(docs).rdd.getNumPartitions() == cores and _common.spread(docs).count() == docs.count()
    wide = spark.range(0, 100, 1, cores)
    assert _common.spread(wide) is wide


def test_running_values(spark):
    r = random.Random(1)
    rows = [(k, [r.choice([None, r.randint(0, 99)]) for _ in range(k)]) for k in (0, 1, 2, 63, 64, 65, 128, 200)]
    df = spark.createDataFrame([*rows, (-1, None)], "k int, v array<int>")
    largest = _arrays.running(F.col("v"), "int", F.lit(None), F.greatest)
    total = _arrays.running(F.transform("v", lambda x: F.coalesce(x, F.lit(0))), "int", F.lit(0), lambda a, b: a + b)
    got = {x["k"]: x for x in df.select("k", largest.alias("a"), total.alias("b")).collect()}
    for k, v in rows:
        assert got[k]["b"] == list(itertools.accumulate(x or 0 for x in v))
        assert got[k]["a"] == list(itertools.accumulate(v, lambda a, b: max((x for x in (a, b) if x is not None), default=None)))
    assert got[-1]["a"] == []


def fastest(run):
    took = []
    for _ in range(3):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return min(took)


def test_long_texts_cost_in_proportion(spark):
    """Twice the matches, or twice the lines, take about twice as long."""

    def secrets(n):
        text = " ".join(f"AKIA{i:016d} at https://h{i}.x/ ABCD1234EFGH{i:08d}" for i in range(n))
        return secret_scan.redact(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1))

    def lines(n):
        text = "\n".join(f"line {i}" if i % 2 else f"footer {i % 500}" for i in range(n))
        return line_dedup.drop_boilerplate(spark.createDataFrame([(i, "h", text) for i in range(6)], "doc_id long, source string, text string").coalesce(1))

    for make, n in ((secrets, 1500), (lines, 3000)):
        once, twice = (fastest(lambda df=make(m): df.write.format("noop").mode("overwrite").save()) for m in (n, 2 * n))
        assert twice <= 2.6 * once + 0.5


def test_large_states_of_other_operators_go():
    from grainmill.llm import _common

    kept = {("packing", None): object(), ("codec", "x"): object(), "letters": object()}
    old = dict(_common.WORKER_STATE)
    try:
        _common.WORKER_STATE.clear()
        _common.WORKER_STATE.update(kept)
        _common.drop_states(but=("codec", "x"))
        assert set(_common.WORKER_STATE) == {("codec", "x"), "letters"}
        _common.drop_states()
        assert set(_common.WORKER_STATE) == {"letters"}
    finally:
        _common.WORKER_STATE.clear()
        _common.WORKER_STATE.update(old)


@pytest.mark.parametrize("keep", [None, ["doc_id"], ["text", "a.b"]])
def test_toxicity_sends_a_kept_text_once(spark, keep):
    from grainmill.llm import toxicity

    lex = toxicity.Lexicon(["idiot"], [5.0], curve=(1.0, -2.0), base=0.1)
    rows = [(k, ["you idiot", "fine words", None, ""][k % 4], k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    out = toxicity.score(docs, lex, keep=keep)
    sent = out._jdf.queryExecution().analyzed().children().head().output().size()
    assert sent == (2 if keep == ["doc_id"] else 1)
    names = keep or docs.columns
    got = {}
    for r in out.collect():
        own = r["row"].asDict()
        assert list(own) == names
        k = own.get("doc_id", own.get("a.b"))
        assert own == {n: dict(zip(docs.columns, rows[k], strict=True))[n] for n in names}
        got[k] = r["n_hits"]
    assert got == {k: int(k % 4 == 0) for k in range(40)}
