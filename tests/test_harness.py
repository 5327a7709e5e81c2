import csv
from collections import Counter

import pytest

from grainmill import cli
from grainmill.harness import OPERATORS, RunConfig, measure, random_seed, write_report
from grainmill.operators import aggregate, scan
from grainmill.operators.report import bar_chart
from grainmill.sources import constant_column, ramp, random_bits, random_ints, read_csv, unique_ints


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_are_valid(spark, name):
    found = measure(spark, RunConfig(name, sizes=[0, 1, 257], groups=8, executors=4))
    assert [m.rows for m in found] == [0, 1, 257] and all(m.valid for m in found)


def test_report_file_has_one_header(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    for _ in range(2):
        write_report(path, measure(spark, RunConfig("reduce", sizes=[10], iterations=2)))
    rows = list(csv.DictReader(open(path)))
    assert len(rows) == 4 and {r["rows"] for r in rows} == {"10"} and {r["bytes"] for r in rows} == {"80"}
    assert read_csv(spark, path).where("valid AND executor_seconds > 0").count() == 4


def test_unknown_operators(spark, capsys):
    with pytest.raises(ValueError):
        measure(spark, RunConfig("nothing"))
    assert cli.main(["nothing"]) == 1 and cli.main(["list"]) == 0
    assert "group_by" in capsys.readouterr().out


def test_chart_of_trimmed_means(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert bar_chart({"cpu": 2.0, "gpu": 1.0, "none": None}, 4) == "cpu  #### 2\ngpu  ##   1\nnone      -"
    assert cli.main(["reduce", "--size", "5", "60", "--iterations", "3", "--chart"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert [x.split()[0] for x in lines[-2:]] == ["5", "60"] and any("#" * 40 in x for x in lines[-2:])


def test_generators_are_seeded(spark):
    a, b = (sorted(map(tuple, random_ints(spark, 500, 1, 50, 3).collect())) for _ in range(2))
    assert a == b and {x for _, x in a} <= set(range(1, 51))
    keys = [r["k"] for r in unique_ints(spark, 300, 1, "k").orderBy("row_id").collect()]
    assert len(keys) == 300 and keys == sorted(set(keys)) and 0 <= keys[0] and keys[-1] < 3000
    decades = Counter(k // 10 for k in keys)
    assert max(decades.values()) > 1 and len(decades) < 260  # not one for each decade
    assert [unique_ints(spark, n, 4).count() for n in (0, 1, 2, 7)] == [0, 1, 2, 7]
    assert {r["x"] for r in random_bits(spark, 200).collect()} == {0, 1}
    assert [r["x"] for r in ramp(spark, 5).orderBy("row_id").collect()] == [0, 1, 2, 3, 4]
    assert [r["x"] for r in constant_column(spark, 2, -1).collect()] == [-1, -1]
    assert random_seed(4) == random_seed(4) and 1 <= random_seed(4) <= 1000


def test_operators_take_streams(spark, tmp_path):
    random_ints(spark, 100, 0, 9, 1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x long").parquet(str(tmp_path / "in"))
    sums = aggregate.group_sum(scan.scan_less_than(stream, "x", 5), "x", "row_id")
    q = sums.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = Counter()
    for r in random_ints(spark, 100, 0, 9, 1).collect():
        if r["x"] < 5:
            want[r["x"]] += r["row_id"]
    assert {r["x"]: r["s"] for r in spark.table("sums").collect()} == dict(want)
