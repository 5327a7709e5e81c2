"""python -m grainmill.cli list | OPERATOR --size N [N ...] --iterations K [--strategy S] [--report FILE] [--chart]"""

from __future__ import annotations

import argparse
import sys

from grainmill.harness import OPERATORS, RunConfig, measure, write_report
from grainmill.operators.join import STRATEGIES
from grainmill.operators.report import bar_chart, trimmed_mean
from grainmill.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="grainmill", description=__doc__)
    p.add_argument("operator")
    p.add_argument("--size", type=int, nargs="+", default=[1])
    p.add_argument("--iterations", type=int, default=1)
    p.add_argument("--strategy", choices=sorted(STRATEGIES))
    p.add_argument("--groups", type=int, default=64)
    p.add_argument("--executors", type=int, default=1024)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--chart", action="store_true", help="draw the trimmed mean seconds by number of rows")
    p.add_argument("--report", help="CSV file to append to; otherwise rows are printed")
    a = p.parse_args(argv)
    if a.operator == "list":
        print("\n".join(sorted(OPERATORS)))
        return 0
    if a.operator not in OPERATORS:
        print(f"unknown operator {a.operator}", file=sys.stderr)
        return 1
    config = RunConfig(a.operator, a.size, a.iterations, a.strategy, a.groups, a.executors, seed=a.seed)
    found = measure(local_session(), config)
    if a.report:
        write_report(a.report, found)
    else:
        for m in found:
            print(f"{m.operator} {m.strategy} rows={m.rows} seconds={m.seconds:.4f} executor={m.executor_seconds:.4f} build={m.build_seconds:.4f} probe={m.probe_seconds:.4f} group={m.group_seconds:.4f} reduce={m.reduce_seconds:.4f} valid={m.valid}")
    if a.chart:
        seconds = local_session().createDataFrame([(str(m.rows), m.strategy, m.seconds) for m in found], "rows string, strategy string, seconds double")
        means = trimmed_mean(seconds, "strategy", "rows", "seconds", sorted({str(m.rows) for m in found})).drop("strategy").first()
        print(bar_chart({k: None if means is None else means[k] for k in sorted({str(m.rows) for m in found})}))
    return int(not all(m.valid for m in found))


if __name__ == "__main__":
    sys.exit(main())
