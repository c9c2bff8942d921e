"""python -m tickforge.cli validate|run|runs|studio|backtest|factor|ensemble|gauntlet ...: bar files in, JSON out."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import example, from_dict
from tickforge.operators import backtest as bt
from tickforge.operators import books, factor, portfolio
from tickforge.plans.evolve import search
from tickforge.session import get_session
from tickforge.sources.bars import load_bars, numbered, quality_report, read_bars
from tickforge.sources.store import load_run, runs
from tickforge.studio import serve


def _bars(spark, path: str):
    return numbered(load_bars(spark, path), "timestamp")


def _top(run: str, n: int) -> list[dict]:
    """The n best records of a run; exits with 1 and a message in JSON if there are none."""
    try:
        found, damaged = load_run(run, n)
    except FileNotFoundError as e:
        print(json.dumps({"error": str(e)}))
        sys.exit(1)
    if damaged:
        print(f"{damaged} damaged files skipped", file=sys.stderr)
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tickforge")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "backtest", "run", "factor", "ensemble", "gauntlet"):
        s = sub.add_parser(name)
        s.add_argument("bars")
        if name == "run":
            s.add_argument("--out", required=True)
            s.add_argument("--population", type=int, default=12)
            s.add_argument("--generations", type=int, default=3)
            s.add_argument("--seed", type=int, default=42)
        if name in ("factor", "ensemble", "gauntlet"):
            s.add_argument("--run", required=True, help="folder of a run")
            s.add_argument("--top", type=int, default=5)
        if name == "ensemble":
            s.add_argument("--method", default="risk_parity", choices=list(portfolio.METHODS))
    s = sub.add_parser("runs")
    s.add_argument("folder")
    s = sub.add_parser("studio")
    s.add_argument("folder")
    s.add_argument("--port", type=int, default=8765)
    a = p.parse_args(argv)
    if a.command == "studio":
        serve(a.folder, port=a.port).serve_forever()
    if a.command == "runs":
        print(json.dumps(runs(a.folder)))
        return 0
    top = _top(a.run, a.top) if a.command in ("factor", "ensemble", "gauntlet") else []
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    bars = read_bars(spark, a.bars).withColumn("bar_idx", F.monotonically_increasing_id()) if a.command == "validate" else _bars(spark, a.bars)
    if a.command == "validate":
        rows = bars.withColumn("_ts", F.col("timestamp").try_cast("timestamp"))
        out = quality_report(rows, "symbol", "_ts", "bar_idx", "open", "high", "low", "close", "volume").first().asDict()
    elif a.command == "backtest":
        out = [r.asDict() for r in bt.metrics(bt.backtest(bars, example()), ["symbol"]).collect()]
    elif a.command == "run":
        out = search(bars, a.out, a.population, a.generations, a.seed)
    elif a.command == "factor":
        found = factor.analyze(evaluate(bars, {"signal": from_dict(top[0]["genome"])}), "signal")
        out = {"expression": top[0]["expression"], "factors": [r.asDict() for r in found.collect()]}
    elif a.command == "gauntlet":
        out = []
        for r in top:
            told = books.stress(bt.backtest(bars, from_dict(r["genome"])), bars)
            out += [{"strategy_id": r["strategy_id"]} | x.asDict() for x in told.collect()]
    else:
        runs_of = None
        for k, r in enumerate(top):
            one = bt.backtest(bars, from_dict(r["genome"])).groupBy("bar_idx").agg(F.avg("ret").alias("ret")).withColumn("strategy", F.lit(f"alpha_{k:03d}"))
            runs_of = one if runs_of is None else runs_of.unionByName(one)
        out = portfolio.ensemble(runs_of, {f"alpha_{k:03d}": r["test_metrics"]["sharpe"] for k, r in enumerate(top)}, a.method)
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
