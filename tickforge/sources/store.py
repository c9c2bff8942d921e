"""Stored strategies: JSON records in and out, an index that keeps the last of each, SQL over it, reports and exports."""

from __future__ import annotations

import html
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickforge.functions.expr import from_dict, pretty


def write(path: Path, content: dict) -> None:
    """content as JSON, written beside path first and then moved, so that no reader sees half of it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(content, indent=1))
    os.replace(part, path)


def save_candidate(folder: Path, record: dict) -> None:
    """A record as strategies/{id}_g{generation}_i{index}.json, and as one more line of strategies.jsonl."""
    write(folder / "strategies" / f"{record['strategy_id']}_g{record['generation']}_i{record['index']}.json", record)
    with (folder / "strategies.jsonl").open("a") as log:
        log.write(json.dumps(record) + "\n")


def load_run(folder: str, top: int | None = None) -> tuple[list[dict], int]:
    """(records of a run's strategies folder by falling test Sharpe ratio, how many files were damaged); FileNotFoundError if there is none to read."""
    files, records, damaged = sorted((Path(folder) / "strategies").glob("*.json")), [], 0
    for path in files:
        try:
            records.append(json.loads(path.read_text()))
        except (ValueError, OSError):
            damaged += 1
    if not records:
        raise FileNotFoundError(f"no strategies in {folder}" + f", {damaged} damaged" * bool(damaged))
    records.sort(key=lambda r: -(r.get("test_metrics") or {}).get("sharpe", 0.0))
    return records[:top], damaged


def runs(folder: str) -> list[dict]:
    """The runs below a folder that have a summary: name, candidates, the best's train Sharpe ratio and the sizes of the fronts; damaged ones are left out."""
    out = []
    for path in sorted(Path(folder).glob("*/summary.json")):
        try:
            told = json.loads(path.read_text())
        except (ValueError, OSError):
            continue
        best = told.get("best") or {}
        out.append({"run": path.parent.name, "candidates": told.get("candidates"), "best": best.get("strategy_id"), "sharpe": (best.get("train_metrics") or {}).get("sharpe"), "front_sizes": told.get("front_sizes", [])})
    return out


def top_report(folder: str, path: str, n: int = 10) -> list[dict]:
    """report of a run's n best strategies by test Sharpe ratio."""
    rows = [{"strategy_id": r["strategy_id"], "expression": r["expression"], "complexity": r["complexity"], **{f"test_{k}": r["test_metrics"].get(k) for k in ("sharpe", "max_drawdown", "total_return")}} for r in load_run(folder, n)[0]]
    report(rows, path, "Best strategies")
    return rows


def save(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines, one folder per generation."""
    records.write.mode("append").partitionBy("generation").json(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files; damaged ones are left out."""
    raw = spark.read.schema(schema + ", _damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_damaged").option("allowNonNumericNumbers", True).json(path)
    return raw.filter("_damaged is null").drop("_damaged")


def index(records: DataFrame, arrival: str = "ingest_id") -> DataFrame:
    """The last record of each (strategy_id, generation)."""
    w = Window.partitionBy("strategy_id", "generation").orderBy(F.col(arrival).desc())
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def query(records: DataFrame, sql: str) -> DataFrame:
    """Any SQL over the records as the view ``strategies``."""
    records.createOrReplaceTempView("strategies")
    return records.sparkSession.sql(sql)


def report(rows: list[dict], path: str, title: str = "Strategies") -> None:
    """path.html and path.md: a table of rows, which must be few."""
    cols = list(rows[0]) if rows else []
    cells = lambda tag, xs: "".join(f"<{tag}>{html.escape(str(x))}</{tag}>" for x in xs)
    body = "".join(f"<tr>{cells('td', r.values())}</tr>" for r in rows)
    Path(path + ".html").write_text(f"<h1>{html.escape(title)}</h1><table><tr>{cells('th', cols)}</tr>{body}</table>")
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(str(x) for x in r.values()) + " |" for r in rows)]
    Path(path + ".md").write_text("\n".join(lines) + "\n")


def _yaml(x, depth: int = 0) -> str:
    pad = "  " * depth
    if isinstance(x, dict) and x:
        return "".join(f"{pad}{k}:" + (f"\n{_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {json.dumps(v)}\n") for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"{pad}-" + (f"\n{_yaml(v, depth + 1)}" if isinstance(v, dict | list) and v else f" {json.dumps(v)}\n") for v in x)
    return f"{pad}{json.dumps(x)}\n"


def export(record: dict, path: str) -> None:
    """One record as .json, .yaml, .py (a module with its genome) or .ipynb; ValueError for other suffixes."""
    kind, text = Path(path).suffix, json.dumps(record, indent=1)
    code = f"from tickforge.functions.expr import from_dict\n\nGENOME = from_dict({record['genome']!r})  # {pretty(from_dict(record['genome']))}\n"
    if kind == ".yaml":
        text = _yaml(record)
    elif kind == ".py":
        text = code
    elif kind == ".ipynb":
        text = json.dumps({"cells": [{"cell_type": "code", "metadata": {}, "outputs": [], "execution_count": None, "source": code.splitlines(keepends=True)}], "metadata": {}, "nbformat": 4, "nbformat_minor": 5})
    elif kind != ".json":
        raise ValueError(f"no export to {kind}")
    Path(path).write_text(text)
