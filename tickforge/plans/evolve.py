"""Evolutionary search: the population lives on the driver, each generation is evaluated in one Spark plan."""

from __future__ import annotations

import json
import random
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.compiler import evaluate
from tickforge.functions.expr import REGISTERED, Binary, Node, Primitive, example, from_dict, pretty, shifted, strategy_id, to_dict
from tickforge.operators.backtest import BOUNDS, METRICS, Execution, curve, fold_bars, metrics, split_parts, with_costs
from tickforge.operators.research import monte_carlo
from tickforge.session import materialize
from tickforge.sources import store
from tickforge.sources.bars import manifest, quality_report


def _curves(bars: DataFrame, genomes: list[Node], execution: Execution | None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The curves of all genomes over each series: their shared primitives are columns of one plan, then one curve per candidate."""
    named = {f"_c{i}": g for i, g in enumerate(genomes)}
    wide = evaluate(bars, named, keys, price_only=True)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(n).alias("signal")) for i, n in enumerate(named)])).alias("_s")
    return curve(wide.select(*keys, "bar_idx", "close", each).select(*keys, "bar_idx", "close", "_s.*"), [*keys, "candidate"], execution)


def scored(bars: DataFrame, genomes: list[Node], execution: Execution | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, candidate, metrics) of all genomes."""
    return metrics(_curves(bars, genomes, execution, keys), [*keys, "candidate"])


def _told(found: DataFrame, by: list[str]) -> dict[tuple, dict]:
    """The metrics by candidate and ``by``, averaged over symbols; few rows, as they follow the population."""
    rows = found.groupBy("candidate", *by).agg(*[F.avg(m).alias(m) for m in METRICS]).collect()
    return {tuple(r[k] for k in ("candidate", *by)): {m: int(r[m]) if m == "trades" else r[m] for m in METRICS} for r in rows}


def records(bars: DataFrame, genomes: list[Node], generation: int, parents: list[list[str]], execution: Execution | None = None, train: float = 0.8, folds: int = 3, sims: int = 20, seed: int = 42) -> list[dict]:
    """A whole record per genome: train and test metrics of a chronological split, walk-forward and purged validation over all bars, and the
    robustness suite on the test part. Each kind is one plan for the whole population."""
    ex = execution or Execution()
    costs = {"commission_bps": ex.commission_bps, "spread_bps": ex.spread_bps, "slippage_bps": ex.slippage_bps, "impact_bps_per_turnover": ex.impact_bps, "delay_bars": ex.delay_bars, "funding_bps_per_bar": ex.funding_bps, "borrow_bps_per_bar": ex.borrow_bps}
    split = split_parts(bars, train)
    sides = _told(scored(split, genomes, ex, ("symbol", "later")), ["later"])
    test = split.filter("later").drop("later")
    checks, at = {}, {}
    for kind, name in (("walk_forward", "walk_forward"), ("purged", "purged_cross_validation")):
        cut = fold_bars(bars, kind, folds)
        checks[name] = _told(scored(cut.drop(*BOUNDS), genomes, ex, ("symbol", "fold")), ["fold"])
        at[name] = {r["fold"]: {b: int(r[b]) for b in BOUNDS} for r in cut.groupBy("fold").agg(*[F.max(b).alias(b) for b in BOUNDS]).collect()}
    base = materialize(_curves(test, genomes, ex).drop("_shard"), "curves")
    cheap = _told(with_costs(base, ["symbol", "candidate"], ex), ["multiplier"])
    deltas = (-3, -2, -1, 0, 1, 2, 3)
    moved = _told(scored(test, [shifted(g, d) for g in genomes for d in deltas], ex), [])
    drawn: dict[int, dict] = {}
    quantiles = monte_carlo(base.filter("bar_idx > 0"), ["symbol", "candidate"], sims, seed + generation * 1000)
    for r in quantiles.groupBy("candidate", "metric").agg(*[F.avg(q).alias(q) for q in ("p05", "p50", "p95")]).collect():
        drawn.setdefault(r["candidate"], {})[r["metric"]] = {q: r[q] for q in ("p05", "p50", "p95")}
    none, out = dict.fromkeys(METRICS, 0.0), []
    for i, g in enumerate(genomes):
        validation = {}
        for name, found in checks.items():
            details = [{"fold": k, **at[name][k], "metrics": found[i, k]} for k in sorted(at[name]) if (i, k) in found]
            mean = {m: sum(x["metrics"][m] for x in details) / len(details) for m in METRICS} if details else {}
            validation[name] = {"method": name, "folds": len(details), "metrics": mean, "fold_details": details}
        suite = {
            "cost_sensitivity": {"method": "cost_sensitivity", "scenarios": [{"cost_multiplier": m, "metrics": cheap[i, m]} for k, m in sorted(cheap) if k == i]},
            "parameter_sensitivity": {"method": "parameter_sensitivity", "scenarios": [{"delta": d, "metrics": moved.get((i * len(deltas) + k,), none)} for k, d in enumerate(deltas)]},
            "monte_carlo": {"method": "monte_carlo_trade_reshuffle", "simulations": sims, "seed": seed + generation * 1000, "quantiles": drawn.get(i, {})},
        }
        out.append({
            "strategy_id": strategy_id(g), "generation": generation, "index": i, "genome": to_dict(g), "expression": pretty(g), "complexity": g.complexity(), "parents": parents[i],
            "train_metrics": sides.get((i, False), none) | {"complexity": g.complexity()}, "test_metrics": sides.get((i, True), none) | {"complexity": g.complexity()},
            "execution": costs, "validation": validation, "robustness": suite, "status": "evaluated", "warnings": [],
        })
    return out


def mutated(node: Node, rng: random.Random) -> Node:
    """node with one period moved by up to 5, or one primitive replaced, on one random path."""
    if isinstance(node, Binary):
        side = rng.random() < 0.5
        return Binary(node.op, mutated(node.left, rng) if side else node.left, node.right if side else mutated(node.right, rng))
    if isinstance(node, Primitive):
        return Primitive(node.name if rng.random() < 0.7 else rng.choice(REGISTERED), max(2, node.period + rng.randint(-5, 5)))
    return node


def crossed(a: Node, b: Node, rng: random.Random, most: int = 15) -> Node:
    """A random side of a beside one of b; a itself if that grew beyond ``most`` nodes."""
    pick = lambda n: rng.choice(n.children()) if n.children() else n
    child = Binary(rng.choice("+-*/"), pick(a), pick(b))
    return child if child.complexity() <= most else a


def dominates(a: tuple, b: tuple) -> bool:
    """Whether a is at least as good as b everywhere (all to be minimised) and better somewhere."""
    return all(x <= y for x, y in zip(a, b, strict=True)) and a != b


def layers(points: list[tuple]) -> list[list[int]]:
    rest, out = set(range(len(points))), []
    while rest:
        front = [i for i in rest if not any(dominates(points[j], points[i]) for j in rest)]
        out.append(sorted(front))
        rest -= set(front)
    return out


def search(bars: DataFrame, out: str, population: int = 12, generations: int = 3, seed: int = 42, execution: Execution | None = None, start: Node | None = None) -> dict:
    """Runs the search and writes manifest.json, a file per candidate and strategies.jsonl, checkpoint.json and summary.json to the folder out; resumes
    from a checkpoint there. Candidates are selected by their metrics on the train part alone."""
    folder = Path(out)
    mark, first, rng = folder / "checkpoint.json", 0, random.Random(seed)
    if mark.exists():
        saved = json.loads(mark.read_text())
        first, group, parents = saved["generation"], [from_dict(g) for g in saved["population"]], saved["parents"]
    else:
        group, parents = [mutated(start or example(), rng) for _ in range(population)], [[] for _ in range(population)]
        report = quality_report(bars, "symbol", "bar_idx", "bar_idx", "open", "high", "low", "close", "volume") if "open" in bars.columns else None
        digest = manifest(bars, "bars", [c for c in ("symbol", "bar_idx", "close") if c in bars.columns]).first().asDict()
        store.write(folder / "manifest.json", {"seed": seed, "population": population, "generations": generations, "dataset": digest, "quality": report.first().asDict() if report else {}})
    best, sizes = None, []
    for generation in range(first, generations):
        told = records(bars, group, generation, parents, execution, seed=seed)
        for record in told:
            store.save_candidate(folder, record)
            if best is None or record["train_metrics"]["sharpe"] > best["train_metrics"]["sharpe"]:
                best = record
        points = [(-r["train_metrics"]["sharpe"], r["train_metrics"]["max_drawdown"], r["complexity"]) for r in told]
        fronts = layers(points)
        sizes.append(len(fronts[0]))
        ranked = [i for front in fronts for i in sorted(front, key=lambda i: points[i])]
        elite = [group[i] for i in ranked[: max(1, population // 4)]]
        group, parents = list(elite), [[strategy_id(e)] for e in elite]
        while len(group) < population:
            a, b = rng.choice(elite), rng.choice(elite)
            both = rng.random() < 0.5
            group.append(mutated(crossed(a, b, rng) if both else a, rng))
            parents.append([strategy_id(x) for x in ((a, b) if both else (a,))])
        store.write(mark, {"generation": generation + 1, "population": [to_dict(g) for g in group], "parents": parents})
    summary = {"best": best, "front_sizes": sizes, "candidates": population * max(0, generations - first)}
    store.write(folder / "summary.json", summary)
    return summary
