"""Queries of the data problems on small fixtures."""

import json

from tickforge.plans import problems


def test_tables_of_records_hold_every_field(spark, tmp_path):
    metrics = lambda k: {"sharpe": k + 0.5, "sortino": float("inf"), "total_return": k / 8, "max_drawdown": 0.25, "turnover": 0.125, "trades": k, "costs_paid": 0.0625}
    record = {
        "genome": {"type": "constant", "value": 1.5, "meta": {"origin": {"type": "seed", "round": 2}, "note": "kept"}},
        "validation": {"walk_forward": {"fold_details": [{"fold": 0, "train_start": 0, "train_end": 5, "test_start": 5, "test_end": 9, "metrics": metrics(3)}]}},
        "robustness": {"cost_sensitivity": {"scenarios": [{"cost_multiplier": 2.0, "metrics": metrics(4)}]}, "parameter_sensitivity": {"scenarios": [{"delta": -1, "metrics": metrics(5)}]}},
    }
    spark.createDataFrame([(1, json.dumps(record))], "record_id long, payload string").write.parquet(f"{tmp_path}/strategy_records.parquet")
    d = str(tmp_path)
    fold = problems.p6_folds(spark, d).first()
    assert {k: fold[f"metrics__{k}"] for k in metrics(3)} == metrics(3) and fold["test_end"] == 9
    scenarios = {r["delta"]: r for r in problems.p6_scenarios(spark, d).collect()}
    assert all({k: scenarios[x][f"metrics__{k}"] for k in metrics(n)} == metrics(n) for x, n in ((None, 4), (-1, 5)))
    node = problems.p6_nodes(spark, d).first()
    assert (node["meta__origin__type"], node["meta__origin__round"], node["value"]) == ("seed", 2, 1.5)
    fields = {(r["kind"], r["node_path"], r["field"]): r["value"] for r in problems.p6_fields(spark, d).collect()}
    assert fields[("node", "/genome", "meta/note")] == "kept" and len(fields) == 5 + 12 + 8 + 8
