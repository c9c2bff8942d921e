"""Streams, stores, search, command line and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from tickforge import governance as gov
from tickforge.functions.expr import Primitive
from tickforge.plans.evolve import search
from tickforge.sources import store
from tickforge.sources.bars import synthetic_bars
from tickforge.sources.vendor import Connectors, VendorBars, fetch, lineage
from tickforge.streaming import audit
from tickforge.streaming.bars import session_bars, window_bars
from tickforge.streaming.runner import run_batch, run_stream


def _drain(query, spark, name):
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_runner_stream_equals_batch(spark, tmp_path):
    bars = synthetic_bars(spark, 60).selectExpr("symbol", "bar_idx as bar_ts", "close", "high", "low", "volume")
    for k in range(3):
        bars.filter(f"bar_ts >= {20 * k} and bar_ts < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    g = Primitive("SMA", 3) - Primitive("SMA", 8)
    batch = sorted(map(tuple, run_batch(bars, g).collect()), key=str)
    source = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = _drain(run_stream(source, g).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start(), spark, "steps")
    assert sorted(map(tuple, rows), key=str) == batch
    assert {r[2] for r in batch} >= {"warming_up", "filled", "no_change"}
    fills = [r for r in batch if r[2] == "filled"]
    assert any(r[4] < 0 for r in fills) and any(r[4] > 0 for r in fills)  # sells fill too


def test_window_bars_stream(spark, tmp_path):
    e = spark.range(200).select(F.lit("X").alias("symbol"), F.expr("timestamp_seconds(id * 60)").alias("ts"), (100 + F.col("id") % 7).cast("double").alias("px"))
    e.write.parquet(str(tmp_path / "in"))
    batch = {(r["start"], r["open"], r["volume"]) for r in window_bars(e).collect()}
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    rows = _drain(window_bars(stream).writeStream.format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").start(), spark, "hours")
    assert {(r["start"], r["open"], r["volume"]) for r in rows} == batch and len(batch) == 4
    assert window_bars(e, "1 hour", "30 minutes").count() > 4
    assert [r["volume"] for r in session_bars(e, "2 minutes").collect()] == [200.0]


def test_audit(spark):
    e = spark.createDataFrame([("a", i, "runner", "fill", str(i)) for i in range(5)] + [("b", 0, None, "x", None)], "log string, seq int, actor string, action string, payload string")
    chain = audit.chained(e)
    assert {r["log"]: r["intact"] for r in audit.verified(chain).collect()} == {"a": True, "b": True}
    forged = chain.withColumn("payload", F.when(F.col("seq") == 2, "9").otherwise(F.col("payload")))
    assert {r["log"]: r["intact"] for r in audit.verified(forged).collect()} == {"a": False, "b": True}


def test_search_store_and_cli(spark, tmp_path, capsys):
    from tickforge import cli

    bars = synthetic_bars(spark, 120)
    start = Primitive("SMA", 4) - Primitive("SMA", 12)
    first = search(bars, str(tmp_path / "run"), 4, 1, start=start)
    again = search(bars, str(tmp_path / "run"), 4, 2, start=start)
    run = str(tmp_path / "run")
    lines = (tmp_path / "run" / "strategies.jsonl").read_text().splitlines()
    assert len(lines) == 8 and first["candidates"] == again["candidates"] == 4
    record = json.loads(lines[-1])
    assert record["parents"] and set(record["train_metrics"]) >= {"sharpe", "trades", "complexity"} and record["status"] == "evaluated"
    for kind in ("walk_forward", "purged_cross_validation"):
        details = record["validation"][kind]["fold_details"]
        assert len(details) == 3 and details[0]["test_end"] > details[0]["test_start"] and "sharpe" in details[0]["metrics"]
    suite = record["robustness"]
    assert [x["cost_multiplier"] for x in suite["cost_sensitivity"]["scenarios"]] == [0.5, 1.0, 1.5, 2.0, 3.0] and [x["delta"] for x in suite["parameter_sensitivity"]["scenarios"]] == [-3, -2, -1, 0, 1, 2, 3]
    assert set(suite["monte_carlo"]["quantiles"]) == {"sharpe", "total_return", "max_drawdown"}
    from tickforge.operators import backtest as bt
    from tickforge.functions.expr import from_dict

    part = bars.filter("bar_idx < 96")
    alone = bt.metrics(bt.backtest(part, from_dict(record["genome"])), ["symbol"]).first()
    assert all(abs(record["train_metrics"][k] - alone[k]) < 1e-9 for k in ("sharpe", "total_return", "costs_paid"))
    (tmp_path / "run" / "strategies" / "broken.json").write_text("{")
    found, damaged = store.load_run(run, 5)
    assert len(found) == 5 and damaged == 1 and [r["test_metrics"]["sharpe"] for r in found] == sorted((r["test_metrics"]["sharpe"] for r in found), reverse=True)
    assert [r["run"] for r in store.runs(str(tmp_path))] == ["run"] and len(store.top_report(run, str(tmp_path / "top"), 3)) == 3
    with pytest.raises(SystemExit):
        cli.main(["gauntlet", "x.csv", "--run", str(tmp_path)])
    capsys.readouterr()
    csv = tmp_path / "bars.csv"
    rows = ["timestamp,symbol,open,high,low,close,volume"] + [f"2024-01-{1 + r['bar_idx'] // 24:02d}T{r['bar_idx'] % 24:02d}:00:00,S,{r['open']},{r['high']},{r['low']},{r['close']},{r['volume']}" for r in bars.orderBy("bar_idx").collect()]
    csv.write_text("\n".join(rows))
    for args in (["validate", str(csv)], ["backtest", str(csv)], ["factor", str(csv), "--run", run], ["ensemble", str(csv), "--run", run, "--top", "3"], ["gauntlet", str(csv), "--run", run, "--top", "2"], ["runs", str(tmp_path)]):
        assert cli.main(args) == 0
        out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert out
    record = json.loads(lines[0])
    for kind in ("json", "yaml", "py", "ipynb"):
        store.export(record, str(tmp_path / f"x.{kind}"))
    with pytest.raises(ValueError):
        store.export(record, str(tmp_path / "x.doc"))
    store.report([{"a": "<b>", "n": 1}], str(tmp_path / "r"))
    assert "&lt;b&gt;" in (tmp_path / "r.html").read_text()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"strategy_id": "s", "generation": 1, "ingest_id": 1}\n{broken\n{"strategy_id": "s", "generation": 1, "ingest_id": 2}\n')
    found = store.load(spark, str(tmp_path / "bad"), "strategy_id string, generation int, ingest_id long")
    assert [r["ingest_id"] for r in store.index(found.cache()).collect()] == [2]
    assert store.query(found, "SELECT count(*) AS n FROM strategies").first()["n"] == 2
    store.save(found, str(tmp_path / "saved"))
    assert spark.read.json(str(tmp_path / "saved")).count() == 2


def test_vendor(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps([{"timestamp": "2024-01-01", "symbol": "X", "open": 1, "high": 2, "low": 1, "close": 2, "volume": None}]))
    spark.dataSource.register(VendorBars)
    got = spark.read.format("vendor_bars").option("urls", f"file://{path}").load().collect()
    assert got[0]["close"] == 2.0 and got[0]["volume"] is None
    with pytest.raises(OSError):
        fetch("file:///no/where", 2, 0.01)
    assert lineage(path.read_bytes(), "v", "1", True)["survivorship_safe"]
    c = Connectors()
    c.register("a", lambda s, o: s.range(o["n"]))
    assert c.names() == ["a"] and c.load("a", spark, n=3).count() == 3
    with pytest.raises(KeyError):
        c.load("b", spark)


def test_contracts(monkeypatch):
    k = gov.KillSwitch()
    k.trip("x")
    assert not k.allow()
    for gate, ok in ((gov.Gate(), False), (gov.Gate(live=True), False), (gov.Gate(live=True, approval_needed=False, max_notional=5), True)):
        if ok:
            gate.authorize(5)
            with pytest.raises(PermissionError):
                gate.authorize(6)
        else:
            with pytest.raises(PermissionError):
                gate.authorize(1)
    with pytest.raises(PermissionError):
        gov.PaperBroker().submit("X", 1, 1)
    b = gov.PaperBroker(enabled=True)
    b.submit("X", 2, 1)
    assert b.positions == {"X": 2.0}
    monkeypatch.setenv("TICKFORGE_KEY", "v")
    assert gov.read_secret("key") == "v"
    h = gov.Health()
    h.beat("a", 0)
    assert h.healthy(30) and not h.healthy(100)
    i = gov.Incidents()
    i.close(i.open("t", "high"))
    assert i.pending() == []
    a, seen = gov.Alerts(), []
    a.add(2, seen.append)
    a.add(1, lambda x: 1 / 0)
    assert a.send(2, "x") == 1 and a.failed == 1 and len(seen) == 1
    r = gov.Readiness({"a": True}, {"p"})
    assert r.ready() and gov.soak([1, 0], lambda x: 1 / x)["errors"] and gov.matches({"a": 1}, {"a": 1, "b": 2}) == ["b"]


def test_shadow_brokers_secrets_approvals(monkeypatch):
    shadow = gov.Shadow(most=3)
    for k in range(5):
        shadow.record(float(k), {"close": k})
    assert [d["signal"] for d in shadow.decisions] == [2.0, 3.0, 4.0]
    sent = []
    broker = gov.HttpBroker(gov.BrokerConfig("b", "http://x/", "acc", key_name="api"), transport=lambda *a: sent.append(a) or '{"status": "filled"}')
    monkeypatch.setenv("TICKFORGE_API", "k")
    assert broker.submit("X", 1, 2)["status"] == "filled" and sent[0][0] == "http://x/orders" and sent[0][2] == {"Authorization": "Bearer k"}
    with pytest.raises(PermissionError):
        gov.HttpBroker(gov.BrokerConfig("b", "http://x", "acc", "live")).submit("X", 1, 2)
    with pytest.raises(RuntimeError):
        gov.HttpBroker(gov.BrokerConfig("b", "http://x", "acc"), transport=lambda *a: "no json").submit("X", 1, 2)
    assert gov.reconciled({"a": 1.0, "b": 2.0}, {"b": 2.0, "c": 1.0}) == {"a": (1.0, 0.0), "c": (0.0, 1.0)}
    with pytest.raises(KeyError, match="nope"):
        gov.Secrets().require("api", "nope")
    r = gov.Readiness({"a": True}, needed=2)
    r.approve("p", "fine", 1.0), r.approve("p")
    assert not r.ready() and len(r.records) == 2
    r.approve("q")
    assert r.ready() and gov.within_budget({"a": 1.0}, {"a": 2.0, "b": 1.0}) == ["b"]


def test_studio(tmp_path):
    import threading
    import urllib.request

    from tickforge import studio

    for k, (sharpe, drawdown) in enumerate([(2.0, 0.2), (1.0, 0.1), (1.0, 0.3)]):
        store.save_candidate(tmp_path / "run", {"strategy_id": f"s{k}", "generation": 0, "index": k, "expression": "x", "complexity": 1, "test_metrics": {"sharpe": sharpe, "max_drawdown": drawdown}})
    store.write(tmp_path / "run" / "summary.json", {"best": {"strategy_id": "s0", "train_metrics": {"sharpe": 2.0}}, "candidates": 3, "front_sizes": [2]})
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "summary.json").write_text("{")
    ask = lambda path: studio.answer(str(tmp_path), path)
    assert ask("/health") == (200, {"status": "ok"}) and [r["run"] for r in ask("/api/runs")[1]] == ["run"] and ask("/api/runs/run")[1]["candidates"] == 3
    assert [r["strategy_id"] for r in ask("/api/runs/run/pareto")[1]] == ["s0", "s1"] and "run" in ask("/")[1]
    assert ask("/api/runs/%2e%2e%2fetc")[0] == 400 and ask("/api/runs/bad")[0] == 404 and ask("/api/runs/none")[0] == 404 and ask("/x")[0] == 404
    server = studio.serve(str(tmp_path), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/runs", timeout=5) as reply:
            assert json.loads(reply.read())[0]["run"] == "run"
    finally:
        server.shutdown()
    studio.plot({"a": [1.0, 2.0, 1.5], "b": [1.0, float("nan"), 3.0]}, str(tmp_path / "p.svg"))
    assert (tmp_path / "p.svg").read_text().count("polyline") == 4


def test_connector_objects(spark):
    class Mine:
        name = "mine"

        def load(self, s, options):
            return s.range(options["n"])

    c = Connectors()
    c.add(Mine())
    assert c.get("mine")(spark, {"n": 2}).count() == 2
