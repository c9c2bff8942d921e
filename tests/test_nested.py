import json

import random

from tickforge.operators.nested import flatten_records, is_json, rows_of, table


def deep(n):
    node = {"type": "constant", "value": 1.0}
    for _ in range(n):
        node = {"type": "binary", "op": "+", "left": node, "right": None}
    return node


def text_of(n):
    """The JSON of deep(n), without recursion."""
    return '{"genome":' + '{"type":"binary","op":"+","left":' * n + '{"type":"constant"}' + ',"right":null}' * n + "}"


def paths(text):
    return {(k, p, u) for k, p, u, _, _ in rows_of(text)}


def test_kinds():
    record = {
        "genome": json.dumps({"type": "binary", "left": {"type": "series", "name": "close"}, "right": {"type": "x", "meta": {"left": {"a": 1}}}}),
        "execution": {"delay_bars": 1},
        "validation": {"walk_forward": {"fold_details": [None, {"fold": 1, "metrics": {"sharpe": float("nan")}}, 3]}, "other": {"fold_details": {"fold": 0}}, "none": None},
        "robustness": {
            "cost_sensitivity": {"scenarios": [{"cost_multiplier": 0.5, "execution": {"delay_bars": 2}}]}, "parameter_sensitivity": {"scenarios": {"delta": -3}},
            "monte_carlo": {"quantiles": {"sharpe": {"p05": float("-inf")}, "bad": None}},
        },
    }
    got = paths(json.dumps(record))
    assert got == {
        ("node", "/genome", ""), ("node", "/genome/left", "/genome"), ("node", "/genome/right", "/genome"), ("execution", "/execution", ""),
        ("fold", "/validation/walk_forward/fold_details/1", "/validation/walk_forward"), ("fold", "/validation/other/fold_details/0", "/validation/other"),
        ("cost_scenario", "/robustness/cost_sensitivity/scenarios/0", "/robustness/cost_sensitivity"), ("execution", "/robustness/cost_sensitivity/scenarios/0/execution", "/robustness/cost_sensitivity/scenarios/0"),
        ("parameter_scenario", "/robustness/parameter_sensitivity/scenarios/0", "/robustness/parameter_sensitivity"), ("quantile", "/robustness/monte_carlo/quantiles/sharpe", "/robustness/monte_carlo"),
    }


def test_damaged_and_odd_texts():
    good = '{"genome": {"type": "x"}}'
    assert len(rows_of(good)) == 1 and len(rows_of(json.dumps(good))) == 1
    for bad in (None, "", " ", "null", "[]", "3", good[:-1], good + "}", good + " x", "{'a': 1}", '{"a": 1,}', '{"a": [1,]}', '{"a" 1}', '{"a": 01}', '{"a": +1}', "{,}", '{"genome": {"type": "x"}} {}'):
        assert rows_of(bad) == []
    assert rows_of('{"genome": {"type": "a"}, "genome": null}') == []
    assert [r[4] for r in rows_of('{"genome": {"type": "a"}, "genome": {"type": "b"}}')] == [{"type": "b"}]
    assert rows_of('{"genome": "{broken"}') == []


def test_depth_is_no_limit():
    got = rows_of(text_of(3000))
    assert len(got) == 3001 and got[-1][1] == "/genome" + "/left" * 3000


def test_is_json_agrees_with_a_recursive_parser():
    def parses(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    rng, base = random.Random(1), ' {"a": [1, {"b": [true, null, "x\\u00e9\\n\\"", -0.5e+3]}, []], "c": {}, "d": "", "e": NaN, "f": -Infinity} '
    assert is_json(base)
    for _ in range(4000):
        text = list(base)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(text))
            text[i : i + rng.randrange(2)] = rng.choice(['"', ",", "{", "}", "[", "]", ":", "0", "-", "\\", " ", "\t", "x", "1.5", "null", ""])
        text = "".join(text)
        assert is_json(text) == parses(text), text


def brute(value, path="", up="", place="", out=None):
    """(path, parent) of the rows of a parsed record, by recursion over the statement of the problem."""
    out = [] if out is None else out
    opened = lambda x: opened(json.loads(x)) if isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"') and is_json(x) else x
    value = opened(value)
    get = lambda d, k: opened(d.get(k)) if isinstance(d, dict) else None
    listed = lambda x: list(enumerate(x)) if isinstance(x, list) else [(0, x)]

    def node(x, path, up):
        x = opened(x)
        if isinstance(x, dict):
            out.append((path, up))
            node(x.get("left"), path + "/left", path)
            node(x.get("right"), path + "/right", path)

    node(get(value, "genome"), "/genome", "")
    if isinstance(get(value, "execution"), dict):
        out.append(("/execution", ""))
    kinds = get(value, "validation")
    for kind, x in kinds.items() if isinstance(kinds, dict) else ():
        out += [(f"/validation/{kind}/fold_details/{i}", f"/validation/{kind}") for i, e in listed(get(opened(x), "fold_details")) if isinstance(opened(e), dict)]
    tests = get(value, "robustness")
    for kind in ("cost_sensitivity", "parameter_sensitivity"):
        for i, e in listed(get(get(tests, kind), "scenarios")):
            e = opened(e)
            if isinstance(e, dict):
                out.append((at := f"/robustness/{kind}/scenarios/{i}", f"/robustness/{kind}"))
                if isinstance(get(e, "execution"), dict):
                    out.append((at + "/execution", at))
    sizes = get(get(tests, "monte_carlo"), "quantiles")
    out += [(f"/robustness/monte_carlo/quantiles/{k}", "/robustness/monte_carlo") for k, e in (sizes.items() if isinstance(sizes, dict) else ()) if isinstance(opened(e), dict)]
    return out


def test_test_records_agree_with_recursion():
    import pandas as pd

    texts = pd.read_parquet("/root/testdata/sf0.01/strategy_records.parquet")["payload"]
    rows = 0
    for text in texts:
        try:
            want = brute(json.loads(text)) if text is not None else []
        except ValueError:
            want = []
        got = [(p, u) for _, p, u, _, _ in rows_of(text)]
        assert sorted(got) == sorted(want)
        rows += len(got)
    assert rows > 1000


def test_repeated_keys_and_encoded_texts():
    got = rows_of('{"robustness": {"cost_sensitivity": {"scenarios": [{"a": 1}, {"a": 2}]}}, "robustness": {"cost_sensitivity": {"scenarios": [{"a": 3}]}}}')
    assert [(r[1], r[4]) for r in got] == [("/robustness/cost_sensitivity/scenarios/0", {"a": "3"})]
    assert [r[4] for r in rows_of('{"execution": {"x": {"y": 1, "z": [1, {"u": 2}]}, "v": 5, "x": 7, "v": {"w": null}}}')] == [{"x": "7", "v/w": None}]
    text, node = '{"type": "constant"}', '{"genome": %s}'
    for _ in range(12):
        text = json.dumps(text)
    assert [r[4] for r in rows_of(node % text)] == [{"type": "constant"}] and rows_of(json.dumps(node % text)) == rows_of(node % text)
    assert [r[4] for r in rows_of('{"execution": {"a": "\\ud83d", "b": "\\ud83d\\ude00"}}')] == [{"a": "\ufffd", "b": "\U0001f600"}]
    assert [r[4] for r in rows_of('{"execution": {"a": [[[4]]], "b": "[1, {}, \\"x\\"]"}}')] == [{"a/0/0/0": "4", "b/0": "1", "b/2": "x"}]


def test_length_and_depth_are_linear():
    import time

    def took(n):
        t = time.process_time()
        assert len(rows_of('{"execution": {"a": ' + '[{"b": ' * n + "1" + "}]" * n + "}}")) == 1
        return time.process_time() - t

    took(1000)
    assert took(100_000) < 40 * max(took(10_000), 0.02)


def test_frames(spark):
    rows = [(1, json.dumps({"genome": {"type": "primitive", "name": "SMA", "period": 5}, "x": "y" * 200_000})), (2, None), (3, "{"), (1, '{"execution": {"delay_bars": "2", "commission_bps": "n/a"}}')]
    df = spark.createDataFrame(rows, "record_id long, payload string").selectExpr("*", "1 as kind", "2 as fields")
    flat = flatten_records(df)
    assert sorted((r["record_id"], r["node_path"]) for r in flat.collect()) == [(1, "/execution"), (1, "/genome")]
    assert table(flat, "node", name="string", period="int").first()[4:] == ("SMA", 5)
    assert table(flat, "execution", delay_bars="int", commission_bps="double").first()[4:] == (2, None)
    assert flatten_records(df.limit(0)).count() == 0
