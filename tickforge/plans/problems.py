"""The pN_ queries of the general data problems and, where SQL can state them, the same in SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators.asof import as_of, ending, versions
from tickforge.operators.backtest import METRICS
from tickforge.operators.grid import regular_grid
from tickforge.operators.intervals import interval_gaps, merge_intervals
from tickforge.operators.nested import flatten_records, table
from tickforge.operators.spikes import flag_implausible
from tickforge.operators.timestamps import normalise
from tickforge.session import broadcast_if_small, micros, read


#: The fields of each table of a strategy record, by path, with their types.
_METRICS = {f"metrics__{m}": "int" if m == "trades" else "double" for m in METRICS}
_NODE = {"type": "string", "op": "string", "name": "string", "period": "int", "value": "double", "meta__origin__type": "string", "meta__origin__round": "int"}
_FOLD = {**dict.fromkeys(("fold", "train_start", "train_end", "test_start", "test_end"), "int"), **_METRICS}
_SCENARIO = {"cost_multiplier": "double", "delta": "double", **_METRICS}
_QUANTILE = dict.fromkeys(("p05", "p50", "p95"), "double")
_EXECUTION = {k: "int" if k == "delay_bars" else "double" for k in ("commission_bps", "spread_bps", "slippage_bps", "impact_bps_per_turnover", "delay_bars", "funding_bps_per_bar", "borrow_bps_per_bar")}


def _vendor_texts(spark: SparkSession, d: str) -> DataFrame:
    feed = read(spark, d, "feed_raw").select("raw_id", "source", F.explode(F.create_map(F.lit("ts"), "ts", F.lit("available_at"), "available_at")).alias("field_name", "text"))
    acts = read(spark, d, "actions_raw").select("raw_id", "source", F.lit("effective_at").alias("field_name"), F.col("effective_at").alias("text"))
    return feed.unionByName(acts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = normalise(_vendor_texts(spark, d), read(spark, d, "vendors"), "text", "utc_us")
    return found.filter("utc_us is not null").select("raw_id", "field_name", "utc_us")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read(spark, d, "feed"), read(spark, d, "instruments")).withColumn("value", F.round("value", 6) + F.lit(0.0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(read(spark, d, "feed"), read(spark, d, "instruments")).filter(F.col("status").isin("filled", "marked")).select("symbol", "slot_s")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_implausible(read(spark, d, "feed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).filter("reason <> 'fence'").select("row_id", "field_name").distinct()


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(read(spark, d, "memberships"), "symbol", "included_at", "excluded_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = interval_gaps(read(spark, d, "memberships"), "symbol", "included_at", "excluded_at")
    return gaps.select("symbol", *[F.expr(f"(gap_{x}_us - pmod(gap_{x}_us, 1000000)) div 1000000").alias(f"gap_{x}_s") for x in ("start", "end")])


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(read(spark, d, "strategy_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_records(spark, d).select("record_id", "node_path", "parent_path")


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every row as text, also those that no table names or whose text is not of the table's type."""
    return p6_records(spark, d).select("record_id", "kind", "node_path", F.explode("fields").alias("field", "value"))


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(p6_records(spark, d), "node", **_NODE)


def p6_folds(spark: SparkSession, d: str) -> DataFrame:
    return table(p6_records(spark, d), "fold", **_FOLD)


def p6_scenarios(spark: SparkSession, d: str) -> DataFrame:
    flat = p6_records(spark, d).filter(F.col("kind").endswith("_scenario"))
    return flat.select("record_id", "node_path", "parent_path", "ordinal", *[F.try_element_at("fields", F.lit(k.replace("__", "/"))).try_cast(to).alias(k) for k, to in _SCENARIO.items()])


def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return table(p6_records(spark, d), "quantile", **_QUANTILE)


def p6_execution(spark: SparkSession, d: str) -> DataFrame:
    return table(p6_records(spark, d), "execution", **_EXECUTION)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    fills, instruments = read(spark, d, "fills"), read(spark, d, "instruments")
    actions = read(spark, d, "corporate_actions").filter("split_factor is not null and not isnan(split_factor)")
    by_symbol = as_of(fills, "fill_id", F.col("symbol"), "ts", {
        "action": versions(actions, "symbol", "action_id", "effective_at", "available_at"),
        "member": ending(versions(read(spark, d, "memberships"), "symbol", "membership_id", "included_at", "available_at", "excluded_at")),
        "bar": versions(read(spark, d, "feed"), "symbol", "row_id", "ts", "available_at"),
    })
    roots = instruments.filter("symbol is not null and root_code is not null").groupBy("symbol").agg(F.min("root_code").alias("root_code"))
    rooted = fills.select("fill_id", "symbol", "ts").join(broadcast_if_small(roots), "symbol")
    by_root = as_of(rooted, "fill_id", F.col("root_code"), "ts", {"roll": versions(read(spark, d, "futures_rolls"), "root_code", "roll_id", "effective_at", "available_at")})
    return by_symbol.unionByName(by_root)


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_grid": p3_grid, "p4_found": p4_found, "p4_flags": p4_flags, "p5_found": p5_found, "p5_periods": p5_periods,
    "p6_found": p6_found, "p6_fields": p6_fields, "p6_nodes": p6_nodes, "p6_folds": p6_folds, "p6_scenarios": p6_scenarios, "p6_quantiles": p6_quantiles, "p6_execution": p6_execution, "p7_found": p7_found,
}

_ISLANDS = """
w AS (SELECT symbol, epoch_us(included_at) AS s, coalesce(epoch_us(excluded_at), 9000000000000000000) AS e FROM memberships
      WHERE symbol IS NOT NULL AND included_at IS NOT NULL AND (excluded_at IS NULL OR excluded_at > included_at)),
m AS (SELECT *, max(e) OVER (PARTITION BY symbol ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM w)"""
_KNOWN = """
k AS (SELECT f.fill_id, '{kind}' AS attr_kind, v.{id} AS ref_id,
        row_number() OVER (PARTITION BY f.fill_id ORDER BY v.{t} DESC, coalesce(v.available_at, v.{t}) DESC, v.{id} DESC) AS r
      FROM {fills} f JOIN {table} v ON v.{key} = f.{key} AND v.{t} <= f.ts AND coalesce(v.available_at, v.{t}) <= f.ts {extra})
SELECT fill_id, attr_kind, ref_id FROM k WHERE r = 1"""


def _known(kind: str, ident: str, t: str, source: str, key: str = "symbol", fills: str = "fills", extra: str = "") -> str:
    return "(WITH " + _KNOWN.format(kind=kind, id=ident, t=t, table=source, key=key, fills=fills, extra=extra).strip() + ")"


_PRICES = ("open_px", "high_px", "low_px")


def _jump_sql(f: str) -> str:
    """CTEs that end in j_<f>: (symbol, ts) of the bars in a run of one to three that is off both the bar before and the bar behind it."""
    at = lambda k: f"v{k}" if k >= 0 else "vb"
    runs = []
    for n in (1, 2, 3):
        up = " AND ".join(f"{at(k)} / vb - 1 > 40 * m AND {at(k)} / {at(n)} - 1 > 40 * m" for k in range(n))
        down = " AND ".join(f"{at(k)} / vb - 1 < -40 * m AND {at(k)} / {at(n)} - 1 < -40 * m" for k in range(n))
        runs.append(f"(({up}) OR ({down})) AND abs(vb / {at(n)} - 1) <= 40 * m AS r{n}")
    hit = " OR ".join(f"coalesce(lag(r{n}, {k}) OVER w, false)" if k else f"coalesce(r{n}, false)" for n in (1, 2, 3) for k in range(n))
    return f"""v_{f} AS (SELECT symbol, ts, {f} AS v FROM bars WHERE {f} IS NOT NULL AND isfinite({f}) AND {f} > 0),
c_{f} AS (SELECT *, lag(v) OVER w AS vb, v AS v0, lead(v, 1) OVER w AS v1, lead(v, 2) OVER w AS v2, lead(v, 3) OVER w AS v3 FROM v_{f} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
m_{f} AS (SELECT symbol, median(abs(v / vb - 1)) AS m FROM c_{f} GROUP BY 1), r_{f} AS (SELECT symbol, ts, {", ".join(runs)} FROM c_{f} JOIN m_{f} USING (symbol)),
j_{f} AS (SELECT symbol, ts FROM (SELECT symbol, ts, {hit} AS hit FROM r_{f} WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE hit)"""


def _stuck_sql(f: str) -> str:
    return f"""s1_{f} AS (SELECT symbol, ts, {f} AS v, CASE WHEN {f} = lag({f}) OVER w THEN 0 ELSE 1 END AS new FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s2_{f} AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM s1_{f}),
s_{f} AS (SELECT symbol, ts FROM (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS n FROM s2_{f}) WHERE n >= 8 AND v IS NOT NULL AND NOT isnan(v))"""


_FIELDS = (*_PRICES, "volume")
_SPIKES = f"""
WITH f AS (SELECT row_id, symbol, ts, {", ".join(_FIELDS)} FROM feed WHERE symbol IS NOT NULL AND ts IS NOT NULL),
bars AS (SELECT symbol, ts, {", ".join(f"arg_min({c}, row_id) AS {c}" for c in _FIELDS)} FROM f GROUP BY symbol, ts),
{", ".join(_jump_sql(c) for c in _PRICES)}, {", ".join(_stuck_sql(c) for c in _FIELDS)},
mv AS (SELECT symbol, median(volume) AS m FROM bars WHERE isfinite(volume) AND volume >= 0 GROUP BY 1)
""" + " UNION ".join([
    *[f"SELECT row_id, '{c}' AS field_name FROM f WHERE {c} IS NOT NULL AND (NOT isfinite({c}) OR {c} <= 0)" for c in _PRICES],
    "SELECT row_id, 'volume' FROM f WHERE volume IS NOT NULL AND (NOT isfinite(volume) OR volume < 0)",
    *[f"SELECT row_id, '{c}' FROM f WHERE high_px < low_px AND NOT isnan(high_px) AND NOT isnan(low_px)" for c in ("high_px", "low_px")],
    *[f"SELECT row_id, '{c}' FROM f JOIN s_{c} USING (symbol, ts) WHERE {c} IS NOT NULL" for c in _FIELDS],
    *[f"SELECT row_id, '{c}' FROM f JOIN j_{c} USING (symbol, ts) WHERE {c} IS NOT NULL AND isfinite({c}) AND {c} > 0" for c in _PRICES],
    "SELECT row_id, 'volume' FROM f JOIN mv USING (symbol) WHERE isfinite(volume) AND volume > 40 * m",
])



_NAMES = itertools.count()


def _un(x: str) -> str:
    """A JSON value, or what it encodes if it is a text that encodes an object, array or text (up to three times)."""
    for _ in range(3):
        v = f"u{next(_NAMES)}"
        x = f"(SELECT CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v}->>'$', '^\\s*[\\[{{\"]') AND json_valid({v}->>'$') THEN CAST({v}->>'$' AS JSON) ELSE {v} END FROM (SELECT {x} AS {v}))"
    return x


def _elements(name: str, source: str) -> str:
    """CTE name (record_id, node_path, parent_path, ordinal, j): the objects in the arrays (record_id, base, parent, a) of source; a lone object is element 0."""
    return f"""{name} AS (SELECT * FROM (SELECT record_id, base || '/' || i AS node_path, parent AS parent_path, CAST(i AS INTEGER) AS ordinal, {_un("json_extract(a, '$[' || i || ']')")} AS j
 FROM (SELECT *, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM {source} WHERE json_type(a) = 'ARRAY') UNION ALL SELECT record_id, base || '/0', parent, 0, a FROM {source} WHERE json_type(a) = 'OBJECT') WHERE json_type(j) = 'OBJECT')"""


def _at(x: str, *keys: str) -> str:
    for k in keys:
        x = _un(f"json_extract({x}, '$.\"{k}\"')")
    return x


#: CTEs with the rows of the records: node, fold, scenario, quantile and execution (record_id, node_path, parent_path, ordinal, j).
RECORDS = f"""rec AS (SELECT record_id, {_un("CAST(payload AS JSON)")} AS j FROM strategy_records WHERE json_valid(payload)),
node AS (SELECT record_id, '/genome' AS node_path, '' AS parent_path, CAST(NULL AS INTEGER) AS ordinal, {_at("j", "genome")} AS j FROM rec WHERE json_type({_at("j", "genome")}) = 'OBJECT'
 UNION ALL SELECT * FROM (SELECT record_id, node_path || '/' || k AS node_path, node_path AS parent_path, CAST(NULL AS INTEGER) AS ordinal, {_un("json_extract(j, '$.' || k)")} AS j FROM node, (VALUES ('left'), ('right')) s(k)) WHERE json_type(j) = 'OBJECT'),
val AS (SELECT record_id, v, unnest(json_keys(v)) AS k FROM (SELECT record_id, {_at("j", "validation")} AS v FROM rec) WHERE json_type(v) = 'OBJECT'),
fd AS (SELECT record_id, '/validation/' || k || '/fold_details' AS base, '/validation/' || k AS parent, {_at(_un("json_extract(v, '$.' || chr(34) || k || chr(34))"), "fold_details")} AS a FROM val),
{_elements("fold", "fd")},
sc AS (SELECT record_id, '/robustness/' || k || '/scenarios' AS base, '/robustness/' || k AS parent, {_at(_un("json_extract(v, '$.' || k)"), "scenarios")} AS a FROM (SELECT record_id, {_at("j", "robustness")} AS v FROM rec), (VALUES ('cost_sensitivity'), ('parameter_sensitivity')) s(k)),
{_elements("scenario", "sc")},
qs AS (SELECT record_id, q, unnest(json_keys(q)) AS k FROM (SELECT record_id, {_at("j", "robustness", "monte_carlo", "quantiles")} AS q FROM rec) WHERE json_type(q) = 'OBJECT'),
quantile AS (SELECT * FROM (SELECT record_id, '/robustness/monte_carlo/quantiles/' || k AS node_path, '/robustness/monte_carlo' AS parent_path, CAST(NULL AS INTEGER) AS ordinal, {_un("json_extract(q, '$.' || chr(34) || k || chr(34))")} AS j FROM qs) WHERE json_type(j) = 'OBJECT'),
execution AS (SELECT * FROM (SELECT record_id, '/execution' AS node_path, '' AS parent_path, CAST(NULL AS INTEGER) AS ordinal, {_at("j", "execution")} AS j FROM rec UNION ALL SELECT record_id, node_path || '/execution', node_path, NULL, {_at("j", "execution")} FROM scenario) WHERE json_type(j) = 'OBJECT')"""


def _table_sql(source: str, **fields: str) -> str:
    sql = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}

    def field(path: str, to: str) -> str:
        at = _at("j", *path.split("__"))
        return f"TRY_CAST(CASE WHEN json_type({at}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {at}->>'$' END AS {sql[to]}) AS {path}"

    return f"WITH RECURSIVE {RECORDS} SELECT record_id, node_path, parent_path, ordinal, " + ", ".join(field(k, t) for k, t in fields.items()) + f" FROM {source}"


_TABLES = {"p6_nodes": ("node", _NODE), "p6_folds": ("fold", _FOLD), "p6_scenarios": ("scenario", _SCENARIO), "p6_quantiles": ("quantile", _QUANTILE), "p6_execution": ("execution", _EXECUTION)}

_GRID = """
WITH x AS (SELECT f.symbol, i.bar_seconds AS b, i.session_kind AS sk, epoch_us(f.ts) AS us, f.row_id, f.close_px AS y FROM feed f JOIN instruments i ON i.symbol = f.symbol WHERE f.ts IS NOT NULL AND isfinite(f.close_px) AND i.bar_seconds > 0),
o AS (SELECT symbol, b, sk, us // (CAST(b AS BIGINT) * 1000000) AS p, min(us) AS f, max(us) AS l, arg_max(y, (us, row_id)) AS y FROM x GROUP BY ALL),
n AS (SELECT *, lag(p) OVER w AS p0, lag(y) OVER w AS y0, lag(l) OVER w AS l0, lead(p) OVER w AS p2, lead(y) OVER w AS y2, lead(f) OVER w AS f2, lead(l) OVER w AS l2, lead(p, 2) OVER w AS p3, lead(y, 2) OVER w AS y3, lead(f, 2) OVER w AS f3 FROM o WINDOW w AS (PARTITION BY symbol ORDER BY p)),
d AS (SELECT *, CAST(p - p0 AS DOUBLE) AS h0, CAST(p2 - p AS DOUBLE) AS h1, CAST(p3 - p2 AS DOUBLE) AS h2, (y - y0) / (p - p0) AS d0, (y2 - y) / (p2 - p) AS d1, (y3 - y2) / (p3 - p2) AS d2,
 coalesce(f - l0 <= 2592000000000, false) AS left_, coalesce(f3 - l2 <= 2592000000000, false) AS right_, coalesce(f2 - l > 2592000000000, false) AS far, coalesce(p2 - p - 1, 0) AS gap FROM n),
e AS (SELECT *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) AS e1, ((2 * h1 + h0) * d1 - h1 * d0) / (h1 + h0) AS e2 FROM d),
s AS (SELECT *, CASE WHEN left_ THEN CASE WHEN d0 * d1 <= 0 THEN 0 ELSE (3 * h1 + 3 * h0) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) END
  WHEN right_ THEN CASE WHEN sign(e1) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(d2) AND abs(e1) > 3 * abs(d1) THEN 3 * d1 ELSE e1 END ELSE d1 END AS s1,
 CASE WHEN right_ THEN CASE WHEN d1 * d2 <= 0 THEN 0 ELSE (3 * h2 + 3 * h1) / ((2 * h2 + h1) / d1 + (h2 + 2 * h1) / d2) END
  WHEN left_ THEN CASE WHEN sign(e2) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(d0) AND abs(e2) > 3 * abs(d1) THEN 3 * d1 ELSE e2 END ELSE d1 END AS s2 FROM e),
g AS (SELECT *, unnest(CASE WHEN far THEN CASE WHEN gap > 0 THEN [0, 1] ELSE [0] END ELSE range(0, CAST(gap + 1 AS BIGINT)) END) AS k FROM s),
v AS (SELECT *, (p + k) * CAST(b AS BIGINT) AS slot_s, CAST(k AS DOUBLE) / h1 AS t FROM g),
z AS (SELECT *, CASE WHEN k = 0 THEN 'observed' WHEN far THEN 'long_gap' WHEN sk = 'weekday' AND (slot_s // 86400 + 4) % 7 IN (0, 6) THEN 'closed' WHEN gap <= 1440 THEN 'filled' ELSE 'marked' END AS status FROM v)
SELECT symbol, slot_s, status, round(CASE WHEN status = 'observed' THEN y WHEN status = 'filled' THEN y * (1 + 2 * t) * (1 - t) * (1 - t) + h1 * s1 * t * (1 - t) * (1 - t) + y2 * t * t * (3 - 2 * t) + h1 * s2 * t * t * (t - 1) END, 6) + 0e0 AS value,
 CASE WHEN status = 'long_gap' THEN gap ELSE 1 END AS run_periods FROM z"""

ORACLE = {
    "p4_found": _SPIKES,
    "p3_grid": _GRID,
    "p6_found": f"WITH RECURSIVE {RECORDS} " + " UNION ALL ".join(f"SELECT record_id, node_path, parent_path FROM {t}" for t in ("node", "fold", "scenario", "quantile", "execution")),
    **{k: _table_sql(source, **fields) for k, (source, fields) in _TABLES.items()},
    "p3_found": """
WITH r AS (SELECT f.symbol, i.bar_seconds AS b, i.session_kind AS sk, epoch_us(f.ts) AS us, epoch_us(f.ts) // (CAST(i.bar_seconds AS BIGINT) * 1000000) AS k
           FROM feed f JOIN instruments i ON i.symbol = f.symbol WHERE f.ts IS NOT NULL AND isfinite(f.close_px)),
o AS (SELECT symbol, b, sk, k, min(us) AS a, max(us) AS z FROM r GROUP BY ALL),
g AS (SELECT *, lead(k) OVER w AS nk, lead(a) OVER w AS na FROM o WINDOW w AS (PARTITION BY symbol ORDER BY k)),
s AS (SELECT symbol, sk, unnest(range(k + 1, nk)) * CAST(b AS BIGINT) AS slot_s FROM g WHERE nk > k + 1 AND na - z <= 2592000000000)
SELECT symbol, CAST(slot_s AS BIGINT) AS slot_s FROM s WHERE NOT (sk = 'weekday' AND (slot_s // 86400 + 4) % 7 IN (0, 6))""",
    "p5_found": f"WITH {_ISLANDS} SELECT symbol, prev // 1000000 AS gap_start_s, s // 1000000 AS gap_end_s FROM m WHERE s > prev",
    "p5_periods": f"""WITH {_ISLANDS}, l AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT symbol, min(s) AS period_start_us, nullif(max(e), 9000000000000000000) AS period_end_us FROM l GROUP BY symbol, island""",
    "p7_found": " UNION ALL ".join([
        _known("action", "action_id", "effective_at", "(SELECT * FROM corporate_actions WHERE split_factor IS NOT NULL)"),
        _known("member", "membership_id", "included_at", "memberships", extra="AND (v.excluded_at IS NULL OR v.excluded_at > f.ts)"),
        _known("roll", "roll_id", "effective_at", "futures_rolls", "root_code", "(SELECT x.fill_id, x.ts, i.root_code FROM fills x JOIN instruments i ON i.symbol = x.symbol)"),
        _known("bar", "row_id", "ts", "feed"),
    ]),
}
