"""The engine's queries in DuckDB's SQL, written from the definitions, apart from the Spark plans."""

from __future__ import annotations

BARS = """
ev AS (SELECT event_type AS symbol, epoch_us(ts) AS us, 100e0 + 2e-2 * value AS px FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
hb AS (SELECT symbol, us // 3600000000 AS bucket, arg_min(px, us) AS open, max(px) AS high, min(px) AS low, arg_max(px, us) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ev GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS i FROM hb)"""
ROOT = "sqrt(252e0)"
FIXED = "4.5e-4"


def w(p: int) -> str:
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


L = "(PARTITION BY symbol ORDER BY i)"


def full(x: str, p: int) -> str:
    return f"CASE WHEN i >= {p - 1} THEN {x} END"


def mean(x: str, p: int) -> str:
    return full(f"avg({x}) OVER {w(p)}", p)


def std(x: str, p: int) -> str:
    return full(f"stddev_pop({x}) OVER {w(p)}", p)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {L}"


def wma(x: str, p: int) -> str:
    return "(" + " + ".join(f"{lag(x, k)} * {p - k}" for k in range(p)) + f") / {p * (p + 1) / 2:e}"


def ema(x: str, p: int) -> str:
    a = 2 / (p + 1)
    return f"list_reduce(list(CAST({x} AS DOUBLE)) OVER {L}, lambda a, b: {a:.17e} * b + {1 - a:.17e} * a)"


def select(ctes: str, columns: dict[str, str], table: str, digits: int = 6, keys: str = "symbol, i AS bar_idx") -> str:
    return f"WITH RECURSIVE {ctes}\nSELECT {keys}, " + ", ".join(f"round({x}, {digits}) + 0e0 AS {n}" for n, x in columns.items()) + f" FROM {table}"


_TYP = "((high + low + close) / 3)"
_RET = f"ret AS (SELECT *, coalesce(close / {lag('close')} - 1, 0e0) AS r FROM b)"
_TR = f"tr AS (SELECT *, CASE WHEN i = 0 THEN 0e0 ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr FROM b)"
_STEP = f"st AS (SELECT *, close - {lag('close')} AS d FROM b)"
_MFV = "CASE WHEN high > low THEN ((close - low) - (high - close)) / greatest(1e-12, high - low) * volume ELSE 0e0 END"
_LIST = "lst AS (SELECT *, list(close) OVER {w} AS l, avg(close) OVER {w} AS m, stddev_pop(close) OVER {w} AS s FROM b)".format(w=w(12))
_N2 = "2e0"


def _sums(n: int) -> tuple[str, str]:
    return f"sum(greatest(d, 0)) OVER {w(n)}", f"sum(greatest(-d, 0)) OVER {w(n)}"


_up17, _dn17 = _sums(17)
_up14, _dn14 = _sums(14)
_HL = "pow(ln(greatest(1e-12, high) / greatest(1e-12, low)), 2)"
_CO = "pow(ln(greatest(1e-12, close) / greatest(1e-12, open)), 2)"
_m20, _s20 = mean("close", 20), std("close", 20)
_hi14, _lo14 = full(f"max(high) OVER {w(14)}", 14), full(f"min(low) OVER {w(14)}", 14)

PRIMITIVES = {
    "averages": select(
        BARS + f", h1 AS (SELECT *, CASE WHEN i >= 15 THEN 2 * ({wma('close', 8)}) - ({wma('close', 16)}) END AS raw, coalesce({mean('close', 5)}, 0e0) AS half FROM b)",
        {"sma": mean("close", 20), "rolling_mean": mean("close", 7), "wma": wma("close", 10), "hma": wma("raw", 4), "trima": mean("half", 5),
         "vwap": full(f"sum({_TYP} * volume) OVER {w(14)} / greatest(1e0, sum(volume) OVER {w(14)})", 14)}, "h1", 9),
    "extremes": select(BARS, {
        "high": full(f"max(high) OVER {w(9)}", 9), "highest_high": _hi14, "low": full(f"min(low) OVER {w(9)}", 9), "lowest_low": _lo14,
        "rolling_min": full(f"min(close) OVER {w(5)}", 5), "rolling_max": full(f"max(close) OVER {w(5)}", 5), "donchian_upper": full(f"max(high) OVER {w(20)}", 20),
        "donchian_lower": full(f"min(low) OVER {w(20)}", 20), "donchian_middle": full(f"(max(high) OVER {w(20)} + min(low) OVER {w(20)}) / 2", 20),
        "rolling_median": full(f"list_sort(list(close) OVER {w(8)})[5]", 8)}, "b"),
    "moments": select(BARS + ", " + _LIST + f", ret AS (SELECT *, coalesce(close / {lag('close')} - 1, 0e0) AS r FROM lst)", {
        "rolling_std": full("s", 12), "rolling_skew": full("CASE WHEN s = 0 THEN 0e0 ELSE list_sum(list_transform(l, lambda x: pow((x - m) / s, 3))) / 12 END", 12),
        "rolling_kurtosis": full("CASE WHEN s = 0 THEN 0e0 ELSE list_sum(list_transform(l, lambda x: pow((x - m) / s, 4))) / 12 - 3 END", 12),
        "volatility": f"{std('r', 10)} * {ROOT}", "realized_vol": f"{std('r', 21)} * {ROOT}",
        "parkinson_vol": full(f"sqrt(greatest(0e0, avg({_HL} / (4 * ln(2e0))) OVER {w(14)})) * {ROOT}", 14),
        "gk_vol": full(f"sqrt(greatest(0e0, avg(5e-1 * {_HL} - (2 * ln(2e0) - 1) * {_CO}) OVER {w(14)})) * {ROOT}", 14)}, "ret"),
    "momentum": select(BARS + ", " + _STEP, {
        "momentum": f"close - {lag('close', 10)}", "roc": f"close / {lag('close', 12)} - 1", "lag_1": lag("close", 1), "lag_2": lag("close", 2), "lag_5": lag("close", 5),
        "delta_1": f"close - {lag('close', 1)}", "delta_5": f"close - {lag('close', 5)}",
        "rsi": f"CASE WHEN i >= 17 THEN CASE WHEN {_dn17} = 0 THEN 100e0 ELSE 100 - 100 / (1 + {_up17} / {_dn17}) END END",
        "cmo": f"CASE WHEN i >= 14 THEN CASE WHEN {_up14} + {_dn14} = 0 THEN 0e0 ELSE 100 * ({_up14} - {_dn14}) / ({_up14} + {_dn14}) END END",
        "log_return": f"coalesce(ln(greatest(1e-12, close) / greatest(1e-12, {lag('close')})), 0e0) * CASE WHEN i = 0 THEN 0 ELSE 1 END", "cum_return": f"close / first_value(close) OVER {L} - 1"}, "st"),
    "bands": select(BARS + f", t AS (SELECT *, {_TYP} AS t, list({_TYP}) OVER {w(20)} AS tl, avg({_TYP}) OVER {w(20)} AS tm FROM b)", {
        "bollinger_bandwidth": f"4 * ({_s20}) / nullif({_m20}, 0)", "bb_upper": f"({_m20}) + 2 * ({_s20})", "bb_middle": _m20, "bb_lower": f"({_m20}) - 2 * ({_s20})",
        "bb_percent": f"(close - (({_m20}) - 2 * ({_s20}))) / nullif(4 * ({_s20}), 0)", "bb_width": f"4 * ({_s20}) / greatest(1e-12, {_m20}) * 100",
        "stochastic": f"(close - ({_lo14})) / nullif(({_hi14}) - ({_lo14}), 0) * 100", "williams_r": f"(close - ({_lo14})) / nullif(({_hi14}) - ({_lo14}), 0) * 100 - 100",
        "cci": full("CASE WHEN list_sum(list_transform(tl, lambda x: abs(x - tm))) = 0 THEN 0e0 ELSE (t - tm) / (15e-3 * list_sum(list_transform(tl, lambda x: abs(x - tm))) / 20) END", 20)}, "t"),
    "ranges": select(BARS + ", " + _TR, {"atr": mean("tr", 14), "true_range": mean("tr", 3), "true_range_pct": f"({mean('tr', 2)}) / close * 100", "range_pct": "(high - low) / greatest(1e-12, close) * 100"}, "tr"),
    "volumes": select(BARS + f""", st AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS ov, {_MFV} AS mfv, {_TYP} AS t, coalesce({_TYP} - {lag(_TYP)}, 0e0) AS td,
        coalesce(((high + low) / 2 - {lag('(high + low) / 2')}) / greatest(1e-12, volume / 10000 / greatest(1e-12, high - low)), 0e0) AS eom FROM b)""", {
        "obv": f"sum(ov) OVER {L}", "dollar_volume": "close * volume", "volume_zscore": f"(volume - ({mean('volume', 20)})) / CASE WHEN ({std('volume', 20)}) = 0 THEN 1 ELSE ({std('volume', 20)}) END",
        "volume_ratio": f"volume / ({mean('volume', 10)})", "chaikin_money_flow": full(f"sum(mfv) OVER {w(14)} / greatest(1e-12, sum(volume) OVER {w(14)})", 14),
        "cmf": full(f"sum(mfv) OVER {w(5)} / greatest(1e-12, sum(volume) OVER {w(5)})", 5),
        **{n: full(f"CASE WHEN sum(CASE WHEN td < 0 THEN t * volume ELSE 0 END) OVER {w(k)} = 0 THEN 100e0 ELSE 100 - 100 / (1 + sum(CASE WHEN td > 0 THEN t * volume ELSE 0 END) OVER {w(k)} / sum(CASE WHEN td < 0 THEN t * volume ELSE 0 END) OVER {w(k)}) END", k) for n, k in (("money_flow_index", 14), ("mfi", 6))},
        "ad_line": f"sum(CASE WHEN i = 0 THEN 0e0 ELSE mfv END) OVER {L}", "ease_of_movement": mean("eom", 10)}, "st"),
    "shared_rules": select(BARS + f", l AS (SELECT *, list(close) OVER {w(10)} AS l FROM b)", {
        "price_rank": full("len(list_filter(l, lambda x: x < close)) / 9e0", 10), "price_zscore": f"(close - ({_m20})) / CASE WHEN ({_s20}) = 0 THEN 1 ELSE ({_s20}) END",
        "price_slope": f"(close - {lag('close', 9)}) / 9", "volume_sma": mean("volume", 8), "alma": f"close - {lag('close', 8)}", "funding_rate": "0e0", "orderbook_imbalance": "0e0"}, "l"),
    "exponential": select(BARS + f""", x AS (SELECT *, coalesce((close - {lag('close')}) * volume, 0e0) AS fi, coalesce(2 * close - {lag('close', 5)}, close) AS zl FROM b), {_TR},
        a AS (SELECT x.*, tr.tr FROM x JOIN tr USING (symbol, i)),
        e AS (SELECT *, {ema('close', 10)} AS e10, {ema('close', 13)} AS e13, {ema('close', 26)} AS e26, {ema('close', 20)} AS e20, {ema('fi', 13)} AS f13, {ema('zl', 12)} AS z12, {mean('tr', 20)} AS atr FROM a)""", {
        "ema": "e10", "macd": "e13 - e26", "ppo": "(e10 - e20) / e20", "force_index": "f13", "zlema": "z12", "keltner_middle": "e20", "keltner_upper": "e20 + 2 * atr", "keltner_lower": "e20 - 2 * atr"}, "e"),
    "chained": select(BARS + f""", a1 AS (SELECT *, coalesce(close - {lag('close')}, 0e0) AS mo, abs(coalesce(close - {lag('close')}, 0e0)) AS am,
        {', '.join(f"coalesce((close - {lag('close', n - 1)}) / greatest(1e-12, {lag('close', n - 1)}) * CASE WHEN i >= {n - 1} THEN 1 END, 0e0) AS r{n}" for n in (5, 10, 15, 20))} FROM b),
        a2 AS (SELECT *, {ema('close', 9)} AS e1, {ema('mo', 12)} AS m1, {ema('am', 12)} AS n1, {ema('r5', 5)} AS k1, {ema('r10', 5)} AS k2, {ema('r15', 5)} AS k3, {ema('r20', 10)} AS k4 FROM a1),
        a3 AS (SELECT *, {ema('e1', 9)} AS e2, {ema('m1', 6)} AS m2, {ema('n1', 6)} AS n2 FROM a2), a4 AS (SELECT *, {ema('e2', 9)} AS e3 FROM a3)""", {
        "dema": "2 * e1 - e2", "tema": "3 * e1 - 3 * e2 + e3", "trix": f"(e3 - {lag('e3')}) / {lag('e3')} * 100", "tsi": "100 * m2 / greatest(1e-12, n2)", "kst": "k1 + 2 * k2 + 3 * k3 + 4 * k4"}, "a4"),
    "adaptive": select(BARS + f""", s AS (SELECT *, abs(close - {lag('close', 10)}) AS ch, abs(close - {lag('close')}) AS st FROM b),
        v AS (SELECT *, sum(st) OVER {w(10)} AS vol FROM s), c AS (SELECT symbol, i, close, pow(coalesce(ch / nullif(vol, 0), 0e0) * (2e0 / 3 - 2e0 / 31) + 2e0 / 31, 2) AS sc FROM v),
        k AS (SELECT symbol, i, close AS kama FROM c WHERE i = 9 UNION ALL SELECT c.symbol, c.i, k.kama + c.sc * (c.close - k.kama) FROM k JOIN c ON c.symbol = k.symbol AND c.i = k.i + 1)""",
        {"kama": "k.kama"}, "c LEFT JOIN k USING (symbol, i)"),
}


def signal_cte(kind: str = "flagship", part: str = "symbol", source: str = "b", shift: int = 0, name: str = "sig") -> str:
    """CTEs that end in ``name`` with a signal over a source with symbol (and other parts), i and prices: the flagship's (RSI 17 - EMA 63) / ATR 21 or
    the crossover's (SMA 5 - SMA 20) / ATR 14, with all periods shifted."""
    o = f"(PARTITION BY {part} ORDER BY i"
    rows = lambda p: f"{o} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
    roll = lambda x, p: f"CASE WHEN i >= {p - 1} THEN avg({x}) OVER {rows(p)} END"
    prev = f"lag(close) OVER {o})"
    first = f"""{name}0 AS (SELECT *, close - {prev} AS d, CASE WHEN {prev} IS NULL THEN 0e0 ELSE greatest(high - low, abs(high - {prev}), abs(low - {prev})) END AS tr FROM {source}),"""
    if kind == "crossover":
        a, c, t = (max(2, p + shift) for p in (5, 20, 14))
        return f"""{first}
{name}1 AS (SELECT *, {roll('close', a)} AS s5, {roll('close', c)} AS s20, {roll('tr', t)} AS atr FROM {name}0), {name} AS (SELECT *, (s5 - s20) / nullif(atr, 0) AS signal FROM {name}1)"""
    r, e, t = (max(2, p + shift) for p in (17, 63, 21))
    up, down = f"sum(greatest(d, 0)) OVER {rows(r)}", f"sum(greatest(-d, 0)) OVER {rows(r)}"
    w = 2 / (e + 1)
    return f"""{first}
{name}1 AS (SELECT *, CASE WHEN i >= {r} THEN CASE WHEN {down} = 0 THEN 100e0 ELSE 100 - 100 / (1 + {up} / {down}) END END AS rsi,
 list_reduce(list(CAST(close AS DOUBLE)) OVER {o}), lambda a, b: {w:.17e} * b + {1 - w:.17e} * a) AS ema, {roll('tr', t)} AS atr FROM {name}0), {name} AS (SELECT *, (rsi - ema) / nullif(atr, 0) AS signal FROM {name}1)"""


def curve_cte(source: str, part: str, cost: str = FIXED, name: str = "cur") -> str:
    o = f"(PARTITION BY {part} ORDER BY i)"
    return f"""{name}0 AS (SELECT *, CASE WHEN signal IS NULL THEN 0 WHEN signal > 0 THEN 1 WHEN abs(signal) < 1e-12 THEN 0 ELSE -1 END AS raw FROM {source}),
{name}1 AS (SELECT *, coalesce(lag(raw) OVER {o}, 0) AS position, coalesce(close / lag(close) OVER {o} - 1, 0e0) AS mv FROM {name}0),
{name}2 AS (SELECT *, coalesce(lag(position) OVER {o}, 0) AS held FROM {name}1),
{name}3 AS (SELECT *, abs(position - held) AS turn, abs(position - held) * {cost} AS cost, held * mv - abs(position - held) * {cost} AS ret FROM {name}2),
{name} AS (SELECT *, product(1 + ret) OVER {o} AS equity FROM {name}3)"""


def metrics_sql(source: str, part: str, keys: str, digits: int | None = 6) -> str:
    """The metrics of curves; digits None: as they are, for what is calculated from them."""
    r = (lambda x: f"round({x}, {digits}) + 0e0") if digits is not None else (lambda x: f"CAST({x} AS DOUBLE)")
    return f"""pk AS (SELECT *, max(equity) OVER (PARTITION BY {part} ORDER BY i) AS peak, lag(equity) OVER (PARTITION BY {part} ORDER BY i) IS NOT NULL AS later FROM {source}),
mt AS (SELECT {part}, count(*) AS n, avg(ret) FILTER (later) AS m, stddev_samp(ret) FILTER (later) AS s, sum(ret * ret) FILTER (later AND ret < 0) AS dd, count(*) FILTER (later AND ret < 0) AS nd,
 arg_max(equity, i) AS e1, arg_min(equity, i) AS e0, min(equity / peak - 1) AS low, count(*) FILTER (turn > 0) AS trades, sum(cost) AS costs FROM pk GROUP BY {part})
SELECT {keys}, {r(f"CASE WHEN n < 3 OR s IS NULL OR s = 0 THEN 0e0 ELSE {ROOT} * m / s END")} AS sharpe, CASE WHEN nd = 0 THEN CAST('inf' AS DOUBLE) ELSE {r(f"{ROOT} * m / sqrt(dd / nd)")} END AS sortino,
 {r("e1 / e0 - 1")} AS total_return, {r("abs(low)")} AS max_drawdown, {r("trades / greatest(1, n - 1)")} AS turnover, trades, {r("costs")} AS costs_paid FROM mt"""


_AFTER = """
a AS (SELECT symbol, effective_at, action_id, CASE WHEN split_factor IS NULL OR isnan(split_factor) THEN 1e0 ELSE split_factor END AS s, CASE WHEN cash_dividend IS NULL OR isnan(cash_dividend) THEN 0e0 ELSE cash_dividend END AS d
      FROM corporate_actions WHERE effective_at IS NOT NULL),
f AS (SELECT f.row_id, list({'s': a.s, 'd': a.d, 'x': 0e0} ORDER BY a.effective_at DESC, a.action_id DESC) AS l FROM feed f JOIN a ON a.symbol = f.symbol AND a.effective_at > f.ts GROUP BY f.row_id)"""


def _adjusted(c: str) -> str:
    fold = f"list_reduce(list_prepend({{'s': 1e0, 'd': 0e0, 'x': {c}}}, l), lambda p, q: {{'s': q.s, 'd': q.d, 'x': p.x / q.s - q.d}}).x"
    return f"CAST(CASE WHEN l IS NULL THEN {c} ELSE {fold} END AS FLOAT) AS {c}"


_CLEAR = ["close - lag(close, 5) OVER w", "close - lag(close, 20) OVER w", "CASE WHEN i >= 29 THEN avg(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - avg(close) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END"]
_WALK = """n AS (SELECT symbol, count(*) AS n FROM b GROUP BY 1), z AS (SELECT symbol, n, greatest(1, CAST(floor(n * 2e-1) AS BIGINT)) AS t, greatest(1, CAST(floor(n * 5e-1) AS BIGINT)) AS s FROM n),
fo AS (SELECT b.* EXCLUDE (i), (b.i - z.s) // z.t AS fold, (b.i - z.s) % z.t AS i FROM b JOIN z USING (symbol) WHERE b.i >= z.s AND (b.i - z.s) // z.t < 3),
bnd AS (SELECT DISTINCT symbol, fold, CAST(0 AS BIGINT) AS train_start, s + fold * t AS train_end, s + fold * t AS test_start, least(n, s + (fold + 1) * t) AS test_end FROM fo JOIN z USING (symbol))"""
_PURGED = """n AS (SELECT symbol, count(*) AS n, greatest(1, count(*) // 3) AS t FROM b GROUP BY 1),
fo AS (SELECT b.* EXCLUDE (i), least(b.i // n.t, 2) AS fold, b.i - least(b.i // n.t, 2) * n.t AS i FROM b JOIN n USING (symbol)),
ab AS (SELECT DISTINCT symbol, fold, n, greatest(0, fold * t - 1) AS train_end, fold * t AS test_start, CASE WHEN fold = 2 THEN n ELSE least(n, (fold + 1) * t) END AS test_end FROM fo JOIN n USING (symbol)),
bnd AS (SELECT symbol, fold, CASE WHEN test_end + 1 < n THEN test_end + 1 ELSE train_end END AS train_start, train_end, test_start, test_end FROM ab)"""


def fold_sql(cte: str, kind: str = "flagship", bounds: bool = True, digits: int | None = 6) -> str:
    part = "symbol, fold"
    per = f"WITH {BARS}, {cte}, {signal_cte(kind, part, 'fo')}, {curve_cte('sig', part)}, {metrics_sql('cur', part, 'symbol, CAST(fold AS INTEGER) AS fold', digits)}"
    if not bounds:
        return per
    cut = f"WITH {BARS}, {cte} SELECT symbol, CAST(fold AS INTEGER) AS fold, train_start, train_end, test_start, test_end FROM bnd"
    return f"SELECT * FROM ({cut}) JOIN ({per}) USING (symbol, fold)"


def _sensitivity(kind: str) -> str:
    variants = ", ".join(signal_cte(kind, shift=k, name=f"v{k + 3}_") for k in range(-3, 4))
    return f"WITH {BARS}, {variants}, sig AS (" + " UNION ALL ".join(f"SELECT symbol, i, close, signal, {k} AS delta FROM v{k + 3}_" for k in range(-3, 4)) + f"), {curve_cte('sig', 'symbol, delta')}, {metrics_sql('cur', 'symbol, delta', 'symbol, delta')}"


def _costs(kind: str) -> str:
    return f"WITH {BARS}, {signal_cte(kind, name='sg')}, sig AS (SELECT sg.*, m.multiplier FROM sg, (VALUES (5e-1), (1e0), (15e-1), (2e0), (3e0)) m(multiplier)), {curve_cte('sig', 'symbol, multiplier', FIXED + ' * multiplier')}, {metrics_sql('cur', 'symbol, multiplier', 'symbol, multiplier')}"


def _curve(kind: str) -> str:
    return f"WITH {BARS}, {signal_cte(kind)}, {curve_cte('sig', 'symbol')} SELECT symbol, i AS bar_idx, raw, position, round(ret, 6) + 0e0 AS ret, round(equity, 6) + 0e0 AS equity FROM cur"


def _metrics(kind: str) -> str:
    return f"WITH {BARS}, {signal_cte(kind)}, {curve_cte('sig', 'symbol')}, {metrics_sql('cur', 'symbol', 'symbol')}"


_MEASURES = ("sharpe", "sortino", "total_return", "max_drawdown", "turnover", "trades", "costs_paid")


def _suite(kind: str) -> str:
    long = lambda source, method, scenario: " UNION ALL ".join(f"SELECT symbol, '{method}' AS method, CAST({scenario} AS VARCHAR) AS scenario, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in _MEASURES)
    drawn = monte_carlo_sql(f"{BARS}, {signal_cte(kind)}, {curve_cte('sig', 'symbol')}, r AS (SELECT symbol, i, ret FROM cur)", "symbol", 7, 20)
    quantiles = " UNION ALL ".join(f"SELECT symbol, 'monte_carlo', '{q}', metric, {q} FROM mc" for q in ("p05", "p50", "p95"))
    return f"WITH co AS ({_costs(kind)}), pa AS ({_sensitivity(kind)}), mc AS ({drawn}) {long('co', 'cost_sensitivity', 'multiplier')} UNION ALL {long('pa', 'parameter_sensitivity', 'delta')} UNION ALL {quantiles}"


def monte_carlo_sql(ctes: str, key: str, seed: int, sims: int) -> str:
    """Quantiles over reshuffles of the returns r (key, i, ret) behind bar 0."""
    return f"""WITH {ctes}, m AS (SELECT unnest(range({sims})) AS sim), g AS (SELECT r.*, m.sim, md5(concat_ws('|', {seed}, m.sim, r.i)) AS o FROM r, m WHERE r.i > 0),
e AS (SELECT *, product(1 + ret) OVER w AS e FROM g WINDOW w AS (PARTITION BY {key}, sim ORDER BY o)), k AS (SELECT *, e / greatest(1e0, max(e) OVER (PARTITION BY {key}, sim ORDER BY o)) - 1 AS dd FROM e),
p AS (SELECT {key}, sim, arg_max(e, o) - 1 AS total_return, coalesce({ROOT} * avg(ret) / nullif(stddev_samp(ret), 0), 0) AS sharpe, abs(least(min(dd), 0)) AS max_drawdown FROM k GROUP BY ALL),
l AS ({" UNION ALL ".join(f"SELECT {key}, '{x}' AS metric, {x} AS v FROM p" for x in ("total_return", "sharpe", "max_drawdown"))})
SELECT {key}, metric, """ + ", ".join(f"round(list_sort(list(v))[CAST(floor({sims - 1} * {p}) AS INTEGER) + 1], 6) + 0e0 AS {n}" for p, n in (("5e-2", "p05"), ("5e-1", "p50"), ("95e-2", "p95"))) + " FROM l GROUP BY ALL"


ORACLE = {
    "bars": select(BARS, {c: c for c in ("open", "high", "low", "close", "volume")}, "b"),
    **{f"prim_{g}": q for g, q in PRIMITIVES.items()},
    "quality_report": """
WITH x AS (SELECT *, (open_px IS NULL OR NOT isfinite(open_px) OR high_px IS NULL OR NOT isfinite(high_px) OR low_px IS NULL OR NOT isfinite(low_px) OR close_px IS NULL OR NOT isfinite(close_px) OR volume IS NULL OR NOT isfinite(volume)) AS odd,
  lag(ts) OVER (PARTITION BY symbol ORDER BY row_id) AS before FROM feed),
y AS (SELECT *, NOT odd AND (high_px < greatest(open_px, close_px) OR low_px > least(open_px, close_px) OR high_px < low_px) AS wrong FROM x)
SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, ts FROM feed)) AS duplicates, count(*) FILTER (wrong) AS inconsistent,
  count(*) FILTER (odd) AS not_finite, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (before > ts AND symbol IS NOT NULL) AS out_of_order FROM y""",
    "chronological_split": """
WITH x AS (SELECT row_id, row_number() OVER (ORDER BY ts NULLS FIRST, row_id) AS r, count(*) OVER () AS n FROM feed)
SELECT row_id, CASE WHEN r <= greatest(1, CAST(floor(n * (1 - 2e-1)) AS BIGINT)) THEN 'train' ELSE 'test' END AS part FROM x""",
    "pit_visible": "SELECT row_id, symbol, CASE WHEN NOT isnan(close_px) THEN close_px END AS close_px FROM feed WHERE coalesce(available_at, ts) <= TIMESTAMP '2024-06-01'",
    "corporate_actions_adjusted": f"WITH {_AFTER} SELECT row_id, symbol, " + ", ".join(_adjusted(c) for c in ("open_px", "high_px", "low_px", "close_px")) + " FROM feed LEFT JOIN f USING (row_id) WHERE symbol IS NOT NULL AND ts IS NOT NULL",
    "universe_asof": """
WITH d AS (SELECT unnest(generate_series(TIMESTAMP '2018-01-01', TIMESTAMP '2025-01-01', INTERVAL 3 MONTH)) AS as_of)
SELECT d.as_of, m.symbol FROM d JOIN memberships m ON m.included_at <= d.as_of AND (m.excluded_at IS NULL OR m.excluded_at > d.as_of)""",
    "universe_faults": "SELECT membership_id, symbol FROM memberships WHERE excluded_at <= included_at",
    "reconcile_positions": """
WITH f AS (SELECT fill_id, exec_ref, symbol, CASE WHEN side = 'sell' THEN -quantity ELSE quantity END AS q FROM fills WHERE symbol IS NOT NULL),
a AS (SELECT symbol, sum(q) AS x FROM f GROUP BY 1), o AS (SELECT arg_min(symbol, fill_id) AS symbol, arg_min(q, fill_id) AS q FROM f GROUP BY exec_ref), c AS (SELECT symbol, sum(q) AS y FROM o GROUP BY 1)
SELECT symbol, round(coalesce(x, 0), 6) + 0e0 AS internal, round(coalesce(y, 0), 6) + 0e0 AS external, abs(coalesce(x, 0) - coalesce(y, 0)) <= greatest(1e-6 * greatest(abs(coalesce(x, 0)), abs(coalesce(y, 0))), 1e-8) AS matched FROM a FULL JOIN c USING (symbol)""",
    "ledger_positions": """
WITH f AS (SELECT fill_id, symbol, ts, coalesce(CASE WHEN side = 'sell' THEN -quantity ELSE quantity END, 0) AS q, coalesce(price, 0) AS p, coalesce(fee, 0) AS fee FROM fills WHERE symbol IS NOT NULL AND ts IS NOT NULL)
SELECT fill_id, symbol, round(sum(q) OVER (PARTITION BY symbol ORDER BY ts, fill_id), 4) + 0e0 AS position, round(-(q * p) - fee, 4) + 0e0 AS cash_flow FROM f""",
    "backtest_curve": _curve("flagship"), "crossover_curve": _curve("crossover"), "backtest_metrics": _metrics("flagship"), "crossover_metrics": _metrics("crossover"),
    "cross_sectional_backtest": f"""
WITH {BARS}, lim AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM b GROUP BY symbol)),
s AS (SELECT symbol, i, close, close / lag(close, 10) OVER {L} - 1 AS sg FROM b),
t AS (SELECT symbol, i, coalesce(lag(sg) OVER {L}, 0e0) AS sc, coalesce(close / {lag('close')} - 1, 0e0) AS mv FROM s WHERE i < (SELECT n FROM lim)),
u AS (SELECT *, sc - avg(sc) OVER (PARTITION BY i) AS v FROM t), x AS (SELECT *, sum(greatest(v, 0)) OVER (PARTITION BY i) AS lo, sum(abs(least(v, 0))) OVER (PARTITION BY i) AS sh FROM u),
y AS (SELECT *, CASE WHEN i < 1 THEN 0e0 WHEN v > 0 THEN least(2e-1, v / lo * 5e-1) WHEN v < 0 THEN greatest(-2e-1, v / sh * 5e-1) ELSE 0e0 END AS wt FROM x),
z AS (SELECT *, coalesce(lag(wt) OVER {L}, 0e0) AS was FROM y),
g AS (SELECT i, CASE WHEN i = 0 THEN 0e0 ELSE sum(was * mv) END AS gross, CASE WHEN i = 0 THEN 0e0 ELSE sum(abs(wt - was)) * {FIXED} END AS cost, CASE WHEN i = 0 THEN 0 ELSE count(*) FILTER (abs(wt - was) > 1e-6) END AS trades FROM z GROUP BY i)
SELECT i AS bar_idx, trades, round(gross, 6) + 0e0 AS gross, round(cost, 6) + 0e0 AS cost, round(gross - cost, 6) + 0e0 AS ret, round(product(1 + gross - cost) OVER (ORDER BY i), 6) + 0e0 AS equity FROM g""",
    "central_clearing": f"WITH {BARS}, s AS (" + " UNION ALL ".join(f"SELECT symbol, i, close, 'strat_{j}' AS strategy, {x} AS signal FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i)".replace("(w ROWS", "(PARTITION BY symbol ORDER BY i ROWS") for j, x in enumerate(_CLEAR)) + f"""),
r AS (SELECT *, CASE WHEN signal IS NULL THEN 0 WHEN signal > 0 THEN 1 WHEN abs(signal) < 1e-12 THEN 0 ELSE -1 END AS raw FROM s),
p AS (SELECT *, coalesce(lag(raw) OVER w, 0) AS position, coalesce(close / lag(close) OVER w - 1, 0e0) AS mv FROM r WINDOW w AS (PARTITION BY symbol, strategy ORDER BY i)),
h AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, strategy ORDER BY i), 0) AS held FROM p), n AS (SELECT *, position - held AS od, sum(position - held) OVER (PARTITION BY symbol, i) AS net FROM h),
c AS (SELECT *, CASE WHEN net = 0 THEN 0e0 ELSE od * (abs(net) * {FIXED} / net) END AS cost FROM n), q AS (SELECT *, held * mv - cost AS ret FROM c)
SELECT symbol, strategy, i AS bar_idx, position, CASE WHEN i = 0 THEN 0 ELSE od END AS "order", round(cost, 6) + 0e0 AS cost, round(ret, 6) + 0e0 AS ret, round(product(1 + ret) OVER (PARTITION BY symbol, strategy ORDER BY i), 6) + 0e0 AS equity FROM q""",
    "cost_sensitivity": _costs("flagship"), "parameter_sensitivity": _sensitivity("flagship"), "crossover_costs": _costs("crossover"), "crossover_parameters": _sensitivity("crossover"), "robustness_suite": _suite("crossover"),
    "walk_forward": fold_sql(_WALK), "purged_cross_validation": fold_sql(_PURGED), "crossover_walk_forward": fold_sql(_WALK, "crossover"), "crossover_purged": fold_sql(_PURGED, "crossover"),
    **{n: f"WITH f AS ({fold_sql(c, k, False, None)}) SELECT symbol, " + ", ".join(f"round(avg({m}), 6) + 0e0 AS {m}" for m in _MEASURES) + " FROM f GROUP BY symbol" for n, c, k in (("walk_forward_mean", _WALK, "crossover"), ("purged_mean", _PURGED, "crossover"))},
}
