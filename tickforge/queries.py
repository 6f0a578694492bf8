"""Queries over the events tape, one for each operator, with the SQL that they can be checked by.

The SQL is written from the definitions (interval joins, literal filters), not
after the plans, so that the two sides can disagree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import microstructure as ms
from tickforge.functions import stats
from tickforge.functions.tables import kept
from tickforge.functions.windows import rolling
from tickforge.operators import backtest as bt
from tickforge.operators import bars as B
from tickforge.operators import cv, fracdiff, importance, jobs, sizing
from tickforge.operators import labeling as L
from tickforge.operators import sampling as S
from tickforge.plans import features as fe
from tickforge.sources import ticks as src

#: Cents; 377 bars in the table of 10,000 events.
DOLLARS, VOLUME, TICKS = 20_000_000, 1_000, 25
HOUR = 3_600_000_000
HORIZON, HOLDING = 6 * HOUR, 24 * HOUR
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def tape(spark: SparkSession, d: str) -> DataFrame:
    return src.from_events(spark.read.parquet(f"{d}/events.parquet"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Dollar bars, written once: most queries read them, along several branches."""
    return kept(spark, "bars", d, lambda: B.dollar_bars(tape(spark, d), DOLLARS))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


T = """t AS MATERIALIZED (
  SELECT *, price * volume AS dollar FROM (
    SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, epoch_us(ts) AS us,
      CAST(round(value * 100) AS BIGINT) + 10000 AS price, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events))"""
SIGNED = T + """,
ch AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY seq)) AS c FROM t),
s AS MATERIALIZED (
  SELECT * EXCLUDE (c), CAST(coalesce(last_value(nullif(c, 0) IGNORE NULLS) OVER (
    PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS INTEGER) AS sign FROM ch)"""


def keyed(weight: str, threshold: int) -> str:
    return SIGNED + f""",
k AS MATERIALIZED (
  SELECT *, CASE WHEN (cum - w) // {threshold} < total // {threshold} THEN (cum - w) // {threshold} END AS key FROM (
    SELECT *, {weight} AS w, sum({weight}) OVER (PARTITION BY symbol ORDER BY seq) AS cum, sum({weight}) OVER (PARTITION BY symbol) AS total FROM s))"""


AGG = """,
b AS MATERIALIZED (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY max(seq)) - 1 AS bar_seq, max(us) AS us, arg_min(price, seq) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(dollar) AS BIGINT) AS dollar, count(*) AS n_ticks,
    CAST(sum(dollar) AS DOUBLE) / CAST(sum(volume) AS DOUBLE) AS vwap, CAST(sum(CASE WHEN sign > 0 THEN volume ELSE 0 END) AS BIGINT) AS buy_volume,
    CAST(sum(sign * dollar) AS BIGINT) AS signed_dollar, max(seq) AS last_seq, key FROM k WHERE key IS NOT NULL GROUP BY symbol, key)"""
BARS = keyed("dollar", DOLLARS) + AGG
SHOWN = "symbol, bar_seq, us, open, high, low, close, volume, dollar, n_ticks, round(vwap, 6) AS vwap, buy_volume, signed_dollar"
W = "OVER (PARTITION BY symbol ORDER BY bar_seq ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def show_bars(b: DataFrame) -> DataFrame:
    return rounded(b.select("symbol", "bar_seq", "us", *B.BAR_COLUMNS), "vwap")


def roll(expr: str, of: str, k: int) -> str:
    """A rolling aggregate that is null until there are k values."""
    w = W.format(k - 1)
    return f"CASE WHEN count({of}) {w} = {k} THEN {expr} {w} END"


# --- sources and bars ---
@query("src3_tick_tape", f"WITH {T} SELECT symbol, seq, us, price, volume, dollar FROM t")
def _(s, d):
    return tape(s, d).select("symbol", "seq", "us", "price", "volume", "dollar")


@query("bar1_tick_rule", f"WITH {SIGNED} SELECT symbol, seq, sign FROM s")
def _(s, d):
    return B.tick_rule(tape(s, d)).select("symbol", "seq", "sign")


@query("bar2_assemble_ohlcv", f"WITH {BARS} SELECT {SHOWN} FROM b")
def _(s, d):
    return show_bars(B.assemble(B.bar_keys(B.tick_rule(tape(s, d)), DOLLARS, "dollar"), "key"))


@query("bar3_standard_bars", f"WITH {BARS} SELECT {SHOWN} FROM b")
def _(s, d):
    return show_bars(B.standard_bars(tape(s, d), DOLLARS, "dollar"))


for _kind, _w, _n in (("tick", "1", TICKS), ("volume", "volume", VOLUME), ("dollar", "dollar", DOLLARS)):
    Q[f"bar4_{_kind}_bars"] = lambda s, d, k=_kind, n=_n: show_bars(B.standard_bars(tape(s, d), n, k))
    SQL[f"bar4_{_kind}_bars"] = f"WITH {keyed(_w, _n)}{AGG} SELECT {SHOWN} FROM b"

INFO = dict(length_span=20, flow_span=50, warm_up=40, least=5, most=200)


def info_sql(mode: str) -> str:
    """The state machine as a recursive query: one row a tick, joined to the next by seq."""
    flow, pace = 2 / (INFO["flow_span"] + 1), 2 / (INFO["length_span"] + 1)
    theta = "abs(plus - minus)" if mode == "imbalance" else "greatest(plus, minus)"
    expected = "abs(2 * p * eb - (p * eb + (1 - p) * es))" if mode == "imbalance" else "greatest(p * eb, (1 - p) * es)"
    return f"""WITH RECURSIVE {SIGNED},
x AS (SELECT symbol, seq, us, CASE WHEN sign > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS buy, volume::DOUBLE AS v FROM s),
r AS (
  SELECT symbol, 0::BIGINT AS seq, 0::BIGINT AS us, 0::BIGINT AS n, 0.0::DOUBLE AS plus, 0.0::DOUBLE AS minus, NULL::DOUBLE AS eb, NULL::DOUBLE AS es, NULL::DOUBLE AS p,
    {INFO['warm_up']}::DOUBLE AS len, 0 AS fired FROM (SELECT DISTINCT symbol FROM x)
  UNION ALL
  SELECT symbol, seq, us, CASE WHEN f = 1 THEN 0 ELSE n END, CASE WHEN f = 1 THEN 0 ELSE plus END, CASE WHEN f = 1 THEN 0 ELSE minus END, eb, es, p,
    CASE WHEN f = 1 THEN least(greatest(len + {pace!r} * (n - len), {INFO['least']}), {INFO['most']}) ELSE len END, f FROM (
    SELECT *, CASE WHEN eb IS NULL OR es IS NULL OR n < {INFO['least']} THEN 0 WHEN n >= {INFO['most']} OR {theta} >= len * {expected} THEN 1 ELSE 0 END AS f FROM (
      SELECT x.symbol, x.seq, x.us, r.n + 1 AS n, r.plus + x.buy * x.v AS plus, r.minus + (1 - x.buy) * x.v AS minus,
        CASE WHEN x.buy = 0 THEN r.eb WHEN r.eb IS NULL THEN x.v ELSE r.eb + {flow!r} * (x.v - r.eb) END AS eb,
        CASE WHEN x.buy = 1 THEN r.es WHEN r.es IS NULL THEN x.v ELSE r.es + {flow!r} * (x.v - r.es) END AS es,
        CASE WHEN r.p IS NULL THEN x.buy ELSE r.p + {flow!r} * (x.buy - r.p) END AS p, r.len
      FROM r JOIN x ON x.symbol = r.symbol AND x.seq = r.seq + 1)))
SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS bar_seq, us FROM r WHERE fired = 1"""


@query("bar6_imbalance_bars", info_sql("imbalance"))
def _(s, d):
    return B.imbalance_bars(tape(s, d), "volume", **INFO).select("symbol", "bar_seq", "us")


@query("bar7_run_bars", info_sql("run"))
def _(s, d):
    return B.run_bars(tape(s, d), "volume", **INFO).select("symbol", "bar_seq", "us")


@query("rs1_hourly_last", f"WITH {T} SELECT symbol, us // {HOUR} AS hour, arg_max(price, seq) AS price FROM t GROUP BY ALL")
def _(s, d):
    h = src.hourly_last(tape(s, d))
    return h.select("symbol", F.floor(F.unix_micros("ts") / HOUR).alias("hour"), "price")


@query("rs2_monthly_sum", f"WITH {T} SELECT symbol, strftime(make_timestamp(us), '%Y-%m') AS month, CAST(sum(dollar) AS BIGINT) AS dollar FROM t GROUP BY ALL")
def _(s, d):
    return src.monthly_sum(tape(s, d), "dollar").select("symbol", F.date_format("month", "yyyy-MM").alias("month"), "dollar")


# --- microstructure ---
def windowed(s, d, columns, stages=()):
    b = fe.flow_signs(bars(s, d))
    out = rolling(b, "bar_seq", 300, [ms.changes, ms.lagged, *stages, columns])
    return out


X = BARS + """,
f AS (SELECT *, sign(signed_dollar) AS sg FROM b),
x AS MATERIALIZED (
  SELECT *, close - lag(close) OVER w AS dp, ln(close) - lag(ln(close)) OVER w AS r,
    coalesce(last_value(nullif(sg, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS fs
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bar_seq)),
y AS MATERIALIZED (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY bar_seq) AS r1 FROM x)"""


def ols(y: str, x: str, k: int) -> str:
    return f"{roll(f'sum({y} * {x})', f'{y} * {x}', k)} / nullif({roll(f'sum({x} * {x})', f'{y} * {x}', k)}, 0)"


_SLOPES = {
    "ms5_kyle_lambda": (lambda w: ms.kyle(w, 20), ols("dp", "(fs * volume)", 20), 1),
    "ms6_amihud_lambda": (lambda w: ms.amihud(w, 20), ols("abs(r)", "CAST(dollar AS DOUBLE)", 20), 1e9),
    "ms7_hasbrouck_lambda": (lambda w: ms.hasbrouck(w, 20), ols("r", "(fs * sqrt(dollar))", 20), 1e6),
    "ms2_roll_measure": (lambda w: ms.roll_spread(F.col("_r"), F.col("_r1"), w, 20), f"2 * sqrt(greatest(-({roll('covar_samp(r, r1)', 'r * r1', 20)}), 0))", 1),
    "ms8_vpin": (lambda w: ms.vpin(w, 20), f"{roll('sum(abs(2 * buy_volume - volume))', 'volume', 20)} / {roll('sum(volume)', 'volume', 20)}", 1),
    "ms9_order_flow_imbalance": (lambda w: ms.order_flow_imbalance(), "CAST(signed_dollar AS DOUBLE) / dollar", 1),
    "ms3_roll_impact": (lambda w: ms.ratio(ms.roll_spread(F.col("_r"), F.col("_r1"), w, 20), F.col("dollar")), f"2 * sqrt(greatest(-({roll('covar_samp(r, r1)', 'r * r1', 20)}), 0)) / dollar", 1e8),
    "ms1_rolling_ols": (lambda w: ms.slope(F.col("_r"), F.col("_r1"), w, 30), ols("r", "r1", 30), 1),
}
for _name, (_f, _sql, _scale) in _SLOPES.items():
    Q[_name] = lambda s, d, f=_f, k=_scale: windowed(s, d, lambda w: {"value": F.round(f(w) * float(k), 6)}).select("symbol", "bar_seq", "value")
    SQL[_name] = f"WITH {X} SELECT symbol, bar_seq, round(({_sql}) * {float(_scale)!r}, 6) AS value FROM y"


@query("ms4_corwin_schultz", f"""WITH {BARS},
p AS MATERIALIZED (SELECT symbol, bar_seq, {roll("sum(pow(ln(high / low), 2))", "high", 2)} AS b2, CASE WHEN bar_seq > 0 THEN pow(ln(max(high) {W.format(1)} / min(low) {W.format(1)}), 2) END AS g FROM b),
e AS (SELECT symbol, bar_seq, g, {roll("avg(b2)", "b2", 20)} AS beta, 3 - 2 * sqrt(2) AS den FROM p),
a AS (SELECT *, CASE WHEN beta IS NOT NULL THEN greatest(0, (sqrt(2) - 1) * sqrt(beta) / den - sqrt(g / den)) END AS alpha FROM e)
SELECT symbol, bar_seq, round(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 6) AS cs_spread,
  round(CASE WHEN beta IS NOT NULL THEN greatest(0, (sqrt(2) - 1) * sqrt(beta) / den / sqrt(8 / pi()) + sqrt(g / (8 / pi() * den))) END, 6) AS cs_sigma FROM a""")
def _(s, d):
    out = rolling(bars(s, d), "bar_seq", 300, ms.corwin_stages(20))
    return rounded(out.select("symbol", "bar_seq", "cs_spread", "cs_sigma"), "cs_spread", "cs_sigma")


def sums(s, d) -> tuple[DataFrame, DataFrame]:
    k = B.bar_keys(B.tick_rule(tape(s, d)), DOLLARS, "dollar")
    b = B.assemble(k, "key")
    return ms.tick_sums(k, "key", b), b


TS = BARS + """,
dl AS (SELECT *, coalesce(ln(price) - lag(ln(price)) OVER w, 0) AS dp FROM k WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
d2 AS (SELECT *, coalesce(lag(dp) OVER (PARTITION BY symbol ORDER BY seq), 0) AS dpl FROM dl),
ts AS MATERIALIZED (
  SELECT symbol, key, count(*) AS n, sum(dp) AS dp, sum(dpl) AS dp_lag, sum(dp * dpl) AS dp_dp_lag, sum(dp * sign * volume) AS dp_bv, sum(volume * volume) AS bv2,
    sum(abs(dp) * dollar) AS absdp_d, sum(CAST(dollar AS DOUBLE) * dollar) AS d2, sum(dp * sign * sqrt(dollar)) AS dp_bsqd, sum(dollar) AS b2d,
    sum(CASE WHEN sign > 0 THEN volume ELSE 0 END) AS buy_vol, sum(volume) AS vol FROM d2 WHERE key IS NOT NULL GROUP BY symbol, key),
tb AS MATERIALIZED (SELECT b.bar_seq, ts.* FROM ts JOIN b USING (symbol, key))"""


@query("ts2_tick_partial_sums", f"""WITH {TS} SELECT symbol, bar_seq, n, round(dp, 6) AS dp, round(dp_lag, 6) AS dp_lag, round(dp_dp_lag, 6) AS dp_dp_lag, round(dp_bv, 6) AS dp_bv,
  CAST(bv2 AS DOUBLE) AS bv2, round(absdp_d, 2) AS absdp_d, floor(d2 / 1e9) AS d2, round(dp_bsqd, 4) AS dp_bsqd, CAST(b2d AS DOUBLE) AS b2d, CAST(buy_vol AS DOUBLE) AS buy_vol, CAST(vol AS DOUBLE) AS vol FROM tb""")
def _(s, d):
    t, _ = sums(s, d)
    t = rounded(t, "dp", "dp_lag", "dp_dp_lag", "dp_bv")
    return t.withColumns({"absdp_d": F.round("absdp_d", 2), "dp_bsqd": F.round("dp_bsqd", 4), "d2": F.floor(F.col("d2") / 1e9).cast("double")})


def _ts3(k: int) -> str:
    z = {c: roll(f"sum({c})", c, k) for c in ms.SUMS}
    return f"""round(2 * sqrt(greatest(-(({z['dp_dp_lag']}) - ({z['dp']}) * ({z['dp_lag']}) / ({z['n']})) / (({z['n']}) - 1), 0)), 6) AS roll_spread,
  round(1e6 * ({z['dp_bv']}) / ({z['bv2']}), 6) AS kyle, round(1e9 * ({z['absdp_d']}) / ({z['d2']}), 6) AS amihud, round(1e6 * ({z['dp_bsqd']}) / ({z['b2d']}), 6) AS hasbrouck,
  round(abs(2 * ({z['buy_vol']}) - ({z['vol']})) / ({z['vol']}), 6) AS vpin"""


@query("ts3_rolling_tick_microstructure", f"WITH {TS} SELECT symbol, bar_seq, {_ts3(20)} FROM tb")
def _(s, d):
    t, _ = sums(s, d)
    out = rolling(t, "bar_seq", 100, [lambda w: ms.rolling_tick_columns(w, (20,))])
    c = lambda n, k: F.round(F.col(f"{n}_20") * k, 6)
    return out.select("symbol", "bar_seq", c("roll_spread", 1).alias("roll_spread"), c("kyle_lambda", 1e6).alias("kyle"), c("amihud_lambda", 1e9).alias("amihud"), c("hasbrouck_lambda", 1e6).alias("hasbrouck"), c("vpin", 1).alias("vpin"))


@query("ts1_bar_end_positions", f"WITH {BARS} SELECT symbol, bar_seq, (SELECT count(*) FROM t WHERE t.symbol = b.symbol AND t.us <= b.us) AS end_pos FROM b")
def _(s, d):
    return bars(s, d).select("symbol", "bar_seq", F.col("last_seq").alias("end_pos"))


FE = X + f""",
y1 AS (SELECT *, {roll("stddev_samp(r)", "r", 50)} AS v50, {roll("stddev_samp(r)", "r", 10)} AS v10, CAST(signed_dollar AS DOUBLE) / dollar AS ofi,
  ln(greatest((us - lag(us) OVER (PARTITION BY symbol ORDER BY bar_seq)) / 1e6, 1e-3)) AS ldur, ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY bar_seq) AS m5 FROM y)
SELECT symbol, bar_seq, round(v50, 6) AS vol_50, round(v10 / v50, 6) AS vol_ratio, round(m5 / (v50 * sqrt(5)), 6) AS mom_5, round({roll("corr(r, r1)", "r * r1", 50)}, 6) AS autocorr_50,
  round(ofi, 6) AS ofi, round({roll("avg(ofi)", "ofi", 5)}, 6) AS ofi_5, round({roll("avg(buy_volume / volume)", "volume", 20)}, 6) AS buy_ratio_20, round(ldur, 6) AS log_duration, round(ln(n_ticks), 6) AS log_n_ticks FROM y1"""


@query("fe1_build_features", f"WITH {FE}")
def _(s, d):
    names = ["vol_50", "vol_ratio", "mom_5", "autocorr_50", "ofi", "ofi_5", "buy_ratio_20", "log_duration", "log_n_ticks"]
    return rounded(fe.build_features(bars(s, d), drop=False).select("symbol", "bar_seq", *names), *names)


@query("fe1_build_features_with_ticks")
def _(s, d):
    t, b = sums(s, d)
    return fe.build_features(b, t, drop=False)


# --- fractional differencing ---
@query("fd1_get_weights", """WITH RECURSIVE w AS (SELECT 0 AS k, 1.0::DOUBLE AS v UNION ALL SELECT k + 1, -v * (0.4 - (k + 1) + 1) / (k + 1) FROM w WHERE k < 19)
SELECT CAST(k AS BIGINT) AS lag, round(v, 8) AS weight FROM w""")
def _(s, d):
    w = fracdiff.get_weights(0.4, 20)[::-1]
    return s.createDataFrame([(k, round(float(v), 8)) for k, v in enumerate(w)], "lag long, weight double")


FFD = BARS + """,
wt AS (SELECT 0 AS k, 1.0::DOUBLE AS v UNION ALL SELECT k + 1, -v * (0.5 - k) / (k + 1) FROM wt WHERE abs(-v * (0.5 - k) / (k + 1)) >= 0.01),
n AS (SELECT max(k) AS m FROM wt)"""


@query("fd2_get_weights_ffd", "WITH RECURSIVE wt AS (SELECT 0 AS k, 1.0::DOUBLE AS v UNION ALL SELECT k + 1, -v * (0.5 - k) / (k + 1) FROM wt WHERE abs(-v * (0.5 - k) / (k + 1)) >= 0.001) SELECT CAST(k AS BIGINT) AS lag, round(v, 8) AS weight FROM wt")
def _(s, d):
    w = fracdiff.get_weights_ffd(0.5, 1e-3)[::-1]
    return s.createDataFrame([(k, round(float(v), 8)) for k, v in enumerate(w)], "lag long, weight double")


def log_close(s, d):
    return bars(s, d).select("symbol", F.col("bar_seq").alias("seq"), F.log(F.col("close").cast("double")).alias("x"))


@query("fd4_frac_diff_ffd", f"WITH RECURSIVE {FFD} SELECT a.symbol, a.bar_seq AS seq, round(sum(wt.v * ln(b2.close)), 6) AS value FROM b a JOIN wt ON true JOIN b b2 ON b2.symbol = a.symbol AND b2.bar_seq = a.bar_seq - wt.k, n WHERE a.bar_seq >= n.m GROUP BY ALL")
def _(s, d):
    return rounded(fracdiff.frac_diff_ffd(log_close(s, d), "x", [0.5], 0.01).select("symbol", "seq", "value"), "value")


@query("fd3_frac_diff", f"""WITH RECURSIVE {BARS}, wt AS (SELECT 0 AS k, 1.0::DOUBLE AS v UNION ALL SELECT k + 1, -v * (0.4 - k) / (k + 1) FROM wt WHERE k < 2000),
n AS (SELECT symbol, count(*) AS n FROM b GROUP BY symbol),
sh AS (SELECT n.symbol, sum(abs(v)) OVER (PARTITION BY n.symbol ORDER BY k DESC) / sum(abs(v)) OVER (PARTITION BY n.symbol) AS share FROM n JOIN wt ON k < n.n),
sk AS (SELECT symbol, count(*) FILTER (WHERE share > 0.3) AS skip FROM sh GROUP BY symbol)
SELECT a.symbol, a.bar_seq AS seq, round(sum(wt.v * ln(c.close)), 6) AS value FROM b a JOIN sk USING (symbol) JOIN wt ON wt.k <= a.bar_seq JOIN b c ON c.symbol = a.symbol AND c.bar_seq = a.bar_seq - wt.k
WHERE a.bar_seq >= sk.skip GROUP BY ALL""")
def _(s, d):
    return rounded(fracdiff.frac_diff(log_close(s, d), "x", 0.4, 0.3), "value")


@query("fd5_min_ffd")
def _(s, d):
    return fracdiff.min_ffd(log_close(s, d), "x", [0.2, 0.4, 0.6, 0.8, 1.0], 1e-2, least=20)[1]


@query("fd6_adf")
def _(s, d):
    return fracdiff.adf(fracdiff.frac_diff_ffd(log_close(s, d), "x", [1.0], 1e-2))


# --- labels ---
RET = BARS + f""",
h AS MATERIALIZED (
  SELECT b.symbol, b.bar_seq, b.us, CAST(b.close AS DOUBLE) / p.close - 1 AS ret FROM b
  ASOF JOIN (SELECT symbol, us AS pus, close FROM b) p ON p.symbol = b.symbol AND b.us - {HORIZON} > p.pus)"""
VOL = RET + f""",
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_seq) AS n FROM h),
m AS (SELECT a.symbol, a.bar_seq, a.us, pow(1 - 2.0 / 21, a.n - c.n) AS w, c.ret FROM i a JOIN i c ON c.symbol = a.symbol AND c.n <= a.n),
m1 AS (SELECT symbol, bar_seq, us, sum(w) AS w, sum(w * w) AS w2, sum(w * ret) / sum(w) AS mean, sum(w * ret * ret) / sum(w) AS sq FROM m GROUP BY ALL),
v AS MATERIALIZED (SELECT symbol, bar_seq, us, CASE WHEN w * w - w2 > 1e-12 THEN sqrt(greatest(sq - mean * mean, 0) * w * w / (w * w - w2)) END AS trgt FROM m1)"""
CUSUM = BARS.replace("WITH", "") + """,
lr AS MATERIALIZED (SELECT symbol, bar_seq, us, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_seq) AS r FROM b),
cu AS (
  SELECT symbol, 0::BIGINT AS bar_seq, 0::BIGINT AS us, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS fired FROM (SELECT DISTINCT symbol FROM b)
  UNION ALL
  SELECT symbol, bar_seq, us, CASE WHEN NOT down < -0.5 AND up > 0.5 THEN 0 ELSE up END, CASE WHEN down < -0.5 THEN 0 ELSE down END, CASE WHEN down < -0.5 OR up > 0.5 THEN 1 ELSE 0 END FROM (
    SELECT lr.symbol, lr.bar_seq, lr.us, greatest(0, cu.up + lr.r) AS up, least(0, cu.down + lr.r) AS down FROM cu JOIN lr ON lr.symbol = cu.symbol AND lr.bar_seq = cu.bar_seq + 1)),
ev AS MATERIALIZED (SELECT symbol, bar_seq, us FROM cu WHERE fired = 1)"""
#: Every bar is an event.
LABELS = VOL + f""",
e0 AS (SELECT symbol, bar_seq, us FROM b),
e1 AS MATERIALIZED (SELECT e0.*, (SELECT min(b.us) FROM b WHERE b.symbol = e0.symbol AND b.us >= e0.us + {HOLDING}) AS v1 FROM e0),
e2 AS MATERIALIZED (SELECT e1.symbol, e1.us, e1.v1, v.trgt, CASE WHEN e1.bar_seq % 2 = 0 THEN 1.0 ELSE -1.0 END AS side FROM e1 JOIN v USING (symbol, us) WHERE v1 IS NOT NULL AND v.trgt > 0.01),
pa AS (SELECT e2.*, b.us AS hit, (CAST(b.close AS DOUBLE) / p.close - 1) * {{side}} AS mv FROM e2 JOIN b p ON p.symbol = e2.symbol AND p.us = e2.us JOIN b ON b.symbol = e2.symbol AND b.us BETWEEN e2.us AND e2.v1),
to_ AS MATERIALIZED (SELECT symbol, us, any_value(trgt) AS trgt, any_value(side) AS side, any_value(v1) AS v1, min(CASE WHEN mv > {{pt}} * trgt THEN hit END) AS pt_us, min(CASE WHEN mv < -{{sl}} * trgt THEN hit END) AS sl_us FROM pa GROUP BY symbol, us),
le AS MATERIALIZED (SELECT symbol, us, least(v1, pt_us, sl_us) AS t1, trgt, side FROM to_),
lb AS MATERIALIZED (SELECT le.*, (CAST(q.close AS DOUBLE) / p.close - 1) * {{side}} AS ret FROM le JOIN b p ON p.symbol = le.symbol AND p.us = le.us JOIN b q ON q.symbol = le.symbol AND q.us = le.t1)"""


def labels_sql(sided: bool = False) -> str:
    return LABELS.replace("{side}", "side" if sided else "1").replace("{pt}", "1.0").replace("{sl}", "0.5" if sided else "1.0")


def target(s, d) -> DataFrame:
    return kept(s, "target", d, lambda: L.get_vol(bars(s, d), 20, HORIZON))


def events(s, d, sided: bool = False) -> DataFrame:
    def make():
        b = bars(s, d)
        e = L.add_vertical_barrier(b.select("symbol", "bar_seq", "us"), b, HOLDING)
        if sided:
            e = e.withColumn("side", F.when(F.col("bar_seq") % 2 == 0, 1.0).otherwise(-1.0))
        return L.get_events(b, e.drop("bar_seq"), (1.0, 0.5), target(s, d), 0.01)

    return kept(s, f"events{int(sided)}", d, make)


@query("lb1_get_vol", f"WITH {VOL} SELECT symbol, bar_seq, us, round(trgt, 6) AS trgt FROM v")
def _(s, d):
    return rounded(target(s, d), "trgt")


@query("lb1_horizon_returns", f"WITH {RET} SELECT symbol, bar_seq, us, round(ret, 6) AS ret FROM h")
def _(s, d):
    return rounded(L.horizon_returns(bars(s, d), HORIZON), "ret")


@query("lb2_cusum_filter", f"WITH RECURSIVE {CUSUM} SELECT symbol, bar_seq, us FROM ev")
def _(s, d):
    return L.cusum_filter(bars(s, d), 0.5)


@query("lb3_vertical_barrier", f"WITH {BARS}, e AS (SELECT symbol, bar_seq, us, (SELECT min(c.us) FROM b c WHERE c.symbol = b.symbol AND c.us >= b.us + {HOLDING}) AS t1 FROM b) SELECT * FROM e WHERE t1 IS NOT NULL")
def _(s, d):
    b = bars(s, d)
    return L.add_vertical_barrier(b.select("symbol", "bar_seq", "us"), b, HOLDING)


@query("lb4_touches", f"WITH {labels_sql()} SELECT symbol, us, pt_us, sl_us FROM to_")
def _(s, d):
    b = bars(s, d)
    e = L.add_vertical_barrier(b.select("symbol", "us"), b, HOLDING).join(target(s, d).select("symbol", "us", "trgt"), ["symbol", "us"]).where("trgt > 0.01")
    return L.touches(b, e.withColumn("side", F.lit(1.0)), 1.0, 1.0).select("symbol", "us", "pt_us", "sl_us")


@query("lb5_get_events", f"WITH {labels_sql()} SELECT symbol, us, t1, round(trgt, 6) AS trgt FROM le")
def _(s, d):
    return rounded(events(s, d), "trgt")


@query("lb5_get_events_meta", f"WITH {labels_sql(True)} SELECT symbol, us, t1, round(trgt, 6) AS trgt, CAST(side AS DOUBLE) AS side FROM le")
def _(s, d):
    return rounded(events(s, d, True), "trgt")


@query("lb6_get_bins", f"WITH {labels_sql()} SELECT symbol, us, t1, round(ret, 6) AS ret, CASE WHEN ret < 0 THEN -1 ELSE 1 END AS bin FROM lb")
def _(s, d):
    b = bars(s, d)
    return rounded(L.get_bins(events(s, d), b).select("symbol", "us", "t1", "ret", "bin"), "ret")


@query("lb6_get_bins_meta", f"WITH {labels_sql(True)} SELECT symbol, us, t1, round(ret, 6) AS ret, CASE WHEN ret > 0.001 THEN 1 ELSE 0 END AS bin FROM lb")
def _(s, d):
    b = bars(s, d)
    return rounded(L.get_bins(events(s, d, True), b, 0.001).select("symbol", "us", "t1", "ret", "bin"), "ret")


@query("lb7_drop_labels", f"""WITH {BARS}, x AS (SELECT symbol, bar_seq, CASE WHEN n_ticks > 26 THEN 1 WHEN n_ticks < 24 THEN -1 ELSE 0 END AS bin FROM b),
c AS (SELECT bin, count(*) AS n, count(*) * 1.0 / (SELECT count(*) FROM x) AS share FROM x GROUP BY bin)
SELECT * FROM x WHERE bin NOT IN (SELECT bin FROM c WHERE share <= 0.4 AND n = (SELECT min(n) FROM c))""")
def _(s, d):
    bin_ = F.when(F.col("n_ticks") > 26, 1).when(F.col("n_ticks") < 24, -1).otherwise(0)
    return L.drop_labels(bars(s, d).select("symbol", "bar_seq", bin_.alias("bin")), 0.4)


@query("lb8_primary_side", f"WITH {BARS} SELECT symbol, us, CASE WHEN signed_dollar < 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS side FROM b")
def _(s, d):
    b = bars(s, d)
    return L.primary_side(b.select("symbol", "us"), b, "signed_dollar")


# --- weights: labels of a day from every bar ---
SPANS = BARS + f""",
l AS MATERIALIZED (SELECT * FROM (SELECT symbol, us, (SELECT min(c.us) FROM b c WHERE c.symbol = b.symbol AND c.us >= b.us + {HOLDING}) AS t1 FROM b) WHERE t1 IS NOT NULL),
co AS MATERIALIZED (SELECT b.symbol, b.bar_seq, b.us, count(l.us) AS c, ln(any_value(b.close)) AS lc FROM b LEFT JOIN l ON l.symbol = b.symbol AND b.us BETWEEN l.us AND l.t1 GROUP BY b.symbol, b.bar_seq, b.us),
cr AS MATERIALIZED (SELECT *, lc - lag(lc) OVER (PARTITION BY symbol ORDER BY bar_seq) AS r FROM co),
tw AS MATERIALIZED (SELECT l.symbol, l.us, l.t1, avg(1.0 / c) AS tW, abs(sum(r / c)) AS w FROM l JOIN cr ON cr.symbol = l.symbol AND cr.us BETWEEN l.us AND l.t1 GROUP BY ALL),
sw AS MATERIALIZED (SELECT symbol, us, t1, w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS w FROM tw),
td AS MATERIALIZED (SELECT symbol, us, greatest(0, 1 - 0.5 / tot * tot + 0.5 / tot * cum) AS w FROM (SELECT symbol, us, sum(tW) OVER (PARTITION BY symbol) AS tot, sum(tW) OVER (PARTITION BY symbol ORDER BY us) AS cum FROM tw))"""


def spans(s, d) -> DataFrame:
    def make():
        b = bars(s, d)
        return L.add_vertical_barrier(b.select("symbol", "us"), b, HOLDING)

    return kept(s, "spans", d, make)


for _name in ("sa1_num_co_events", "sa2_concurrency_all_bars"):
    Q[_name] = lambda s, d: (lambda b: S.num_co_events(spans(s, d), b).select("symbol", "bar_seq", F.col("c").cast("long").alias("c")))(bars(s, d))
    SQL[_name] = f"WITH {SPANS} SELECT symbol, bar_seq, c FROM co"
for _name in ("sa3_sample_tw", "sa4_avg_uniqueness"):
    Q[_name] = lambda s, d: (lambda b: rounded(S.avg_uniqueness(spans(s, d), b), "tW"))(bars(s, d))
    SQL[_name] = f"WITH {SPANS} SELECT symbol, us, t1, round(tW, 6) AS tW FROM tw"


@query("sa5_indicator", f"WITH {SPANS} SELECT l.symbol, l.us, b.bar_seq FROM l JOIN b ON b.symbol = l.symbol AND b.us BETWEEN l.us AND l.t1")
def _(s, d):
    b = bars(s, d)
    return S.indicator(spans(s, d), b)


@query("sa6_indicator_uniqueness", f"WITH {SPANS} SELECT symbol, us, round(tW, 6) AS tW FROM tw")
def _(s, d):
    b = bars(s, d)
    return rounded(S.indicator_uniqueness(S.indicator(spans(s, d), b)), "tW")


@query("sa8_seq_bootstrap")
def _(s, d):
    b = bars(s, d)
    return S.seq_bootstrap(spans(s, d), b, [1, 2])


@query("sa9_sample_w", f"WITH {SPANS} SELECT symbol, us, t1, round(w, 6) AS w FROM tw")
def _(s, d):
    b = bars(s, d)
    return rounded(S.sample_weights(spans(s, d), b, normalise=False), "w")


@query("sa10_sample_weights", f"WITH {SPANS} SELECT symbol, us, t1, round(w, 6) AS w FROM sw")
def _(s, d):
    b = bars(s, d)
    return rounded(S.sample_weights(spans(s, d), b), "w")


@query("sa11_time_decay", f"WITH {SPANS} SELECT symbol, us, round(w, 6) AS w FROM td")
def _(s, d):
    b = bars(s, d)
    return rounded(S.time_decay(S.avg_uniqueness(spans(s, d), b), 0.5), "w")


@query("sa12_combined_weights", f"WITH {SPANS}, c AS (SELECT symbol, us, sw.w * td.w AS w FROM sw JOIN td USING (symbol, us)) SELECT symbol, us, round(w * count(*) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol), 6) AS w FROM c")
def _(s, d):
    b = bars(s, d)
    l = spans(s, d)  # noqa: E741
    return rounded(S.combined_weights(S.sample_weights(l, b), S.time_decay(S.avg_uniqueness(l, b), 0.5)), "w")


# --- cross-validation ---
POS = SPANS + ", po AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n, ntile(3) OVER (PARTITION BY symbol ORDER BY us) - 1 AS fold FROM l)"


def places(s, d) -> DataFrame:
    return kept(s, "places", d, lambda: cv.positions(spans(s, d)))


@query("cv1_get_train_times", f"WITH {POS} SELECT symbol, us, t1 FROM po a WHERE NOT EXISTS (SELECT 1 FROM po x WHERE x.symbol = a.symbol AND x.fold = 1 AND a.us <= x.t1 AND a.t1 >= x.us)")
def _(s, d):
    p = places(s, d)
    tests = cv.kfold(p, 3).where("fold = 1 AND role = 'test'").select("symbol", "pos").join(p, ["symbol", "pos"])
    return cv.get_train_times(p, tests.select("symbol", F.col("us").alias("lo"), F.col("t1").alias("hi"))).select("symbol", "us", "t1")


@query("cv2_embargo_times", f"WITH {POS} SELECT a.symbol, a.us, coalesce(x.us, (SELECT max(us) FROM po z WHERE z.symbol = a.symbol)) AS embargo_us FROM po a LEFT JOIN po x ON x.symbol = a.symbol AND x.pos = a.pos + CAST(floor(a.n * 0.1) AS BIGINT)")
def _(s, d):
    return cv.get_embargo_times(places(s, d), 0.1)


PURGED = """
f AS (SELECT symbol, fold, min(us) AS lo, max(t1) AS hi, min(pos) AS a, max(pos) AS z, any_value(n) AS n FROM po GROUP BY ALL),
g AS (SELECT f.*, (SELECT count(*) FROM po WHERE po.symbol = f.symbol AND po.us < f.hi) + CAST(floor(n * {e}) AS BIGINT) AS nxt FROM f),
pu AS MATERIALIZED (SELECT p.symbol, g.fold, CASE WHEN p.pos BETWEEN g.a AND g.z THEN 'test' WHEN p.t1 <= g.lo OR p.pos >= g.nxt THEN 'train' END AS role, p.pos, p.us, p.t1, g.lo, g.hi FROM po p JOIN g ON g.symbol = p.symbol)"""


@query("cv3_purged_kfold", f"WITH {POS}, {PURGED.format(e=0.05)} SELECT symbol, CAST(fold AS INTEGER) AS fold, role, pos FROM pu WHERE role IS NOT NULL")
def _(s, d):
    return cv.purged_kfold(places(s, d), 3, 0.05)


@query("cv5_overlap_audit", f"""WITH {POS}, {PURGED.format(e=0)},
nv AS (SELECT p.symbol, f.fold, p.us, p.t1, f.lo, f.hi FROM po p JOIN f ON f.symbol = p.symbol AND p.fold <> f.fold),
al AS (SELECT 'naive' AS protocol, * FROM nv UNION ALL SELECT 'purged', symbol, fold, us, t1, lo, hi FROM pu WHERE role = 'train'),
pf AS (SELECT protocol, symbol, fold, count(*) AS n, count(*) FILTER (WHERE us < hi AND t1 > lo) AS bad FROM al GROUP BY ALL)
SELECT symbol, protocol, round(avg(n), 6) AS mean_train, CAST(sum(bad) AS BIGINT) AS contaminated, round(avg(bad / n), 6) AS pct FROM pf GROUP BY ALL""")
def _(s, d):
    a = cv.overlap_audit(places(s, d), 3, 0.05).where("protocol <> 'purged_embargo'")
    return rounded(a.withColumn("contaminated", F.col("contaminated").cast("long")), "mean_train", "pct")


@query("cv7_walk_forward", f"""WITH {POS},
q AS (SELECT *, CAST(floor(n * 0.4) AS BIGINT) AS s0 FROM po),
bl AS (SELECT symbol, ntile(3) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS fold, pos, us FROM q WHERE pos >= s0),
f AS (SELECT symbol, fold, min(pos) AS a, max(pos) AS z, min(us) AS lo FROM bl GROUP BY ALL),
o AS (SELECT q.symbol, f.fold, CASE WHEN q.pos BETWEEN a AND z THEN 'test' WHEN q.pos < a - CAST(floor(n * 0.05) AS BIGINT) AND q.t1 < lo THEN 'train' END AS role, q.pos FROM q JOIN f USING (symbol))
SELECT symbol, CAST(fold AS INTEGER) AS fold, role, pos FROM o WHERE role IS NOT NULL AND EXISTS (SELECT 1 FROM o x WHERE x.symbol = o.symbol AND x.fold = o.fold AND x.role = 'train')""")
def _(s, d):
    return cv.purged_walk_forward(places(s, d), 3, 0.05)


@query("cv9_kfold", f"WITH {POS} SELECT p.symbol, CAST(k.fold AS INTEGER) AS fold, CASE WHEN p.fold = k.fold THEN 'test' ELSE 'train' END AS role, p.pos FROM po p, (SELECT unnest([0, 1, 2]) AS fold) k")
def _(s, d):
    return cv.kfold(places(s, d), 3)


# --- sizing, backtest, statistics ---
SIG = SPANS + ", sg AS MATERIALIZED (SELECT symbol, us, t1, CAST((us // 1000000 % 21 - 10) / 10.0 AS DECIMAL(18,9)) AS signal FROM l)"
ACT = SIG + """,
pt AS (SELECT symbol, us FROM sg UNION SELECT symbol, t1 FROM sg),
ac AS MATERIALIZED (SELECT pt.symbol, pt.us, coalesce(avg(signal), 0) AS position FROM pt LEFT JOIN sg ON sg.symbol = pt.symbol AND sg.us <= pt.us AND pt.us < sg.t1 GROUP BY ALL)"""


def signals(s, d) -> tuple[DataFrame, DataFrame]:
    b = bars(s, d)
    return spans(s, d).withColumn("signal", (F.floor(F.col("us") / 1000000) % 21 - 10) / 10.0), b


for _name in ("bs2_active_signals", "bs3_avg_active_signals"):
    Q[_name] = lambda s, d: rounded(sizing.avg_active_signals(signals(s, d)[0]), "position")
    SQL[_name] = f"WITH {ACT} SELECT symbol, us, round(position, 6) AS position FROM ac"


@query("bs1_prob_to_size")
def _(s, d):
    return bars(s, d).select("symbol", "bar_seq", F.round(sizing.prob_to_size(F.col("buy_volume") / F.col("volume")), 6).alias("size"))


@query("bs4_discrete_signal", f"WITH {SIG} SELECT symbol, us, round(least(greatest(round_even(((us // 1000000 % 21 - 10) / 10.0) / 0.25, 0) * 0.25, -1), 1), 6) AS position FROM sg")
def _(s, d):
    return signals(s, d)[0].select("symbol", "us", F.round(sizing.discrete_signal(F.col("signal"), 0.25), 6).alias("position"))


@query("bs5_get_signal")
def _(s, d):
    e = signals(s, d)[0].select("symbol", "us", "t1", ((F.col("signal") + 1.2) / 2.5).alias("p"))
    return sizing.get_signal(e, step=0.05)


BT = ACT + """,
q0 AS (SELECT b.symbol, b.us, CAST(b.close AS DOUBLE) AS close, coalesce((SELECT arg_max(position, ac.us) FROM ac WHERE ac.symbol = b.symbol AND ac.us <= b.us), 0) AS position FROM b),
q1 AS MATERIALIZED (SELECT *, coalesce(lag(position) OVER w, 0) AS held, coalesce(close / lag(close) OVER w - 1, 0) AS mv FROM q0 WINDOW w AS (PARTITION BY symbol ORDER BY us)),
q2 AS MATERIALIZED (SELECT *, held * mv AS gross, 0.0003 * abs(held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY us), 0)) AS cost FROM q1),
p AS MATERIALIZED (SELECT symbol, us, position, gross, cost, gross - cost AS ret, product(1 + gross - cost) OVER (PARTITION BY symbol ORDER BY us) AS equity FROM q2),
z AS (SELECT *, lag(position) OVER w AS before, lead(us) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY symbol ORDER BY us)),
be AS MATERIALIZED (SELECT symbol, us, equity FROM z WHERE (position = 0 AND (before <> 0 OR before IS NULL)) OR position * before < 0 OR last),
bets AS MATERIALIZED (SELECT * FROM (SELECT symbol, us, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY us) - 1 AS ret FROM be) WHERE ret IS NOT NULL)"""


def path(s, d) -> DataFrame:
    def make():
        e, b = signals(s, d)
        return bt.backtest_path(sizing.avg_active_signals(e), b)

    return kept(s, "path", d, make)


@query("bt1_cost_model", f"WITH {BARS} SELECT symbol, bar_seq, round(0.0003 * (n_ticks / 10.0) + 0.0001 * sqrt(n_ticks / 10.0), 6) AS cost FROM b")
def _(s, d):
    return bars(s, d).select("symbol", "bar_seq", F.round(bt.CostModel(slippage_coef=1e-4).cost(F.col("n_ticks") / 10.0), 6).alias("cost"))


@query("bt4_run_backtest", f"WITH {BT} SELECT symbol, us, round(position, 6) AS position, round(gross, 6) AS gross, round(cost, 9) AS cost, round(equity, 6) AS equity FROM p")
def _(s, d):
    return rounded(path(s, d).select("symbol", "us", "position", "gross", F.round("cost", 9).alias("cost"), "equity"), "position", "gross", "equity")


@query("bt3_bet_returns", f"WITH {BT} SELECT symbol, us, round(ret, 6) AS ret FROM bets")
def _(s, d):
    return rounded(bt.bet_returns(path(s, d)), "ret")


@query("st1_sharpe_ratio", f"WITH {BT} SELECT symbol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM p GROUP BY symbol")
def _(s, d):
    return path(s, d).groupBy("symbol").agg(F.round(stats.sharpe_ratio(), 6).alias("sharpe"))


@query("st2_moments", f"WITH {BT} SELECT symbol, count(*) AS n, round(skewness(ret), 4) AS g1, round(kurtosis(ret), 4) AS g2 FROM p GROUP BY symbol")
def _(s, d):
    m = stats.moments(path(s, d))
    return m.select("symbol", "n", F.round("g1", 4).alias("g1"), F.round("g2", 4).alias("g2"))


@query("st2_probabilistic_sharpe")
def _(s, d):
    return stats.probabilistic_sharpe(path(s, d))


@query("st3_expected_max_sharpe")
def _(s, d):
    return s.createDataFrame([(n, stats.expected_max_sharpe(n, 0.12217)) for n in (1, 2, 12)], "n_trials int, value double")


@query("st4_deflated_sharpe")
def _(s, d):
    return stats.deflated_sharpe(path(s, d), 12, 0.12217)


@query("st5_drawdowns", f"""WITH {BT}, w AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY us) AS hwm FROM p),
g AS (SELECT symbol, hwm, min(equity) AS low, min(us) AS us FROM w GROUP BY symbol, hwm HAVING hwm > min(equity))
SELECT symbol, us, round(1 - low / hwm, 6) AS drawdown, coalesce(lead(us) OVER (PARTITION BY symbol ORDER BY us), (SELECT max(us) FROM p WHERE p.symbol = g.symbol)) AS until_us FROM g""")
def _(s, d):
    return rounded(stats.drawdowns(path(s, d)), "drawdown")


@query("st6_bet_timing", f"WITH {BT} SELECT symbol, us FROM be")
def _(s, d):
    return stats.bet_timing(path(s, d)).select("symbol", "us")


@query("st7_holding_period")
def _(s, d):
    return stats.holding_period(path(s, d))


@query("st8_hhi", f"WITH {BT} SELECT symbol, round((sum(ret * ret) / pow(sum(ret), 2) - 1.0 / count(*)) / (1 - 1.0 / count(*)), 4) AS hhi FROM bets GROUP BY symbol HAVING count(*) > 2")
def _(s, d):
    return stats.hhi(bt.bet_returns(path(s, d))).where("hhi IS NOT NULL").select("symbol", F.round("hhi", 4).alias("hhi"))


@query("st9_implied_precision", """WITH v(sl, pt, n, t) AS (VALUES (-0.01, 0.01, 250.0, 1.0), (-0.02, 0.03, 50.0, 2.0)),
c AS (SELECT *, (n + t * t) * pow(pt - sl, 2) AS a, (2 * n * sl - t * t * (pt - sl)) * (pt - sl) AS b, n * sl * sl AS c FROM v)
SELECT CAST(sl AS DOUBLE) AS sl, CAST(pt AS DOUBLE) AS pt, round((-b + sqrt(b * b - 4 * a * c)) / (2 * a), 6) AS p FROM c""")
def _(s, d):
    return s.createDataFrame([(a, b, round(sizing.implied_precision(a, b, n, t), 6)) for a, b, n, t in ((-0.01, 0.01, 250, 1), (-0.02, 0.03, 50, 2))], "sl double, pt double, p double")


@query("st10_win_loss", f"WITH {BT} SELECT symbol, count(*) AS n, round(avg(ret) FILTER (WHERE ret > 0), 6) AS win, round(avg(ret) FILTER (WHERE ret <= 0), 6) AS loss, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) AS precision FROM bets GROUP BY symbol")
def _(s, d):
    return rounded(stats.win_loss(bt.bet_returns(path(s, d))), "win", "loss", "precision")


@query("st10_prob_failure")
def _(s, d):
    return stats.prob_failure(bt.bet_returns(path(s, d)), 100.0, 1.0)


@query("st11_performance_summary")
def _(s, d):
    e, b = signals(s, d)
    return bt.run_backtest(sizing.avg_active_signals(e), b, n_trials=12, var_trials=0.12).summary


@query("st12_quantiles", f"WITH {BARS} SELECT symbol, median(volume) AS median, round(quantile_cont(volume, 0.9), 6) AS q90, round(avg(volume), 6) AS mean FROM b GROUP BY symbol")
def _(s, d):
    return bars(s, d).groupBy("symbol").agg(F.median("volume").alias("median"), F.round(F.percentile("volume", 0.9), 6).alias("q90"), F.round(F.avg("volume"), 6).alias("mean"))


# --- simulator, jobs, models ---
@query("src2_simulate_ticks")
def _(s, d):
    return src.simulate(s, {f"seed{k}": src.TickSimConfig(n_ticks=2000, seed=k) for k in (1, 2)})


@query("mp5_map_atoms", f"WITH {T} SELECT symbol, seq, price * price + 1 AS value FROM t")
def _(s, d):
    t = tape(s, d).select("symbol", "seq", "price")
    return jobs.map_atoms(t, lambda p: p.assign(value=p["price"] * p["price"] + 1)[["symbol", "seq", "value"]], "symbol string, seq long, value long", 8, "seq")


@query("mp4_process_jobs")
def _(s, d):
    return jobs.process_jobs(s, [{"a": k} for k in range(5)], lambda a: pd.DataFrame({"x": np.arange(a + 1)}), "x long")


#: Features of the models; those that standardise over 250 bars leave no rows in small tables.
MODEL_FEATURES = ["vol_50", "vol_ratio", "mom_5", "mom_20", "autocorr_50", "ofi", "ofi_5", "ofi_20", "buy_ratio_20", "log_duration", "log_n_ticks"]


def learned(s, d) -> tuple[DataFrame, list[str], DataFrame]:
    """(features and labels with every bar as an event, feature names, purged folds); bars without a label or a feature are left out."""

    # each step is written: as one plan they take more than the driver's memory
    b = bars(s, d)
    spans_ = kept(s, "learned_spans", d, lambda: L.add_vertical_barrier(b.select("symbol", "us"), b, HOLDING))
    e = kept(s, "learned_events", d, lambda: L.get_events(b, spans_, (1.0, 1.0), target(s, d), 0.01))
    labels = kept(s, "learned_labels", d, lambda: L.get_bins(e, b).select("symbol", "us", "t1", F.when(F.col("bin") > 0, 1).otherwise(0).alias("y")))
    weights = kept(s, "learned_weights", d, lambda: S.avg_uniqueness(labels.select("symbol", "us", "t1"), b).select("symbol", "us", F.col("tW").alias("weight")))
    features = kept(s, "learned_features", d, lambda: fe.build_features(b, drop=False).select("symbol", "us", *MODEL_FEATURES).dropna())
    rows = kept(s, "learned_rows", d, lambda: labels.join(weights, ["symbol", "us"]).join(features, ["symbol", "us"]))
    data = kept(s, "learned", d, lambda: cv.positions(rows))
    return data, MODEL_FEATURES, kept(s, "learned_folds", d, lambda: cv.purged_kfold(data.select("symbol", "us", "t1", "pos"), 2, 0.05))


@query("cv4_cv_score")
def _(s, d):
    data, names, split = learned(s, d)
    return s.createDataFrame([(k, float(v)) for k, v in enumerate(cv.cv_score(cv.make_classifier(1, 5), data, names, split))], "fold int, score double")


@query("cv8_oof_predict_proba")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "symbol string, pos long, p double")
    return cv.oof_predict_proba(cv.make_classifier(1, 5), data, names, split)


@query("cv6_compare_cv")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "protocol string, mean double, std double, min double, max double")
    got = cv.compare_cv(cv.make_classifier(1, 5), data, names, data.select("symbol", "us", "t1", "pos"), 2, 0.05)
    return s.createDataFrame([(k, *(float(v[c]) for c in ("mean", "std", "min", "max"))) for k, v in got.items()], "protocol string, mean double, std double, min double, max double")


def table_of(s, table: pd.DataFrame) -> DataFrame:
    """A driver-side table with a row for each feature."""
    kinds = ", ".join(f"{c} double" for c in table.columns)
    return s.createDataFrame([(str(k), *map(float, row)) for k, row in zip(table.index, table.to_numpy(), strict=True)], f"feature string, {kinds}")


@query("im1_feat_imp_mdi")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "feature string, mean double, std double")
    model = cv.make_classifier(1, 5).fit(cv.balanced(cv.assembled(data, names)))
    return table_of(s, importance.feat_imp_mdi(model, names))


@query("im3_feat_imp_sfi")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "feature string, mean double, std double")
    return table_of(s, importance.feat_imp_sfi(cv.make_classifier(1, 5), data, names[:4], split))


@query("im7_feature_importance_report")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "feature string, mdi double, mda double, mda_std double, sfi double")
    return table_of(s, importance.feature_importance_report(cv.make_classifier(1, 5), data, names[:4], split, seed=1))


@query("im2_feat_imp_mda")
def _(s, d):
    data, names, split = learned(s, d)
    if split.isEmpty():
        return s.createDataFrame([], "feature string, mean double, std double")
    table, _ = importance.feat_imp_mda(cv.make_classifier(1, 5), data, names, split)
    return s.createDataFrame(table.reset_index(names="feature"))


@query("im5_ortho_features")
def _(s, d):
    data, names, _ = learned(s, d)
    return data if data.isEmpty() else importance.ortho_features(data, names)
