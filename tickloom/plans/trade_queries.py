"""Registered queries on pairs, portfolios, rule sets and streams. Those without SQL are recursive, iterative or fitted."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import rolling as R
from ..operators import align, copulas, evaluate, gram, ml, pairs, portfolio, recursive
from ..sources.shared import new_folder
from ..streaming import jobs
from .sql import HOURLY, LEDGER, PAIRS, lag, over, roll, rounded, select

QUERIES, ORACLES = {}, {}


def query(text=None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


def _pb(s, d):
    return align.pair_bars(schema.bars(s, d))


P = "sym1, sym2"
PT = "sym1, sym2, ts"


@query(select(PAIRS, "pb", "sym1, sym2, count(*) AS n", where="GROUP BY sym1, sym2", beta_origin="sum(close1 * close2) / nullif(sum(close2 * close2), 0)", beta_ols="regr_slope(close1, close2)"))
def t01_t02_hedge_ratios(s, d):
    return rounded(pairs.hedge_ratios(_pb(s, d)))


_RB = f"(CASE WHEN count(close2) {over(72, P)} = 72 THEN sum(close1 * close2) {over(72, P)} / nullif(sum(close2 * close2) {over(72, P)}, 0) END)"
_SP = PAIRS + f", sp AS (SELECT *, {_RB} AS beta FROM pb), sq AS (SELECT *, CASE WHEN close1 > 0 AND close2 > 0 THEN ln(close1) - ln(close2) END AS ls, close1 / nullif(close2, 0) AS pq FROM sp)"


@query(select(_SP, "sq", PT, 4, diff="close1 - close2", beta_spread="close1 - beta * close2", log_spread="ls", price_ratio="pq", spread_vol=roll("stddev_samp", "ls", 20, P), ratio_z=f"(pq - {roll('avg', 'pq', 20, P)}) / nullif({roll('stddev_samp', 'pq', 20, P)}, 0)"))
def t03_spreads(s, d):
    x = _pb(s, d).withColumn("beta", pairs.hedge_origin(72))
    x = x.withColumns(pairs.spreads())
    return rounded(pairs.spread_zscores(x).select("sym1", "sym2", "ts", "diff", "beta_spread", "log_spread", "price_ratio", "spread_vol", "ratio_z"), 4)


_B4 = f"(CASE WHEN count(close2) {over(72, P, -1)} = 72 THEN sum(close1 * close2) {over(72, P, -1)} / nullif(sum(close2 * close2) {over(72, P, -1)}, 0) END)"
_T4 = PAIRS + f", b4 AS (SELECT *, {_B4} AS beta, {lag('close1', 1, P)} AS l1, {lag('close2', 1, P)} AS l2 FROM pb), s4 AS (SELECT *, l1 - beta * l2 AS spread FROM b4)"


@query(select(_T4, "s4", PT, 4, beta="beta", spread="spread", z=f"(spread - {roll('avg', 'spread', 72, P)}) / nullif({roll('stddev_pop', 'spread', 72, P)}, 0)"))
def t04_rolling_beta_zscore(s, d):
    return rounded(pairs.rolling_beta_zscore(_pb(s, d)).select("sym1", "sym2", "ts", "beta", "spread", "z"), 4)


_W60 = over(60, P)
_T5 = PAIRS + f", c5 AS (SELECT *, CASE WHEN count(CASE WHEN ret1 IS NOT NULL AND ret2 IS NOT NULL THEN 1 END) {_W60} = 60 THEN corr(ret1, ret2) {_W60} END AS c, close1 / nullif(close2, 0) AS pq, CASE WHEN close1 > 0 AND close2 > 0 THEN ln(close1) - ln(close2) END AS ls FROM pr), z5 AS (SELECT *, (pq - {roll('avg', 'pq', 60, P)}) / nullif({roll('stddev_samp', 'pq', 60, P)}, 0) AS z FROM c5)"


@query(select(_T5, "z5", "sym1, sym2, count(*) AS n", 4, where="GROUP BY sym1, sym2 HAVING avg(c) >= -1 AND count(*) >= 100", mean_corr="avg(c)", spread_vol="stddev_samp(ls)", z_mean="avg(z)", z_std="stddev_samp(z)"))
def t05_pair_screen(s, d):
    return rounded(pairs.screen(_pb(s, d), 60, -1.0, 100), 4)


_T5G = _T5 + """, own AS (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r FROM bars),
cd AS (SELECT a.symbol AS sym1, b.symbol AS sym2 FROM own a JOIN own b ON a.ts = b.ts AND a.symbol < b.symbol AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING corr(a.r, b.r) >= 0)"""


@query(select(_T5G, "z5 JOIN cd USING (sym1, sym2)", "sym1, sym2, count(*) AS n", 4, where="GROUP BY sym1, sym2 HAVING avg(c) >= -1 AND count(*) >= 100", mean_corr="avg(c)", spread_vol="stddev_samp(ls)", z_mean="avg(z)", z_std="stddev_samp(z)"))
def t05_screen_candidates(s, d):
    """Pairs are made only for what the matrix of whole-sample correlations lets through."""
    b = schema.bars(s, d)
    few = gram.candidates(b.withColumn("ret", R.ret()), 0.0)
    return rounded(pairs.screen(align.pair_bars(b, few), 60, -1.0, 100), 4)


@query()
def t06_unit_root_windows(s, d):
    x = align.formation_windows(_pb(s, d), 5).withColumn("spread", F.col("close1") - F.col("close2"))
    return rounded(pairs.adf_tests(x, ["sym1", "sym2", "win_start"]))


@query()
def t07_cointegration(s, d):
    return rounded(pairs.cointegration(_pb(s, d)).orderBy("p"))


_Z8 = f"(pq - {roll('avg', 'pq', 20, P)}) / nullif({roll('stddev_samp', 'pq', 20, P)}, 0)"


@query(f"WITH {_SP}, z8 AS (SELECT *, {_Z8} AS z, {roll('stddev_samp', 'ls', 20, P)} AS v, {roll('stddev_samp', 'ls', 60, P)} AS w FROM sq), k8 AS (SELECT *, greatest(least(coalesce(v / nullif(w, 0), 1), 2), 0.5) AS k FROM z8) SELECT {PT}, CASE WHEN z IS NULL THEN NULL WHEN abs(z) >= 4 THEN 'stop' WHEN z >= 2 THEN 'short' WHEN z <= -2 THEN 'long' WHEN abs(z) <= 0.5 THEN 'close' ELSE 'hold' END AS signal, round(2 * k, 5) + 0.0::DOUBLE AS enter_at, round(0.5 * k, 5) + 0.0::DOUBLE AS leave_at, round(1000 * greatest(least(coalesce(0.02 / nullif(v, 0), 0) * 0.5 * least(abs(z) / 2, 1), 0.1), 0.01), 4) + 0.0::DOUBLE AS size FROM k8")
def t08_t10_signals_sizes(s, d):
    x = _pb(s, d).withColumn("beta", F.lit(1.0)).withColumns(pairs.spreads())
    x = x.withColumns({"z": R.zscore("price_ratio", 20, key=pairs.PAIR), "v": R.std("log_spread", 20, key=pairs.PAIR), "w": R.std("log_spread", 60, key=pairs.PAIR)})
    t = pairs.dynamic_thresholds(F.col("v"), F.col("w"))
    size = F.when(F.col("z").isNotNull(), pairs.pair_size(1000.0, F.col("z"), F.lit(0.5), F.col("v"))).otherwise(pairs.pair_size(1000.0, F.lit(None).cast("double"), F.lit(0.5), F.col("v")))
    return x.select("sym1", "sym2", "ts", pairs.zscore_signal(F.col("z")).alias("signal"), (F.round(t["enter_at"], 5) + 0.0).alias("enter_at"), (F.round(t["leave_at"], 5) + 0.0).alias("leave_at"), (F.round(size, 4) + 0.0).alias("size"))


def _signals(s, d):
    return pairs.rolling_beta_zscore(_pb(s, d), 24).withColumn("p", F.lit(0.01))


_B9 = f"(CASE WHEN count(close2) {over(24, P, -1)} = 24 THEN sum(close1 * close2) {over(24, P, -1)} / nullif(sum(close2 * close2) {over(24, P, -1)}, 0) END)"
_T9 = "RECURSIVE " + PAIRS + f", b9 AS (SELECT *, {_B9} AS beta, {lag('close1', 1, P)} AS l1, {lag('close2', 1, P)} AS l2, row_number() OVER (PARTITION BY sym1, sym2 ORDER BY ts) AS i FROM pb), s9 AS (SELECT *, l1 - beta * l2 AS spread FROM b9), z9 AS MATERIALIZED (SELECT sym1, sym2, ts, i, (spread - {roll('avg', 'spread', 24, P)}) / nullif({roll('stddev_pop', 'spread', 24, P)}, 0) AS z FROM s9)"
_H9 = "CASE WHEN {was} <> 0 AND (b.z IS NULL OR {was} > 0 AND b.z >= 0 OR {was} < 0 AND b.z <= 0) THEN 0 WHEN {was} <> 0 THEN {was} WHEN abs(b.z) >= 2 THEN CASE WHEN b.z > 0 THEN -1 ELSE 1 END ELSE 0 END"


@query(f"WITH {_T9}, h AS (SELECT sym1, sym2, i, {_H9.format(was='0')} AS position FROM z9 b WHERE i = 1 UNION ALL SELECT b.sym1, b.sym2, b.i, {_H9.format(was='h.position')} FROM h JOIN z9 b ON b.sym1 = h.sym1 AND b.sym2 = h.sym2 AND b.i = h.i + 1) SELECT sym1, sym2, ts, round(z, 6) + 0.0::DOUBLE AS z, position::DOUBLE AS position FROM z9 JOIN h USING (sym1, sym2, i)")
def t09_held_positions(s, d):
    return rounded(pairs.held_signal(_signals(s, d)).select("sym1", "sym2", "ts", "z", "position"))


def _log_ret(s, d):
    return schema.bars(s, d).select("symbol", "ts", R.log_ret().alias("ret")).where("ret is not null")


@query()
def t11_marginals(s, d):
    return rounded(pairs.fit_marginals(_log_ret(s, d)))


def _uniform(s, d):
    r = _log_ret(s, d)
    x = align.pair_bars(r.withColumnRenamed("ret", "close")).withColumnsRenamed({"close1": "ret1", "close2": "ret2"})
    return pairs.to_uniform(x, pairs.fit_marginals(r))


@query()
def t12_t13_t15_copulas(s, d):
    return rounded(pairs.fit_copulas(_uniform(s, d)))


@query()
def t14_t16_t17_mispricing(s, d):
    x = _uniform(s, d)
    theta, psi = F.lit(2.0), F.lit(0.6)
    h1, h2 = pairs.mispricing(F.col("u1"), F.col("u2"), theta, psi)
    x = x.select("sym1", "sym2", "ts", "u1", "u2", h1.alias("h1"), h2.alias("h2"), pairs.gaussian_conditional(F.col("u1"), F.col("u2"), F.lit(0.3)).alias("gauss"), pairs.t_conditional(0.3, 5.0)("u1", "u2").alias("t"))
    return rounded(x.select("*", pairs.copula_signal(F.col("h1"), F.col("h2")).alias("signal"), pairs.copula_exit(F.col("h1"), F.col("h2")).alias("leave")))


_LR = HOURLY + ", lr AS (SELECT symbol, ts, ln(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS r FROM bars), lp AS (SELECT a.symbol AS sym1, b.symbol AS sym2, a.ts, a.r AS x, b.r AS y FROM lr a JOIN lr b ON a.ts = b.ts AND a.symbol < b.symbol AND a.r IS NOT NULL AND b.r IS NOT NULL), ct AS (SELECT a.sym1, a.sym2, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny FROM lp a JOIN lp b ON a.sym1 = b.sym1 AND a.sym2 = b.sym2 AND a.ts < b.ts GROUP BY ALL)"


@query(f"WITH {_LR} SELECT sym1, sym2, (SELECT count(*) FROM lp WHERE lp.sym1 = ct.sym1 AND lp.sym2 = ct.sym2) AS n, round(s / sqrt(nx::DOUBLE * ny), 6) + 0.0::DOUBLE AS tau, round(sin(pi() * s / sqrt(nx::DOUBLE * ny) / 2), 6) + 0.0::DOUBLE AS rho FROM ct")
def t16_rank_correlation(s, d):
    """Kendall's tau and the copulas' correlation; a distribution function keeps the order, so returns give the same as uniform values."""
    r = _log_ret(s, d)
    x = align.pair_bars(r.withColumnRenamed("ret", "close")).withColumnsRenamed({"close1": "u1", "close2": "u2"})
    return rounded(copulas.fit_elliptical(x).select("sym1", "sym2", "n", "tau", "rho"))


@query()
def t14_t16_t17_fitted(s, d):
    """The indices under each pair's own fits, and what they say."""
    x = copulas.fitted_mispricing(_uniform(s, d))
    return rounded(x.select("*", pairs.copula_signal(F.col("h1"), F.col("h2")).alias("signal"), pairs.copula_exit(F.col("h1"), F.col("h2")).alias("leave")))


@query(select(PAIRS + ", lg AS (SELECT sym1 AS symbol, close1 AS price, CASE WHEN close1 > close2 THEN -1 ELSE 1 END * floor(1000 / nullif(close1 + 0.5 * close2, 0)) AS qty FROM pb UNION ALL SELECT sym2, close2, -CASE WHEN close1 > close2 THEN -1 ELSE 1 END * floor(floor(1000 / nullif(close1 + 0.5 * close2, 0)) * 0.5) FROM pb), nt AS (SELECT symbol, sum(qty) AS qty, max(price) AS price FROM lg GROUP BY symbol)", "nt", "symbol", 4, where="WHERE qty <> 0", qty="qty", price="price", commission="abs(qty * price) * 0.0004"))
def t18_quantities_netting(s, d):
    side = F.when(F.col("close1") > F.col("close2"), -1.0).otherwise(1.0)
    x = _pb(s, d).withColumns({"beta": F.lit(0.5), "side": side}).withColumnsRenamed({"close1": "price1", "close2": "price2"})
    x = portfolio.leg_quantities(x, 1000.0)
    legs = x.select(F.inline(F.array(F.struct(F.col("sym1").alias("symbol"), F.col("price1").alias("price"), F.col("qty1").cast("double").alias("qty")), F.struct(F.col("sym2").alias("symbol"), F.col("price2").alias("price"), F.col("qty2").cast("double").alias("qty")))))
    return rounded(portfolio.net_orders(legs), 4)


@query()
def t19_k05_frontier(s, d):
    r = schema.bars(s, d).select("symbol", "ts", ((F.col("close") - 50) / 1000).alias("ret"))
    r = r.where(F.col("symbol").isin("click", "error", "login", "purchase", "view"))  # the stated assets: what is collected is 5 means and 15 covariances
    m = r.groupBy("symbol").agg(F.avg("ret").alias("m")).orderBy("symbol").collect()
    at = {x["symbol"]: i for i, x in enumerate(m)}
    cov = [[0.0] * len(m) for _ in m]
    c = align.pair_bars(r.withColumnRenamed("ret", "close"), same=True).groupBy("sym1", "sym2").agg(F.covar_samp("close1", "close2").alias("c"))
    for x in c.collect():
        cov[at[x["sym1"]]][at[x["sym2"]]] = cov[at[x["sym2"]]][at[x["sym1"]]] = x["c"]
    f = portfolio.frontier(s, [x["m"] * 252 for x in m], [[v * 252 for v in row] for row in cov])
    return rounded(portfolio.best_rows(f).select("id", "ret", "vol", "sharpe", "pick"))


_T19 = HOURLY + ", q AS (SELECT symbol, ts, (close - 50) / 1000 AS r FROM bars WHERE symbol IN ('click', 'error', 'login', 'purchase', 'view')), c AS (SELECT a.symbol AS sym1, b.symbol AS sym2, covar_samp(a.r, b.r) * 252 AS cov FROM q a JOIN q b ON a.ts = b.ts GROUP BY ALL), m AS (SELECT symbol, avg(r) * 252 AS mean FROM q GROUP BY symbol)"


@query(f"WITH {_T19} SELECT list(symbol ORDER BY symbol) AS symbols, (SELECT list(round(mean, 6) ORDER BY symbol) FROM m) AS mean, (SELECT list(round(cov, 6) ORDER BY sym1, sym2) FROM c) AS cov FROM m")
def t19_asset_moments(s, d):
    x = portfolio.asset_moments(_stated(s, d), exact="exact")
    return x.select("symbols", *(F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("mean", "cov")))


@query()
def t19_k05_frontier_of_moments(s, d):
    """The frontier from the one row of moments, without anything on the driver."""
    f = portfolio.frontier_of(portfolio.asset_moments(_stated(s, d), exact="exact"))
    return rounded(portfolio.best_rows(f).select("id", "ret", "vol", "sharpe", "pick"))


def _stated(s, d):
    exact = (F.col("close").try_cast("decimal(26, 16)") - 50) * F.expr("0.001BD")  # 50 and doubles leave a rest of rounding
    r = schema.bars(s, d).select("symbol", "ts", ((F.col("close") - 50) / 1000).alias("ret"), exact.alias("exact"))
    return r.where(F.col("symbol").isin("click", "error", "login", "purchase", "view"))


_WT = HOURLY + ", w1 AS (SELECT symbol, ts, close / sum(close) OVER (PARTITION BY ts) AS weight, volume, open / nullif(sum(open) OVER (PARTITION BY ts), 0) AS old_weight FROM bars), s1 AS (SELECT *, greatest(least(weight * 1.2, 0.3), 0) AS w FROM w1), n1 AS (SELECT *, coalesce(w / nullif(sum(w) OVER (PARTITION BY ts), 0), 1.0 / count(*) OVER (PARTITION BY ts)) AS nw FROM s1), f1 AS (SELECT *, abs(nw - old_weight) >= 0.02 AND abs(nw - old_weight) * 5000 >= 10 AS trade FROM n1)"


def _weights(s, d):
    w = Window.partitionBy("ts")
    x = schema.bars(s, d).where("close >= 0")
    return x.select("symbol", "ts", (F.col("close") / F.nullif(F.sum("close").over(w), F.lit(0.0))).alias("weight"), (F.col("open") / F.nullif(F.sum("open").over(w), F.lit(0.0))).alias("old_weight"))


@query(f"WITH {_WT} SELECT symbol, ts, round(nw, 6) + 0.0::DOUBLE AS weight, trade, round(CASE WHEN trade THEN coalesce(nw * greatest(1 - sum(CASE WHEN NOT trade THEN old_weight ELSE 0 END) OVER (PARTITION BY ts), 0) / nullif(sum(CASE WHEN trade THEN nw ELSE 0 END) OVER (PARTITION BY ts), 0), 0) ELSE old_weight END, 6) + 0.0::DOUBLE AS new_weight FROM f1")
def t21_t22_weights_trades(s, d):
    x = portfolio.shape_weights(_weights(s, d).withColumn("scale", F.lit(1.2)), 0.3)
    x = portfolio.filter_trades(x.withColumn("equity", F.lit(5000.0)), 0.02, 10.0)
    return rounded(x.select("symbol", "ts", "weight", "trade", "new_weight"))


@query(select(HOURLY + ", x AS (SELECT symbol, ts, open AS value, close AS target, 5.0::DOUBLE AS cash, close - open AS delta FROM bars), y AS (SELECT *, least(1, coalesce(greatest(cash - sum(least(delta, 0)) OVER (PARTITION BY ts), 0) / nullif(sum(greatest(delta, 0)) OVER (PARTITION BY ts), 0), 1)) AS k FROM x)", "y", "symbol, ts", 3, order_value="CASE WHEN delta > 0 THEN delta * k ELSE delta END", fill="value * (1 + sign(delta) * 0.1 * pow(least(coalesce(abs(delta) / nullif(value, 0), 0.025), 0.025), 2))", fee="least(greatest(abs(delta) * 0.001, 1), 50)"))
def t23_t24_orders_costs(s, d):
    x = schema.bars(s, d).select("symbol", "ts", F.col("open").alias("value"), F.col("close").alias("target"), F.lit(5.0).alias("cash"))
    x = portfolio.rebalance_orders(x, ["ts"])
    return rounded(x.select("symbol", "ts", "order_value", portfolio.slippage(F.col("delta"), F.col("value"), F.col("value")).alias("fill"), portfolio.commission(F.col("delta")).alias("fee")), 3)


@query(f"WITH {HOURLY}, g AS (SELECT ts, max(abs(w - 0.2)) AS drift FROM (SELECT ts, close / nullif(sum(close) OVER (PARTITION BY ts), 0) AS w FROM bars) GROUP BY ts) SELECT ts, round(drift, 6) + 0.0::DOUBLE AS drift, drift > 0.3::DOUBLE AS by_threshold, (row_number() OVER (ORDER BY ts) - 1) % 20 = 0 AS by_period FROM g")
def t25_rebalance_flags(s, d):
    x = _weights(s, d).withColumns({"portfolio": F.lit("a"), "target_weight": F.lit(0.2)})
    return rounded(portfolio.rebalance_flags(x, 0.3).drop("portfolio"))


@query()
def t20_minimum_variance(s, d):
    r = schema.bars(s, d).select("symbol", "ts", F.col("close").alias("close"))
    cov = align.pair_bars(r, same=True).groupBy("sym1", "sym2").agg(F.covar_samp("close1", "close2").alias("cov"))
    return rounded(portfolio.minimum_variance(cov.withColumn("book", F.lit("all"))))


@query()
def t26_hidden_regimes(s, d):
    return rounded(pairs.regimes(_log_ret(s, d), 3).groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")))


@query(select(HOURLY + ", x AS (SELECT symbol, ts, close AS rsi, 0.5 + n / 10.0 AS beta FROM bars), q AS (SELECT *, CASE WHEN rsi < 30 THEN 30 - rsi WHEN rsi > 70 THEN 70 - rsi ELSE 0 END AS q FROM x), b AS (SELECT *, sum(CASE WHEN q > 0 THEN q * beta ELSE 0 END) OVER (PARTITION BY ts) AS bl, sum(CASE WHEN q < 0 THEN q * beta ELSE 0 END) OVER (PARTITION BY ts) AS bs FROM q), k AS (SELECT *, CASE WHEN q > 0 THEN q * coalesce(greatest(-bs / nullif(bl, 0), 0), 0) ELSE q END AS v FROM b)", "k", "symbol, ts", 5, weight="coalesce(v / nullif(sum(abs(v)) OVER (PARTITION BY ts), 0), 0)"))
def t27_beta_neutral(s, d):
    x = schema.bars(s, d).select("symbol", "ts", F.col("close").alias("rsi"), (0.5 + F.col("n") / 10.0).alias("beta"))
    return rounded(portfolio.beta_neutral(x).select("symbol", "ts", "weight"), 5)


_Z28 = [f"(close{i} - {roll('avg', f'close{i}', 60, P)}) / nullif({roll('stddev_samp', f'close{i}', 60, P)}, 0)" for i in "12"]


@query(select(PAIRS + f", k AS (SELECT *, {_Z28[0]} AS z1, {_Z28[1]} AS z2, greatest(least({roll('stddev_samp', 'close1', 60, P)} / nullif({roll('stddev_samp', 'close2', 60, P)}, 0), 4), 0) AS kappa FROM pb)", "k", PT, 4, kappa="CASE WHEN z1 IS NOT NULL THEN kappa END", kappa_spread="z1 - kappa * z2"))
def t28_kappa_spread(s, d):
    x = pairs.kappa_spread(_pb(s, d))
    return rounded(x.select("sym1", "sym2", "ts", F.when(F.col("z1").isNotNull(), F.col("kappa")).alias("kappa"), "kappa_spread"), 4)


_G29 = PAIRS + ", g AS (SELECT *, (close1 - close2) / 25 AS z, CASE WHEN close1 > close2 THEN -1 ELSE 1 END AS signal FROM pb), o AS (SELECT *, 1 - abs(z) / 4 AS confidence FROM g WHERE abs(z) < 4)"


@query(f"WITH {_G29} SELECT {PT}, 1 AS leg, sym1 AS symbol, round(confidence, 6) AS confidence, signal::DOUBLE AS side FROM o WHERE confidence >= 0.3 UNION ALL SELECT {PT}, 2, sym2, round(confidence, 6), -signal * 0.5::DOUBLE FROM o WHERE confidence >= 0.3")
def t29_gated_orders(s, d):
    x = _pb(s, d).withColumns({"z": (F.col("close1") - F.col("close2")) / 25, "signal": F.when(F.col("close1") > F.col("close2"), -1).otherwise(1), "p": F.lit(0.01), "vol1": F.lit(0.05), "vol2": F.lit(0.05), "beta": F.lit(0.5)})
    return rounded(pairs.gated_orders(x))


_E1 = HOURLY + ", ev AS (SELECT *, CASE WHEN close > 80 THEN 1 WHEN close < 20 THEN 0 END AS e FROM bars), po AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS position FROM ev)"


def _positions(s, d):
    return schema.bars(s, d).withColumn("position", evaluate.position(F.col("close") > 80, F.col("close") < 20))


@query(
    f"WITH {_E1}, h AS (SELECT *, coalesce({lag('position')}, 0) AS held FROM po), w AS (SELECT *, coalesce({lag('held')}, 0) AS was FROM h), x AS (SELECT *, last_value(CASE WHEN held = 1 AND was = 0 THEN open END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ep FROM w), y AS (SELECT *, CASE WHEN held = 0 AND was = 1 THEN open - ep ELSE 0 END AS tp FROM x), z AS (SELECT *, 10000 + sum(tp) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ce FROM y) "
    "SELECT symbol, ts, position, held, held = 1 AND was = 0 AS entry, held = 0 AND was = 1 AS \"exit\", ep AS entry_price, round(ce, 4) AS closed_equity, round(ce + CASE WHEN held = 1 THEN close - ep ELSE 0 END, 4) AS open_equity FROM z"
)
def e01_e02_system(s, d):
    x = evaluate.apply_system(_positions(s, d))
    return rounded(x.select("symbol", "ts", "position", "held", "entry", "exit", "entry_price", "closed_equity", "open_equity"), 4)


@query()
def e03_bracket_run(s, d):
    x = schema.bars(s, d).withColumn("signal", F.when(F.col("close") > 90, 1.0).when(F.col("close") < 10, -1.0).otherwise(0.0))
    return rounded(evaluate.bracket_run(x, 0.2, 0.1).select("symbol", "ts", "qty", "pnl"), 4)


@query(f"WITH {HOURLY}, a AS (SELECT *, CASE WHEN close < 5 THEN 'BUY' WHEN close > 60 THEN 'SELL' END AS action FROM bars), f AS (SELECT symbol, ts, close, action FROM a WHERE action IS NOT NULL AND close > 0), g AS (SELECT * FROM f QUALIFY lag(action) OVER (PARTITION BY symbol ORDER BY ts) IS DISTINCT FROM action), n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM g), e AS (SELECT symbol, arg_max(close, ts) AS e FROM bars GROUP BY symbol) SELECT e.symbol, round(sum(CASE WHEN action = 'BUY' THEN ln(coalesce(nx, e) / close) ELSE 0 END), 5) AS log_growth, count(CASE WHEN action = 'BUY' THEN 1 END) AS n_buys FROM e LEFT JOIN n USING (symbol) GROUP BY e.symbol")
def e04_wallet(s, d):
    x = schema.bars(s, d).withColumn("action", F.when(F.col("close") < 5, "BUY").when(F.col("close") > 60, "SELL"))
    w = evaluate.wallet(x, 1.0)
    return w.select("symbol", F.round(F.ln("balance"), 5).alias("log_growth"), "n_buys")


@query()
def e05_k04_sweep(s, d):
    grid = s.createDataFrame([(a, b, r) for a in (5, 10, 15, 20, 25, 30, 35) for b in (40, 50, 60, 70, 80, 90, 100, 110) for r in range(10, 21)], "short int, long int, rsi int")
    return rounded(portfolio.best_parameters(evaluate.sweep(schema.bars(s, d), grid), ["short", "long", "rsi"]), 4)


@query(select(HOURLY + ", g AS (SELECT symbol, arg_max(close, ts) / nullif(arg_min(close, ts), 0) AS h, date_diff('second', min(ts), max(ts)) / 3600.0 AS hours FROM bars GROUP BY symbol), y AS (SELECT *, 8760 / hours AS y FROM g)", "y", "symbol", 4, run_log="ln(pow(1.1::DOUBLE, y))", hold_log="CASE WHEN abs(y * ln(h)) < 20 THEN y * ln(h) END"))
def e06_premium(s, d):
    b = schema.bars(s, d)
    x = portfolio.premium(b, b.select("symbol").distinct().withColumn("balance", F.lit(1100.0)), 1000.0)
    return rounded(x.select("symbol", F.ln(F.col("run_year") + 1).alias("run_log"), F.when(F.abs(F.ln(F.col("hold_year") + 1)) < 20, F.ln(F.col("hold_year") + 1)).alias("hold_log")), 4)


@query(select(HOURLY + ", f AS (SELECT symbol, 0.2 * 1000 / nullif(arg_min(close, ts), 0) AS sh FROM bars GROUP BY symbol), v AS (SELECT ts, sum(sh * close) AS value FROM bars JOIN f USING (symbol) GROUP BY ts)", "v", "ts", 3, value="value", pnl="value - lag(value) OVER (ORDER BY ts)", ret="value / nullif(lag(value) OVER (ORDER BY ts), 0) - 1", cum_ret="value / nullif(first_value(value) OVER (ORDER BY ts), 0) - 1"))
def e07_book(s, d):
    b = schema.bars(s, d)
    return rounded(portfolio.book(b, b.select("symbol").distinct().withColumn("weight", F.lit(0.2)), 1000.0), 3)


@query(select(LEDGER, "ledger", "symbol, l_orderkey, l_linenumber", 6, value="qty * price", weight="qty * price / nullif(sum(qty * price) OVER (PARTITION BY ts), 0)"))
def e08_position_weights(s, d):
    x = schema.trades(s, d)
    return rounded(portfolio.position_weights(x).select("symbol", "l_orderkey", "l_linenumber", "value", "weight"))


_E9 = """m AS (SELECT l_suppkey AS portfolio, l_partkey AS symbol, l_shipdate AS ts, (CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS qty, round(l_extendedprice * 100)::BIGINT AS cents, l_quantity::BIGINT AS n FROM lineitem),
ledger AS (SELECT portfolio, symbol, ts, qty, 10000 * ((2 * cents + n) // (2 * n)) AS price, 4 * cents AS commission FROM m),
dy AS (SELECT portfolio, symbol, ts, sum(qty) AS qty, sum(-qty * price - commission) AS flow, max(price) AS price FROM ledger GROUP BY ALL),
mk AS (SELECT *, sum(qty) OVER (PARTITION BY portfolio, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) * price AS mark FROM dy),
st AS (SELECT *, mark - coalesce(lag(mark) OVER (PARTITION BY portfolio, symbol ORDER BY ts), 0) AS step FROM mk),
pt AS (SELECT portfolio, ts, sum(flow) AS flow, sum(step) AS step FROM st GROUP BY portfolio, ts),
eq AS (SELECT portfolio, ts, 1000000000000 + sum(flow) OVER w AS cash, sum(step) OVER w AS mv FROM pt WINDOW w AS (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_E9} SELECT portfolio, ts, cash::DOUBLE / 1e6::DOUBLE AS cash, mv::DOUBLE / 1e6::DOUBLE AS market_value, (cash + mv)::DOUBLE / 1e6::DOUBLE AS equity FROM eq")
def e09_ledger_equity(s, d):
    # money as whole millionths, so that sums are exact: prices are rounded to cents, half a cent up
    cents, n = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    x = schema.table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", cents.alias("cents"), n.alias("n"), F.when(F.col("l_returnflag") == "R", -n).otherwise(n).alias("qty"))
    x = x.select(F.col("l_suppkey").alias("portfolio"), F.col("l_partkey").alias("symbol"), F.col("l_shipdate").alias("ts"), "qty", F.expr("10000L * ((2 * cents + n) div (2 * n))").alias("price"), (F.col("cents") * 4).alias("commission"))
    x = portfolio.ledger_equity(x, 10**12)
    return x.withColumns({c: F.col(c).cast("double") / 1e6 for c in ("cash", "market_value", "equity")})


@query()
def e10_pair_run(s, d):
    x = pairs.held_signal(_signals(s, d)).drop("p")
    return rounded(evaluate.pair_run(x).groupBy("sym1", "sym2").agg(F.max_by("value", "ts").alias("value"), F.sum("commission").alias("commission"), F.sum(F.abs("held")).alias("bars_held")), 4)


@query()
def g31_hysteresis_regime(s, d):
    x = schema.bars(s, d).withColumn("score", F.tanh((F.col("close") - 50) / 50))
    return evaluate.regime_with_hysteresis(x).groupBy("symbol", "regime").agg(F.count("*").alias("n"))


@query()
def w07_w39_recursive(s, d):
    return rounded(recursive.recursive_columns(schema.bars(s, d)))


@query()
def w44_diversification(s, d):
    wide = align.widen(schema.bars(s, d), ["click", "error", "view"])
    return rounded(recursive.diversification(wide, ["close_click", "close_error", "close_view"], 60))


@query()
def m02_pca(s, d):
    x, _ = ml.pca(schema.table(s, d, "embeddings"), "embedding", 8)
    return x.select("vec_id", F.transform("projected", lambda v: F.round(v, 4)).alias("projected"))


@query()
def m03_clusters(s, d):
    _, means = ml.cluster(schema.table(s, d, "lineitem").where("l_discount is not null"), ["l_quantity", "l_extendedprice", "l_discount"], 4)
    return rounded(means, 4)


@query()
def m04_boosted_returns(s, d):
    x = schema.bars(s, d).withColumns({"m5": R.sma("close", 5), "m10": R.sma("close", 10), "y": F.lead("close").over(R.ordered())}).dropna()
    x = x.withColumn("is_validation", F.dayofmonth("ts") > 20)
    return rounded(ml.boosted(x, ["close", "m5", "m10", "volume"], "y").select("symbol", "ts", "y", "pred"))


@query()
def m06_mutual_information(s, d):
    x = schema.table(s, d, "lineitem").withColumn("y", (F.col("l_extendedprice") > 30000).cast("int"))
    return rounded(ml.mutual_information(x, ["l_quantity", "l_discount", "l_tax"], "y"))


@query()
def m07_batched_scores(s, d):
    x = schema.table(s, d, "documents").select("doc_id", "n_chars")
    return ml.score_in_batches(x, lambda p: p.assign(score=p["n_chars"] / 1000.0)[["doc_id", "score"]], "doc_id long, score double", 256)


@query()
def m09_split(s, d):
    return ml.split(schema.table(s, d, "documents").select("doc_id", "source"), "doc_id").groupBy("is_train").agg(F.count("*").alias("n"))


def _tick_stream(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    x = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")
    return x.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def _drain(s, stream, name, mode="append"):
    """Runs a stream over what is there, into Parquet in the shared folder, and reads the result."""
    path = new_folder(s, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


def _sunk(s, stream, name, sink, columns):
    """Runs a stream over what is there through a foreachBatch sink in the shared folder, and reads the result."""
    path = new_folder(s, name)
    q = stream.writeStream.foreachBatch(sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return jobs.sink_results(s, f"{path}/out", columns)


@query("WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTES")
def r01_stream_bars(s, d):
    x = _drain(s, jobs.stream_bars(_tick_stream(s, d), "1 hour"), "r01")
    return x.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "n")


_R2 = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


@query(f"WITH x AS (SELECT event_type AS symbol, ts, value AS price, count(*) {_R2} AS n, avg(value) {_R2} AS m, stddev_samp(value) {_R2} AS s FROM events) SELECT symbol, ts, price, round(m, 6) + 0.0::DOUBLE AS mean, round(s, 6) + 0.0::DOUBLE AS std, round((price - m) / nullif(s, 0), 6) + 0.0::DOUBLE AS z FROM x WHERE n = 30")
def r02_r04_stream_zscore(s, d):
    x = _sunk(s, _tick_stream(s, d), "r02", lambda path: jobs.zscore_sink(path, 30), "symbol string, ts timestamp, price double, mean double, std double, z double")
    return rounded(x.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query()
def r03_stream_pairs(s, d):
    routed = jobs.route_to_pairs(_tick_stream(s, d), [("click", "view"), ("error", "login")])
    x = _sunk(s, routed, "r03", lambda path: jobs.pair_sink(path, 30), "pair string, ts timestamp, z double, kappa double, position int")
    return rounded(x.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("WITH g AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events) - 2, (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::TIMESTAMP AS start), w AS (SELECT event_type AS symbol, start, start + INTERVAL 3 DAYS AS \"end\", avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM events JOIN g ON ts >= start AND ts < start + INTERVAL 3 DAYS GROUP BY ALL) SELECT symbol, start, \"end\", round(mean, 6) + 0.0::DOUBLE AS mean, round(std, 6) + 0.0::DOUBLE AS std, n FROM w WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def r06_stream_formation(s, d):
    x = _drain(s, jobs.formation_stream(_tick_stream(s, d)), "r06")
    return rounded(x.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")}))
