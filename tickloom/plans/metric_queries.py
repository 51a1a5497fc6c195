"""Registered queries on profiles, return metrics, ledgers and choices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import rolling as R
from ..operators import align, gram, metrics, ml, pairs, portfolio
from .sql import DAILY, HOURLY, LEDGER, PAIRS, nearest, rounded, select

QUERIES, ORACLES = {}, {}


def query(text):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLES[f.__name__] = text
        return f

    return add


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lineitem(s, d):
    return schema.table(s, d, "lineitem")


@query("SELECT c AS \"column\", round(m, 6) + 0.0::DOUBLE AS missing, m > 0.1 AS \"drop\" FROM (SELECT 'a' AS c, avg((l_linenumber = 1)::INT) AS m FROM lineitem UNION ALL SELECT 'b', 0.0)")
def a01_missing(s, d):
    x = _lineitem(s, d).select(F.when(F.col("l_linenumber") != 1, 1).alias("a"), F.col("l_tax").alias("b"))
    return rounded(metrics.missing(x, ["a", "b"], 0.1))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) <= 1 AS single FROM lineitem" for c in [*LI, "l_returnflag"]))
def a02_distinct(s, d):
    return metrics.distinct_counts(_lineitem(s, d), [*LI, "l_returnflag"])


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{b}' AS \"drop\", '{a}' AS keep, corr({a}, {b}) AS corr FROM lineitem" for i, b in enumerate(LI) for a in LI[:i]) + ") SELECT \"drop\", keep, round(corr, 6) + 0.0::DOUBLE AS corr FROM c WHERE abs(corr) > 0.0001")
def a03_collinear(s, d):
    return rounded(metrics.collinear(_lineitem(s, d), LI, 0.0001))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INT AS \"l_returnflag_A\", (l_returnflag = 'N')::INT AS \"l_returnflag_N\", (l_returnflag = 'R')::INT AS \"l_returnflag_R\" FROM lineitem")
def a04_one_hot(s, d):
    return metrics.one_hot(_lineitem(s, d).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query(None)
def a05_importances(s, d):
    x = _lineitem(s, d).select(*LI, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return rounded(metrics.importances(x, LI, "y"))


@query("SELECT DISTINCT c AS \"column\" FROM (SELECT unnest(['l_tax', 'l_discount']) AS c UNION ALL SELECT CASE WHEN count(DISTINCT l_tax) < 100 THEN 'l_tax' END FROM lineitem) WHERE c IS NOT NULL")
def a06_removals(s, d):
    u = metrics.distinct_counts(_lineitem(s, d), ["l_tax", "l_discount"]).where("n_unique < 100")
    return metrics.removals(u, u.where("`column` = 'l_tax'"))


def _pr(s, d, same=False):
    return pairs.pair_returns(align.pair_bars(schema.bars(s, d), same=same))


_OK = "WHERE ret1 IS NOT NULL AND ret2 IS NOT NULL GROUP BY sym1, sym2"


@query(select(PAIRS, "pr", "sym1, sym2, count(*) AS n", where=_OK, corr="corr(ret1, ret2)"))
def a07_correlation(s, d):
    return rounded(metrics.pair_correlation(_pr(s, d)))


@query(select(PAIRS, "pr", "sym1, sym2, count(*) AS n", 3, where=_OK, cov="covar_samp(ret1, ret2) * 252"))
def a08_covariance(s, d):
    return rounded(metrics.pair_covariance(_pr(s, d)), 3)


#: Each symbol's own returns at times that two symbols share; users of the sample tables are many symbols with gaps.
_OWN = """t AS (SELECT user_id::VARCHAR AS symbol, ts, value AS price FROM events),
b AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(price, ts) AS close FROM t GROUP BY symbol, date_trunc('day', ts)),
o AS (SELECT symbol, ts, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret FROM b),
q AS (SELECT a.symbol AS sym1, b.symbol AS sym2, a.ret AS ret1, b.ret AS ret2 FROM o a JOIN o b ON a.ts = b.ts AND a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL)"""


def _own(s, d):
    return schema.bars(s, d, "day", "user_id").withColumn("ret", R.ret())


@query(f"WITH {_OWN} SELECT sym1, sym2, count(*) AS n, CASE WHEN count(*) > 2 THEN round(corr(ret1, ret2), 5) + 0.0::DOUBLE END AS corr FROM q WHERE sym1 < sym2 GROUP BY sym1, sym2")
def a07_correlation_matrix(s, d):
    x = gram.correlations(_own(s, d))
    return x.select("sym1", "sym2", "n", F.when(F.col("n") > 2, nearest("corr", 5)).alias("corr"))


@query(f"WITH {_OWN} SELECT sym1, sym2, count(*) AS n, round(covar_samp(ret1, ret2) * 252, 3) + 0.0::DOUBLE AS cov FROM q GROUP BY sym1, sym2")
def a08_covariance_matrix(s, d):
    return gram.covariances(_own(s, d)).withColumn("cov", nearest("cov", 3))


_MK = HOURLY + ", mk AS (SELECT ts, avg(ret) AS m FROM rets GROUP BY ts)"


@query(select(_MK, "rets JOIN mk USING (ts)", "symbol", where="WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY symbol", corr="corr(ret, m)"))
def a09_correlation_with(s, d):
    x = schema.bars(s, d).withColumn("ret", R.ret())
    return rounded(metrics.correlation_with(x.groupBy("ts").agg(F.avg("ret").alias("ret")), x))


def _curve(s, d):
    return schema.daily_close(s, d).select(F.col("symbol").alias("portfolio"), "ts", F.col("close").alias("equity"))


CURVE = DAILY + """,
cv AS (SELECT symbol AS portfolio, ts, close AS equity FROM d),
cr AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY portfolio ORDER BY ts), 0) - 1 AS ret, max(equity) OVER (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM cv),
mo AS (SELECT portfolio, date_trunc('month', ts) AS period, arg_max(equity, ts) AS last FROM cv GROUP BY ALL),
mr AS (SELECT *, last / nullif(lag(last) OVER (PARTITION BY portfolio ORDER BY period), 0) - 1 AS ret FROM mo)"""


@query(f"WITH {CURVE} SELECT portfolio, period, round(last, 4) AS last, round(ret, 6) + 0.0::DOUBLE AS ret FROM mr")
def a10_period_return(s, d):
    return metrics.period_return(_curve(s, d), "month").select("portfolio", "period", F.round("last", 4).alias("last"), (F.round("ret", 6) + 0.0).alias("ret"))


@query(select(DAILY + ", r AS (SELECT symbol, ts, (close - 140000) / 1e6 AS ret FROM d)", "r", "symbol, date_trunc('month', ts) AS period", where="GROUP BY ALL", sum_ret="sum(ret)", compounded="exp(sum(ln(1 + ret))) - 1"))
def a11_compound(s, d):
    x = schema.daily_close(s, d).withColumn("ret", (F.col("close") - 140000) / 1e6)
    return rounded(metrics.compound(x))


@query(select(CURVE, "cr", "portfolio", where="GROUP BY portfolio", sharpe="avg(ret) / stddev_samp(ret) * sqrt(252)", sharpe_pop="(avg(ret) - 0.0001) / stddev_pop(ret) * sqrt(252)", sortino="avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252)", sortino_std="avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252)", sortino_rms="avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252)"))
def a14_a15_sharpe_sortino(s, d):
    x = _curve(s, d).withColumn("ret", R.ret("equity", 1, ("portfolio",)))
    return rounded(x.groupBy("portfolio").agg(
        metrics.sharpe().alias("sharpe"), metrics.sharpe(risk_free=0.0001, population=True).alias("sharpe_pop"), metrics.sortino().alias("sortino"),
        metrics.sortino(variant="std").alias("sortino_std"), metrics.sortino(variant="rms_negative").alias("sortino_rms"),
    ))


@query(select(CURVE + ", w AS (SELECT *, max(equity) OVER (PARTITION BY portfolio ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cv)", "cr JOIN w USING (portfolio, ts)", "portfolio", where="GROUP BY portfolio", max_drawdown="min(cr.equity / peak - 1)", lake_ratio="sum(CASE WHEN p > w.equity THEN p - w.equity ELSE 0 END) / sum(w.equity)"))
def a16_a17_drawdown_lake(s, d):
    x = _curve(s, d)
    return rounded(metrics.max_drawdown(x).join(metrics.lake_ratio(x), "portfolio"))


@query(select(CURVE, "mr", "portfolio", where="WHERE ret IS NOT NULL GROUP BY portfolio", gain_to_pain="sum(ret) / nullif(-sum(least(ret, 0)), 0)", positive_pct="avg((ret > 0)::DOUBLE) * 100"))
def a18_gain_to_pain(s, d):
    return rounded(metrics.gain_to_pain(metrics.period_return(_curve(s, d))))


@query(select(CURVE + ", g AS (SELECT portfolio, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS t, count(ret) AS n, stddev_samp(ret) * sqrt(252) AS v, avg(ret) / stddev_samp(ret) * sqrt(252) AS s, min(equity / peak - 1) AS m FROM cr GROUP BY portfolio)", "g", "portfolio, n", total_return="t", volatility="v", sharpe="s", max_drawdown="m", annual_return="pow(1 + t, 252.0 / n) - 1", calmar="(pow(1 + t, 252.0 / n) - 1) / nullif(-m, 0)"))
def a19_summary(s, d):
    return rounded(metrics.summary(_curve(s, d)))


@query(select(CURVE + ", a AS (SELECT portfolio, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) AS sortino, stddev_samp(ret) * sqrt(252) AS volatility, min(equity / peak - 1) AS md FROM cr GROUP BY portfolio), b AS (SELECT portfolio, sum(ret) / nullif(-sum(least(ret, 0)), 0) AS g, avg((ret > 0)::DOUBLE) * 100 AS p, avg(ret) AS mm, min(ret) AS wm FROM mr WHERE ret IS NOT NULL GROUP BY portfolio), w AS (SELECT *, max(equity) OVER (PARTITION BY portfolio ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cv), l AS (SELECT portfolio, sum(CASE WHEN p > equity THEN p - equity ELSE 0 END) / sum(equity) AS l FROM w GROUP BY portfolio)", "a JOIN b USING (portfolio) JOIN l USING (portfolio)", "portfolio", sharpe="sharpe", sortino="sortino", volatility="volatility", gain_to_pain="g", positive_pct="b.p", mean_month="mm", worst_month="wm", max_drawdown="md", lake_ratio="l"))
def a20_kpis(s, d):
    return rounded(metrics.kpis(_curve(s, d)))


@query(select(LEDGER, "ledger", "portfolio, count(*) AS n_trades", 4, where="GROUP BY portfolio", win_rate="count(CASE WHEN pnl > 0 THEN 1 END)::DOUBLE / count(*)", profit_factor="sum(CASE WHEN pnl > 0 THEN pnl END) / nullif(-sum(CASE WHEN pnl < 0 THEN pnl END), 0)", avg_win="avg(CASE WHEN pnl > 0 THEN pnl END)", avg_loss="avg(CASE WHEN pnl < 0 THEN pnl END)", avg_trade="avg(pnl)", commissions="sum(commission)"))
def a21_trade_stats(s, d):
    return rounded(metrics.trade_stats(schema.trades(s, d)), 4)


@query(f"WITH {LEDGER}, i AS (SELECT *, pnl < 0 AS lost, row_number() OVER (PARTITION BY portfolio ORDER BY ts, l_orderkey, l_linenumber) - row_number() OVER (PARTITION BY portfolio, pnl < 0 ORDER BY ts, l_orderkey, l_linenumber) AS g FROM ledger), r AS (SELECT portfolio, lost, g, count(*) AS n FROM i GROUP BY ALL) SELECT portfolio, coalesce(max(CASE WHEN lost THEN n END), 0) AS max_losing_streak FROM r GROUP BY portfolio")
def a22_losing_streak(s, d):
    return metrics.losing_streak(schema.trades(s, d))


def _position(s, d):
    x = schema.bars(s, d)
    return x.select("symbol", "ts", F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open") * 0.5, -1).otherwise(0).alias("position"))


POS = HOURLY + ", ps AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 WHEN close < open * 0.5 THEN -1 ELSE 0 END AS position FROM bars), isl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, position ORDER BY ts) AS g, coalesce(lead(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS nx FROM ps)"


@query(select(POS + ", r AS (SELECT symbol, position, g, min(ts) AS a, max(nx) AS b FROM isl WHERE position <> 0 GROUP BY ALL)", "r", "symbol, count(*) AS n_positions", where="GROUP BY symbol", avg_hours="avg(date_diff('second', a, b) / 3600.0::DOUBLE)"))
def a23_trade_duration(s, d):
    return rounded(metrics.trade_duration(_position(s, d)))


@query(f"WITH {LEDGER}, m AS (SELECT portfolio, date_trunc('month', ts) AS month, sum(pnl) AS pnl FROM ledger GROUP BY ALL) SELECT portfolio, month, round(pnl, 5) + 0.0::DOUBLE AS pnl, round(pnl / 10000, 5) + 0.0::DOUBLE AS ret, round(sum(pnl) OVER (PARTITION BY portfolio ORDER BY month ROWS UNBOUNDED PRECEDING), 5) + 0.0::DOUBLE AS cum_pnl FROM m")
def a24_monthly_pnl(s, d):
    return rounded(metrics.monthly_pnl(schema.trades(s, d), 10_000.0), 5)


@query(f"WITH {LEDGER}, c AS (SELECT *, sum(pnl) OVER w AS cum FROM ledger WINDOW w AS (PARTITION BY portfolio ORDER BY ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)), e AS (SELECT *, greatest(max(1e6 + cum) OVER (PARTITION BY portfolio ORDER BY ts, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING), 1e6) AS p FROM c) SELECT portfolio, l_orderkey, l_linenumber, round(cum, 5) + 0.0::DOUBLE AS cum_pnl, round((p - 1e6 - cum) / p, 6) + 0.0::DOUBLE AS drawdown FROM e")
def a24_ledger_drawdown(s, d):
    x = metrics.ledger_drawdown(schema.trades(s, d), 1e6)
    return x.select("portfolio", "l_orderkey", "l_linenumber", (F.round("cum_pnl", 5) + 0.0).alias("cum_pnl"), (F.round("drawdown", 6) + 0.0).alias("drawdown"))


@query("WITH p AS (SELECT p_brand AS sector, sum(l_extendedprice) AS value, sum(l_extendedprice * (l_discount - 0.05::DOUBLE)) AS pnl FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand) SELECT sector, round(value, 2) + 0.0::DOUBLE AS value, round(pnl, 2) + 0.0::DOUBLE AS pnl, round(value / sum(value) OVER (), 6) + 0.0::DOUBLE AS weight FROM p")
def a25_sectors(s, d):
    x = schema.trades(s, d).join(schema.table(s, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector")), "symbol")
    x = metrics.sector_totals(x.withColumn("value", F.abs("qty") * F.col("price")))
    return x.select("sector", (F.round("value", 2) + 0.0).alias("value"), (F.round("pnl", 2) + 0.0).alias("pnl"), (F.round("weight", 6) + 0.0).alias("weight"))


@query(select(LEDGER + ", e AS (SELECT portfolio, sum(greatest(qty * price, 0)) AS l, sum(least(qty * price, 0)) AS s FROM ledger GROUP BY portfolio)", "e", "portfolio, 1e7::DOUBLE AS cash", 3, long="l", short="s", net="l + s", gross="l - s", cash_ratio="1e7 / (l + s + 1e7)", leverage="(l - s) / (l + s + 1e7)"))
def a26_exposure(s, d):
    x = schema.trades(s, d).withColumns({"value": F.col("qty") * F.col("price"), "cash": F.lit(1e7)})
    return rounded(metrics.exposure(x), 3)


@query(select(HOURLY + ", q AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM rets)", "q", "symbol", 4, where="GROUP BY symbol", annual_return="avg(ret) * 252", volatility="stddev_samp(ret) * sqrt(252)", sharpe="avg(ret) / stddev_samp(ret) * sqrt(252)", max_drawdown="min(close / nullif(peak, 0) - 1)", last_price="arg_max(close, ts)", avg_volume="avg(volume)"))
def a27_asset_metrics(s, d):
    return rounded(metrics.asset_metrics(schema.bars(s, d)), 4)


def _regimes(s, d):
    x = schema.bars(s, d).withColumn("ret", R.ret())
    return x.withColumn("regime", F.when(F.col("n") >= 4, 2).when(F.col("n") == 3, 1).otherwise(0))


REG = HOURLY + ", rg AS (SELECT *, CASE WHEN n >= 4 THEN 2 WHEN n = 3 THEN 1 ELSE 0 END AS regime FROM rets)"


@query(f"WITH {REG}, g AS (SELECT regime, avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, count(*) AS n FROM rg WHERE ret IS NOT NULL GROUP BY regime) SELECT regime, round(mean, 5) + 0.0::DOUBLE AS mean, round(std, 5) + 0.0::DOUBLE AS std, round(sharpe, 5) + 0.0::DOUBLE AS sharpe, n, round(n / sum(n) OVER (), 5) + 0.0::DOUBLE AS share, CASE row_number() OVER (ORDER BY sharpe, regime) WHEN 1 THEN 'bear' WHEN count(*) OVER () THEN 'bull' ELSE 'neutral' END AS name FROM g")
def a28_regime_stats(s, d):
    return rounded(metrics.regime_stats(_regimes(s, d)), 5)


@query(f"WITH {REG}, i AS (SELECT symbol, regime, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS g FROM rg), r AS (SELECT symbol, regime, g, count(*) AS n FROM i GROUP BY ALL) SELECT regime, count(*) AS runs, round(avg(n), 6) AS mean_run, max(n) AS max_run, sum(n)::BIGINT AS bars, round(sum(n) / sum(sum(n)) OVER (), 6) + 0.0::DOUBLE AS share FROM r GROUP BY regime")
def a29_regime_runs(s, d):
    return rounded(metrics.regime_runs(_regimes(s, d)))


@query(f"WITH {REG}, p AS (SELECT lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS f, regime AS t FROM rg) SELECT f AS \"from\", t AS \"to\", count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY f), 6) + 0.0::DOUBLE AS chance FROM p WHERE f IS NOT NULL GROUP BY f, t")
def a29_transitions(s, d):
    return rounded(metrics.transitions(_regimes(s, d)))


@query(select(PAIRS + ", sg AS (SELECT sym1, (close1 - close2) / 10 AS z, close1 / 1000 AS p, CASE WHEN close1 - close2 > 20 THEN -1 WHEN close1 - close2 < -20 THEN 1 ELSE 0 END AS signal FROM pb)", "sg", "sym1, count(*) AS n, count(CASE WHEN signal > 0 THEN 1 END) AS long, count(CASE WHEN signal < 0 THEN 1 END) AS short", where="WHERE signal <> 0 GROUP BY sym1", mean_z="avg(z)", mean_p="avg(p)"))
def a30_signal_counts(s, d):
    x = align.pair_bars(schema.bars(s, d))
    gap = F.col("close1") - F.col("close2")
    return rounded(metrics.signal_counts(x.select("sym1", (gap / 10).alias("z"), (F.col("close1") / 1000).alias("p"), F.when(gap > 20, -1).when(gap < -20, 1).otherwise(0).alias("signal"))))


@query(select(LEDGER + ", e AS (SELECT portfolio, ts, sum(price) AS equity FROM ledger GROUP BY ALL), f AS (SELECT portfolio, arg_max(equity, ts) AS f FROM e GROUP BY portfolio), c AS (SELECT portfolio, sum(commission) AS c FROM ledger GROUP BY portfolio)", "c JOIN f USING (portfolio)", "portfolio", 2, commission="c", final="f", impact_pct="c / f * 100"))
def a31_commission_impact(s, d):
    x = schema.trades(s, d)
    return rounded(metrics.commission_impact(x, x.groupBy("portfolio", "ts").agg(F.sum("price").alias("equity"))), 2)


_PQ = "avg(pow(truth - pred, 2)) AS mse, 1 - sum(pow(truth - pred, 2)) / nullif(var_pop(truth) * count(*), 0) AS r2, avg((sign(truth) = sign(pred))::DOUBLE) AS direction, count(*) AS n"


@query(f"WITH {HOURLY}, x AS (SELECT symbol, close - open AS truth, high - low - 1 AS pred FROM bars), p AS (SELECT symbol, {_PQ} FROM x GROUP BY symbol), u AS (SELECT * FROM p UNION ALL SELECT NULL, avg(mse), avg(r2), avg(direction), sum(n) FROM p) SELECT symbol, round(mse, 4) + 0.0::DOUBLE AS mse, round(r2, 4) + 0.0::DOUBLE AS r2, round(direction, 4) + 0.0::DOUBLE AS direction, n::BIGINT AS n FROM u")
def a32_prediction_quality(s, d):
    x = schema.bars(s, d).select("symbol", (F.col("close") - F.col("open")).alias("truth"), (F.col("high") - F.col("low") - 1).alias("pred"))
    return rounded(metrics.prediction_quality(x), 4)


@query(f"WITH {LEDGER} SELECT symbol, l_orderkey, l_linenumber, round(qty * price - lag(qty * price) OVER (PARTITION BY symbol ORDER BY ts, l_orderkey, l_linenumber), 3) + 0.0::DOUBLE AS pnl FROM ledger")
def a33_value_change(s, d):
    return rounded(metrics.value_change_pnl(schema.trades(s, d)).select("symbol", "l_orderkey", "l_linenumber", "pnl"), 3)


@query(select(CURVE + ", g AS (SELECT portfolio, (arg_max(equity, ts) / arg_min(equity, ts) - 1) * 100 AS g FROM cv GROUP BY portfolio), o AS (SELECT max(CASE WHEN portfolio LIKE '1%' THEN g END) AS a, max(CASE WHEN portfolio LIKE '5%' THEN g END) AS b FROM g)", "o", "1 AS one", strategy_pct="a", benchmark_pct="b", outperformance_pct="a - b"))
def a34_outperformance(s, d):
    x = _curve(s, d).withColumn("portfolio", F.substring("portfolio", 1, 1))
    return rounded(metrics.outperformance(x, "1", "5").select(F.lit(1).alias("one"), "*"))


@query(select(HOURLY + ", m AS (SELECT symbol, quantile_cont(close, 0.5) AS m FROM bars GROUP BY symbol)", "bars JOIN m USING (symbol)", "symbol", where="GROUP BY symbol", mad="quantile_cont(abs(close - m), 0.5)"))
def a35_mad(s, d):
    return rounded(metrics.mad(schema.bars(s, d), "close"))


@query(f"WITH {LEDGER}, p AS (SELECT ts, sum(pnl - commission) AS net FROM ledger GROUP BY ts) SELECT ts, round(net, 5) + 0.0::DOUBLE AS net, round(1e6 + sum(net) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 5) + 0.0::DOUBLE AS capital FROM p")
def a36_capital_curve(s, d):
    return rounded(metrics.capital_curve(schema.trades(s, d), 1e6, ["ts", "portfolio", "symbol", "l_orderkey", "l_linenumber"]), 5)


@query("WITH x AS (SELECT l_partkey AS sym1, l_suppkey AS sym2, round(avg(l_extendedprice), 4) AS t FROM lineitem GROUP BY ALL) SELECT * FROM x ORDER BY t, sym1, sym2 LIMIT 20")
def k01_top_pairs(s, d):
    x = _lineitem(s, d).groupBy(F.col("l_partkey").alias("sym1"), F.col("l_suppkey").alias("sym2")).agg(F.round(F.avg("l_extendedprice"), 4).alias("t"))
    return portfolio.top_pairs(x, 20)


@query("WITH c AS (SELECT p_name AS symbol, p_retailprice / 1000 AS corr FROM part) SELECT * FROM (SELECT symbol, round(corr, 6) AS corr FROM c WHERE symbol <> 'seed' ORDER BY c.corr, symbol LIMIT 4) UNION ALL SELECT 'seed', 1.0")
def k02_least_correlated(s, d):
    return rounded(portfolio.least_correlated(schema.table(s, d, "part").select(F.col("p_name").alias("symbol"), (F.col("p_retailprice") / 1000).alias("corr")), "seed", 5))


@query("WITH s AS (SELECT p_partkey AS symbol, p_brand AS sector, p_retailprice AS price, 0.6::DOUBLE * percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) + 0.4::DOUBLE * percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, symbol)::INT AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 3), q AS (SELECT *, floor(1e6 / count(*) OVER () / price)::BIGINT AS shares FROM k) SELECT symbol, sector, price, round(score, 6) + 0.0::DOUBLE AS score, rank, shares, round(shares * price * 0.001, 4) + 0.0::DOUBLE AS commission FROM q")
def k03_per_sector(s, d):
    p = schema.table(s, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("price"), "p_size")
    x = portfolio.pick_per_sector(portfolio.factor_score(p, {"p_size": (0.6, True), "price": (0.4, False)}), 3, 1e6)
    return x.select("symbol", "sector", "price", (F.round("score", 6) + 0.0).alias("score"), "rank", "shares", (F.round("commission", 4) + 0.0).alias("commission"))


@query("WITH r AS (SELECT o_custkey AS symbol, o_totalprice AS balance, o_orderkey AS p FROM orders) SELECT symbol, max(balance) AS balance, arg_max(p, (balance, p)) AS p FROM r GROUP BY symbol")
def k04_best_parameters(s, d):
    o = schema.table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("p"))
    return portfolio.best_parameters(o, ["p"])


@query("WITH f AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS sharpe, o_totalprice % 977 + 1 AS vol FROM orders) SELECT id, round(sharpe, 6) AS sharpe, round(vol, 4) AS vol, 'max_sharpe' AS pick FROM f WHERE id = (SELECT arg_max(id, (sharpe, -id)) FROM f) UNION ALL SELECT id, round(sharpe, 6), round(vol, 4), 'min_vol' FROM f WHERE id = (SELECT arg_min(id, (vol, id)) FROM f)")
def k05_best_rows(s, d):
    f = schema.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("sharpe"), (F.col("o_totalprice") % 977 + 1).alias("vol"))
    x = portfolio.best_rows(f)
    return x.select("id", F.round("sharpe", 6).alias("sharpe"), F.round("vol", 4).alias("vol"), "pick")


@query(f"WITH {HOURLY}, s AS (SELECT symbol, ts, close AS price, abs(close - open) AS confidence, sign(close - open) AS signal FROM bars), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY confidence DESC, symbol) AS rank, least(count(*) OVER (PARTITION BY ts), 3) AS n FROM s WHERE signal <> 0) SELECT symbol, ts, rank::INT AS rank, round(least(0.3::DOUBLE, 1.0 / n) * 1000, 4) AS allocation, round(least(0.3::DOUBLE, 1.0 / n) * 1000 / nullif(price, 0) * signal, 4) + 0.0::DOUBLE AS qty FROM r WHERE rank <= n")
def k06_rank_signals(s, d):
    b = schema.bars(s, d)
    x = b.select("symbol", "ts", F.col("close").alias("price"), F.abs(F.col("close") - F.col("open")).alias("confidence"), F.signum(F.col("close") - F.col("open")).alias("signal"))
    return rounded(portfolio.rank_signals(x, 0.3, 1000.0).select("symbol", "ts", "rank", "allocation", "qty"), 4)


def _train(x):
    return x.withColumn("part", F.when(F.col("l_linenumber") <= 3, "train").otherwise("test"))


def _scaled(a, b):
    return f"WITH s AS (SELECT {a} AS a, {b} AS b FROM lineitem WHERE l_linenumber <= 3) SELECT l_orderkey, l_linenumber, round((l_extendedprice - a) / b, 6) + 0.0::DOUBLE AS l_extendedprice FROM lineitem, s"


def _scale(how):
    def run(s, d):
        x = _train(_lineitem(s, d).select("l_orderkey", "l_linenumber", "l_extendedprice"))
        return rounded(ml.scale(x, ["l_extendedprice"], how).drop("part"))

    return run


for _how, _a, _b in (("standard", "avg(l_extendedprice)", "stddev_pop(l_extendedprice)"), ("min_max", "min(l_extendedprice)", "max(l_extendedprice) - min(l_extendedprice)"), ("robust", "quantile_cont(l_extendedprice, 0.5)", "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)")):
    QUERIES[f"m01_scale_{_how}"], ORACLES[f"m01_scale_{_how}"] = _scale(_how), _scaled(_a, _b)


@query(f"WITH {HOURLY}, x AS (SELECT symbol, ts, ret, close, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM rets), w AS (SELECT ts, " + ", ".join(f"max(CASE WHEN symbol = '{k}' THEN {c} END) AS {k}_{n}" for k in ("click", "view") for c, n in (("close", "close"), ("nx", "next_ret"))) + ", avg(close) AS m, stddev_samp(close) AS s FROM x GROUP BY ts) SELECT ts, click_close, round(click_next_ret, 6) + 0.0::DOUBLE AS click_next_ret, view_close, round(view_next_ret, 6) + 0.0::DOUBLE AS view_next_ret, round(m, 6) + 0.0::DOUBLE AS mkt_close_mean, round(s, 6) + 0.0::DOUBLE AS mkt_close_std FROM w WHERE click_close IS NOT NULL AND click_next_ret IS NOT NULL AND view_close IS NOT NULL AND view_next_ret IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL")
def m05_training_matrix(s, d):
    x = schema.bars(s, d).withColumn("ret", R.ret())
    return rounded(ml.training_matrix(x, ["click", "view"], ["close"]))


@query("SELECT item_id, text AS question, text || '|b|c|d' AS options, CASE item_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END::INT AS answer FROM benchmark")
def m08_answers(s, d):
    b = schema.table(s, d, "benchmark")
    x = b.select("item_id", F.col("text").alias("question"), F.col("text").alias("AnswerAText"), F.lit("b").alias("AnswerBText"), F.lit("c").alias("AnswerCText"), F.lit("d").alias("AnswerDText"), F.substring(F.lit("ABCDX"), (F.col("item_id") % 5 + 1).cast("int"), F.lit(1)).alias("CorrectAnswer"))
    return ml.answers(x).select("item_id", "question", F.array_join("options", "|").alias("options"), F.col("answer").cast("int").alias("answer"))
