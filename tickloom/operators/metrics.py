"""Column profiles, return metrics and trade statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ratio, ret
from .prefix import running


def _long(row: DataFrame, columns: list[str], value: str) -> DataFrame:
    return row.unpivot([], columns, "column", value)


def missing(x: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """A1: column, share of nulls, and whether it is above the threshold; one aggregate."""
    row = x.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return _long(row, columns, "missing").withColumn("drop", F.col("missing") > threshold)


def distinct_counts(x: DataFrame, columns: list[str]) -> DataFrame:
    """A2: column, distinct non-null values, and whether there is one at most."""
    row = x.agg(*(F.count_distinct(c).alias(c) for c in columns))
    return _long(row, columns, "n_unique").withColumn("single", F.col("n_unique") <= 1)


def collinear(x: DataFrame, columns: list[str], threshold: float = 0.9) -> DataFrame:
    """A3: (drop, keep, corr) for column pairs whose Pearson correlation exceeds the threshold; all in one aggregate."""
    ps = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    row = x.agg(F.array(*(F.struct(F.lit(b).alias("drop"), F.lit(a).alias("keep"), F.corr(a, b).alias("corr")) for a, b in ps)).alias("p"))
    return row.select(F.inline("p")).where(F.abs("corr") > threshold)


def one_hot(x: DataFrame, c: str, values: list[str]) -> DataFrame:
    """A4: a 0/1 column <c>_<value> for each stated value."""
    return x.withColumns({f"{c}_{v}": (F.col(c) == v).cast("int") for v in values})


def importances(x: DataFrame, features: list[str], label: str, threshold: float = 0.99, seed: int = 7) -> DataFrame:
    """A5: feature, importance (of boosted trees), its running sum, and whether it is zero or beyond the threshold."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(x)
    model = GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=4, seed=seed).fit(data)
    rows = [(n, float(v)) for n, v in zip(features, model.featureImportances.toArray(), strict=True)]
    out = x.sparkSession.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)  # one row a feature
    out = out.withColumn("cumulative", F.sum("importance").over(w))
    return out.withColumns({"zero": F.col("importance") == 0, "low": F.col("cumulative") - F.col("importance") >= threshold})


def removals(*lists: DataFrame) -> DataFrame:
    """Union of lists of column names (column)."""
    return reduce(DataFrame.union, [x.select("column") for x in lists]).distinct()


def pair_correlation(pair_returns: DataFrame) -> DataFrame:
    """sym1, sym2, corr and n of (ret1, ret2). Partial sums before the shuffle, so a pair is never one task's rows."""
    both = F.col("ret1").isNotNull() & F.col("ret2").isNotNull()
    return pair_returns.where(both).groupBy("sym1", "sym2").agg(F.corr("ret1", "ret2").alias("corr"), F.count("*").alias("n"))


def pair_covariance(pair_returns: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Annualised sample covariance of returns for pairs with sym1 <= sym2."""
    both = F.col("ret1").isNotNull() & F.col("ret2").isNotNull()
    return pair_returns.where(both).groupBy("sym1", "sym2").agg((F.covar_samp("ret1", "ret2") * per_year).alias("cov"), F.count("*").alias("n"))


def correlation_with(portfolio: DataFrame, returns: DataFrame) -> DataFrame:
    """Symbol and the correlation of its returns with a portfolio's (ts, ret), ascending."""
    p = portfolio.select("ts", F.col("ret").alias("_p"))
    return returns.join(p, "ts").where("ret is not null and _p is not null").groupBy("symbol").agg(F.corr("ret", "_p").alias("corr")).orderBy("corr", "symbol")


def period_return(curve: DataFrame, unit: str = "month", key: str = "portfolio", value: str = "equity") -> DataFrame:
    """A10: the last value of each period and its return on the period before."""
    x = curve.groupBy(key, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period")).agg(F.max_by(value, "ts").alias("last"))
    return x.withColumn("ret", ret("last", 1, (key,), ("period",)))


def compound(returns: DataFrame, unit: str = "month", key: str = "symbol") -> DataFrame:
    """Sum and compounded growth of returns by period."""
    x = returns.where("ret is not null").groupBy(key, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period"))
    return x.agg(F.sum("ret").alias("sum_ret"), (F.product(1 + F.col("ret")) - 1).alias("compounded"))


def sharpe(r: str | Column = "ret", risk_free: float = 0.0, per_year: float = 252.0, population: bool = False) -> Column:
    """A14, as an aggregate; null if returns don't vary."""
    r = F.col(r) if isinstance(r, str) else r
    return ratio(F.avg(r) - risk_free, (F.stddev_pop if population else F.stddev_samp)(r)) * math.sqrt(per_year)


def sortino(r: str = "ret", risk_free: float = 0.0, per_year: float = 252.0, variant: str = "downside") -> Column:
    """A15, as an aggregate. variant: "downside" (root mean square of negative excess over all), "std" (sample deviation of
    the negative returns), "rms_negative" (root mean square of the negative returns)."""
    e = F.col(r) - risk_free
    if variant == "downside":
        d = F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), F.lit(2))))
    elif variant == "std":
        d = F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))
    elif variant == "rms_negative":
        d = F.sqrt(F.avg(F.when(F.col(r) < 0, F.pow(F.col(r), F.lit(2)))))
    else:
        raise ValueError(variant)
    return ratio(F.avg(e), d) * math.sqrt(per_year)


def with_drawdown(curve: DataFrame, key: str = "portfolio", value: str = "equity") -> DataFrame:
    """Adds peak and drawdown (a fraction, 0 or less)."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", ratio(F.col(value), F.col("peak")) - 1)


def max_drawdown(curve: DataFrame, key: str = "portfolio", value: str = "equity") -> DataFrame:
    """The deepest drawdown per portfolio."""
    return with_drawdown(curve, key, value).groupBy(key).agg(F.min("drawdown").alias("max_drawdown"))


def lake_ratio(curve: DataFrame, key: str = "portfolio", value: str = "equity") -> DataFrame:
    """Sum of what lies below the peak of earlier rows over the sum of values."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    x = curve.withColumn("_p", F.max(value).over(w))
    water = F.sum(F.when(F.col("_p") > F.col(value), F.col("_p") - F.col(value)).otherwise(0.0))
    return x.groupBy(key).agg(ratio(water, F.sum(value)).alias("lake_ratio"))


def gain_to_pain(returns: DataFrame, key: str = "portfolio", r: str = "ret") -> DataFrame:
    """Sum of returns over the size of the negative ones, and the percentage of positive ones."""
    x = returns.where(F.col(r).isNotNull())
    return x.groupBy(key).agg(ratio(F.sum(r), -F.sum(F.least(r, F.lit(0.0)))).alias("gain_to_pain"), (F.avg((F.col(r) > 0).cast("double")) * 100).alias("positive_pct"))


def summary(curve: DataFrame, per_year: float = 252.0, key: str = "portfolio", value: str = "equity") -> DataFrame:
    """Total and annualised return, volatility, Sharpe, deepest drawdown and Calmar ratio of equity curves."""
    x = with_drawdown(curve.withColumn("ret", ret(value, 1, (key,))), key, value)
    x = x.groupBy(key).agg(
        (ratio(F.max_by(value, "ts"), F.min_by(value, "ts")) - 1).alias("total_return"),
        F.count("ret").alias("n"),
        (F.stddev_samp("ret") * math.sqrt(per_year)).alias("volatility"),
        sharpe(per_year=per_year).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
    )
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), per_year / F.nullif(F.col("n"), F.lit(0))) - 1)
    return x.withColumn("annual_return", annual).withColumn("calmar", ratio(F.col("annual_return"), -F.col("max_drawdown")))


def kpis(curve: DataFrame, key: str = "portfolio", value: str = "equity", per_year: float = 252.0) -> DataFrame:
    """Nine metrics in one row for each portfolio."""
    daily = curve.withColumn("ret", ret(value, 1, (key,)))
    monthly = period_return(curve, "month", key, value)
    a = daily.groupBy(key).agg(sharpe(per_year=per_year).alias("sharpe"), sortino(per_year=per_year).alias("sortino"), (F.stddev_samp("ret") * math.sqrt(per_year)).alias("volatility"))
    b = gain_to_pain(monthly, key).join(monthly.groupBy(key).agg(F.avg("ret").alias("mean_month"), F.min("ret").alias("worst_month")), key)
    return a.join(b, key).join(max_drawdown(curve, key, value), key).join(lake_ratio(curve, key, value), key)


def trade_stats(trades: DataFrame, key: str = "portfolio") -> DataFrame:
    """Counts, win rate, profit factor, averages and commissions of trades (pnl, commission)."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return trades.groupBy(key).agg(
        F.count("*").alias("n_trades"), (F.count(win) / F.count("*")).alias("win_rate"), ratio(F.sum(win), -F.sum(loss)).alias("profit_factor"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.avg("pnl").alias("avg_trade"), F.sum("commission").alias("commissions"),
    )


def islands(x: DataFrame, state: str, key: str, order: list[str]) -> DataFrame:
    """Adds `island`, a number that is the same for neighbouring rows of equal state."""
    a = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    b = F.row_number().over(Window.partitionBy(key, state).orderBy(*order))
    return x.withColumn("island", a - b)


def losing_streak(trades: DataFrame, key: str = "portfolio", order: list[str] = ["ts", "l_orderkey", "l_linenumber"]) -> DataFrame:  # noqa: B006
    """The longest run of losing trades."""
    x = islands(trades.withColumn("_lost", F.col("pnl") < 0), "_lost", key, order)
    runs = x.groupBy(key, "_lost", "island").agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_lost"), F.col("n"))), F.lit(0)).alias("max_losing_streak"))


def trade_duration(states: DataFrame, key: str = "symbol", state: str = "position") -> DataFrame:
    """Mean hours from the first bar of a position to the first bar after it (the last bar for open ones)."""
    x = islands(states, state, key, ["ts"]).withColumn("_next", F.coalesce(F.lead("ts").over(Window.partitionBy(key).orderBy("ts")), F.col("ts")))
    runs = x.where(F.col(state) != 0).groupBy(key, state, "island").agg(F.min("ts").alias("a"), F.max("_next").alias("b"))
    hours = F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 3600
    return runs.groupBy(key).agg(F.avg(hours).alias("avg_hours"), F.count("*").alias("n_positions"))


def monthly_pnl(trades: DataFrame, capital: float, key: str = "portfolio") -> DataFrame:
    """Profit per month over the initial capital, with its running sum."""
    x = trades.groupBy(key, F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({"ret": F.col("pnl") / capital, "cum_pnl": F.sum("pnl").over(w)})


def ledger_drawdown(trades: DataFrame, capital: float, key: str = "portfolio", order: list[str] = ["ts", "l_orderkey", "l_linenumber"]) -> DataFrame:  # noqa: B006
    """Cumulative profit and drawdown of equity on every row of a ledger."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("cum_pnl", F.sum("pnl").over(w)).withColumn("_e", capital + F.col("cum_pnl"))
    return x.withColumn("drawdown", ratio(F.greatest(F.max("_e").over(w), F.lit(capital)) - F.col("_e"), F.greatest(F.max("_e").over(w), F.lit(capital)))).drop("_e")


def sector_totals(positions: DataFrame) -> DataFrame:
    """Value, profit and weight by sector (sector, value, pnl)."""
    x = positions.groupBy("sector").agg(F.sum("value").alias("value"), F.sum("pnl").alias("pnl"))
    return x.withColumn("weight", ratio(F.col("value"), F.sum("value").over(Window.partitionBy())))  # one row a sector


def exposure(positions: DataFrame, key: str = "portfolio") -> DataFrame:
    """Long, short, net and gross value, cash ratio and leverage (value signed, cash)."""
    x = positions.groupBy(key).agg(F.sum(F.greatest("value", F.lit(0.0))).alias("long"), F.sum(F.least("value", F.lit(0.0))).alias("short"), F.max("cash").alias("cash"))
    x = x.withColumns({"net": F.col("long") + F.col("short"), "gross": F.col("long") - F.col("short")})
    equity = F.col("net") + F.col("cash")
    return x.withColumns({"cash_ratio": ratio(F.col("cash"), equity), "leverage": ratio(F.col("gross"), equity)})


def asset_metrics(bars: DataFrame, per_year: float = 252.0) -> DataFrame:
    """Annual return, volatility, Sharpe, deepest drawdown, last price and mean volume of each symbol."""
    x = with_drawdown(bars.withColumn("ret", ret()), "symbol", "close")
    return x.groupBy("symbol").agg(
        (F.avg("ret") * per_year).alias("annual_return"), (F.stddev_samp("ret") * math.sqrt(per_year)).alias("volatility"), sharpe(per_year=per_year).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.max_by("close", "ts").alias("last_price"), F.avg("volume").alias("avg_volume"),
    )


def regime_stats(x: DataFrame, state: str = "regime", per_year: float = 252.0) -> DataFrame:
    """Mean, deviation, Sharpe, bars and share of time of each state, and its name by Sharpe (bear, neutral, bull)."""
    g = x.where("ret is not null").groupBy(state).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), sharpe(per_year=per_year).alias("sharpe"), F.count("*").alias("n"))
    one = Window.partitionBy()  # one row a state
    rank = F.row_number().over(Window.orderBy("sharpe", state))
    total = F.count("*").over(one)
    name = F.when(rank == 1, "bear").when(rank == total, "bull").otherwise("neutral")
    return g.withColumns({"share": F.col("n") / F.sum("n").over(one), "name": name})


def regime_runs(x: DataFrame, state: str = "regime", key: str = "symbol") -> DataFrame:
    """Runs, mean and longest run, and share of time of each state."""
    runs = islands(x, state, key, ["ts"]).groupBy(key, state, "island").agg(F.count("*").alias("n"))
    g = runs.groupBy(state).agg(F.count("*").alias("runs"), F.avg("n").alias("mean_run"), F.max("n").alias("max_run"), F.sum("n").alias("bars"))
    return g.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy()))


def transitions(x: DataFrame, state: str = "regime", key: str = "symbol") -> DataFrame:
    """From, to and the chance of the step."""
    w = Window.partitionBy(key).orderBy("ts")
    p = x.select(F.lag(state).over(w).alias("from"), F.col(state).alias("to")).where("`from` is not null").groupBy("from", "to").agg(F.count("*").alias("n"))
    return p.withColumn("chance", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def signal_counts(signals: DataFrame, key: str = "sym1") -> DataFrame:
    """Signals in all, long, short, and the mean z and p of them (signal, z, p)."""
    on = signals.where("signal <> 0")
    return on.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(F.col("signal") > 0, 1)).alias("long"), F.count(F.when(F.col("signal") < 0, 1)).alias("short"), F.avg("z").alias("mean_z"), F.avg("p").alias("mean_p"))


def commission_impact(trades: DataFrame, curve: DataFrame, key: str = "portfolio") -> DataFrame:
    """Commissions as a percentage of the final equity."""
    last = curve.groupBy(key).agg(F.max_by("equity", "ts").alias("final"))
    return trades.groupBy(key).agg(F.sum("commission").alias("commission")).join(last, key).withColumn("impact_pct", ratio(F.col("commission"), F.col("final")) * 100)


def prediction_quality(x: DataFrame, key: str = "symbol") -> DataFrame:
    """Mean squared error, R squared and directional accuracy of (truth, pred), per key and in all (key null)."""
    x = x.where("truth is not null and pred is not null")
    se = F.pow(F.col("truth") - F.col("pred"), F.lit(2))
    hit = (F.signum("truth") == F.signum("pred")).cast("double")
    aggs = [F.avg(se).alias("mse"), (1 - ratio(F.sum(se), F.var_pop("truth") * F.count("*"))).alias("r2"), F.avg(hit).alias("direction"), F.count("*").alias("n")]
    per = x.groupBy(key).agg(*aggs)
    return per.unionByName(per.agg(*(F.avg(c).alias(c) for c in ("mse", "r2", "direction")), F.sum("n").alias("n")).withColumn(key, F.lit(None).cast(x.schema[key].dataType)))


def value_change_pnl(ledger: DataFrame, key: str = "symbol", order: list[str] = ["ts", "l_orderkey", "l_linenumber"]) -> DataFrame:  # noqa: B006
    """Profit of each row as the change of trade value (qty * price) within its symbol."""
    w = Window.partitionBy(key).orderBy(*order)
    v = F.col("qty") * F.col("price")
    return ledger.withColumn("_v", v).withColumn("pnl", F.col("_v") - F.lag("_v").over(w)).drop("_v")


def outperformance(curves: DataFrame, strategy: str, benchmark: str) -> DataFrame:
    """Growth of two portfolios in percent, and the difference."""
    g = curves.where(F.col("portfolio").isin(strategy, benchmark)).groupBy("portfolio").agg((ratio(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("g"))
    row = g.agg(*(F.max(F.when(F.col("portfolio") == p, F.col("g") * 100)).alias(n) for p, n in ((strategy, "strategy_pct"), (benchmark, "benchmark_pct"))))
    return row.withColumn("outperformance_pct", F.col("strategy_pct") - F.col("benchmark_pct"))


def mad(x: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """Median absolute deviation from the median."""
    m = x.groupBy(key).agg(F.percentile(c, F.lit(0.5)).alias("_m"))
    return x.join(m, key).groupBy(key).agg(F.percentile(F.abs(F.col(c) - F.col("_m")), F.lit(0.5)).alias("mad"))


def capital_curve(trades: DataFrame, capital: float, keys: list[str]) -> DataFrame:
    """Ts and capital plus the running sum of pnl - commission; a trade that is repeated in its keys counts once.

    The running sum goes by ranges of time, so no task gets all times.
    """
    once = trades.groupBy(*keys).agg(F.first("pnl").alias("pnl"), F.first("commission").alias("commission"))
    per = once.groupBy("ts").agg(F.sum(F.col("pnl") - F.col("commission")).alias("net"))
    return running(per, ["ts"], {"_sum": "net"}).select("ts", "net", (F.lit(capital) + F.col("_sum")).alias("capital"))
