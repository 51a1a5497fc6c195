"""Top-k choices, portfolio construction, books and ledgers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ratio, ret
from .prefix import running


def top_pairs(tests: DataFrame, n: int, ascending: bool = True) -> DataFrame:
    """K1: the n pairs with the smallest (or largest) t statistic."""
    return tests.orderBy(F.col("t").asc() if ascending else F.col("t").desc(), "sym1", "sym2").limit(n)


def least_correlated(corr: DataFrame, seed: str, k: int) -> DataFrame:
    """K2: the seed and the k - 1 symbols least correlated with it. corr: symbol, corr."""
    rest = corr.where(F.col("symbol") != seed).orderBy("corr", "symbol").limit(k - 1).select("symbol", "corr")
    return rest.unionByName(corr.sparkSession.createDataFrame([(seed, 1.0)], "symbol string, corr double"))


def factor_score(x: DataFrame, weights: dict[str, tuple[float, bool]]) -> DataFrame:
    """K3: score: weighted sum of columns ranked to [0, 1] within their sector; weights: column -> (weight, higher is better)."""
    part = None
    for c, (w, up) in weights.items():
        r = F.percent_rank().over(Window.partitionBy("sector").orderBy(F.col(c).asc() if up else F.col(c).desc()))
        part = w * r if part is None else part + w * r
    return x.withColumn("score", part)


def pick_per_sector(x: DataFrame, m: int, budget: float, commission: float = 0.001) -> DataFrame:
    """K3: the m best of each sector, equal money each, whole shares and their commission."""
    w = Window.partitionBy("sector").orderBy(F.desc("score"), "symbol")
    x = x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)
    each = budget / F.count("*").over(Window.partitionBy())
    x = x.withColumn("shares", F.coalesce(F.floor(ratio(each, F.col("price"))), F.lit(0)))
    return x.withColumn("commission", F.col("shares") * F.col("price") * commission)


def best_parameters(runs: DataFrame, params: list[str], key: str = "symbol") -> DataFrame:
    """K4: the parameters with the largest final balance per key; ties go to the larger parameters."""
    return runs.groupBy(key).agg(F.max(F.struct("balance", *params)).alias("b")).select(key, "b.*")


def best_rows(frontier: DataFrame) -> DataFrame:
    """K5: the rows of the largest Sharpe ratio and the least volatility, with `pick`."""
    x = frontier.agg(F.max_by("id", F.struct("sharpe", -F.col("id"))).alias("max_sharpe"), F.min_by("id", F.struct("vol", "id")).alias("min_vol"))
    x = x.select(F.expr("stack(2, 'max_sharpe', max_sharpe, 'min_vol', min_vol) as (pick, id)"))
    return frontier.join(F.broadcast(x), "id")  # two rows


def rank_signals(signals: DataFrame, max_allocation: float, capital: float) -> DataFrame:
    """K6: per ts the most confident signals, int(1 / max_allocation) at most, equal and capped allocation, quantity at price."""
    w = Window.partitionBy("ts")
    most = int(1 / max_allocation)
    x = signals.where("signal <> 0")
    x = x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "symbol"))).withColumn("n", F.least(F.count("*").over(w), F.lit(most)))
    x = x.where(F.col("rank") <= F.col("n")).withColumn("allocation", F.least(F.lit(max_allocation), 1.0 / F.col("n")) * capital)
    return x.withColumn("qty", ratio(F.col("allocation"), F.col("price")) * F.signum("signal"))


def leg_quantities(x: DataFrame, budget: float) -> DataFrame:
    """Whole quantities of both legs: the budget is split so that qty2 = -beta * qty1 (price1, price2, beta, side)."""
    cost = F.col("price1") + F.abs("beta") * F.col("price2")
    q = F.floor(ratio(F.lit(budget), cost))
    return x.withColumns({"qty1": F.signum("side") * q, "qty2": -F.signum("side") * F.floor(q * F.col("beta"))})


def net_orders(legs: DataFrame, rate: float = 0.0004) -> DataFrame:
    """Net quantity per symbol over all pairs, with commission on what is traded (symbol, qty, price)."""
    x = legs.groupBy("symbol").agg(F.sum("qty").alias("qty"), F.max("price").alias("price"))
    return x.where("qty <> 0").withColumn("commission", F.abs(F.col("qty") * F.col("price")) * rate)


def frontier(spark, mean: list[float], cov: list[list[float]], n: int = 50_000, seed: int = 36, risk_free: float = 0.0) -> DataFrame:
    """Id, ret, vol, sharpe and weights of n random long-only portfolios. A weight follows from (seed, id, asset) alone.

    mean and cov belong to a stated set of assets; rows are made where they are used, without a shuffle.
    """
    k = len(mean)
    u = [(F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(i)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1) for i in range(k)]
    x = spark.range(n).select("id", *(c.alias(f"u{i}") for i, c in enumerate(u)))
    total = sum((F.col(f"u{i}") for i in range(1, k)), F.col("u0"))
    x = x.select("id", F.array(*(F.col(f"u{i}") / total for i in range(k))).alias("weights"))
    w = [F.get("weights", F.lit(i)) for i in range(k)]
    r = sum((w[i] * float(mean[i]) for i in range(1, k)), w[0] * float(mean[0]))
    v = sum((w[i] * w[j] * float(cov[i][j]) for i in range(k) for j in range(k)), F.lit(0.0))
    x = x.withColumns({"ret": r, "vol": F.sqrt(v)})
    return x.withColumn("sharpe", ratio(F.col("ret") - risk_free, F.col("vol")))


def asset_moments(returns: DataFrame, per_year: float = 252.0, exact: str = "ret") -> DataFrame:
    """One row with symbols, mean and cov (row after row) of annualised returns (symbol, ts, ret) of a stated set of assets.

    Covariances are those of the times that two assets share; pairs without two of them count as uncorrelated. exact: a column with the same
    returns as decimals, if there is one. Means are sums of decimals of 18 places, so they don't depend on the order of rows and ties of
    their digits stay ties; where a return doesn't fit these, they are sums of doubles.
    """
    from .gram import covariances

    c = covariances(returns, per_year=per_year).select("sym1", "sym2", F.coalesce("cov", F.lit(0.0)).alias("cov"))
    c = c.union(c.where("sym1 <> sym2").select("sym2", "sym1", "cov"))
    d = F.col(exact).try_cast("decimal(28, 18)")
    total = F.sum(d * F.lit(per_year).cast("decimal(8, 2)")) / F.count(d) if round(per_year, 2) == per_year < 1e6 else None
    mean = F.avg("ret") * per_year if total is None else F.when(F.count(d) < F.count("ret"), F.avg("ret") * per_year).when(F.count(d) > 0, total.cast("double"))
    mean = returns.groupBy("symbol").agg(mean.alias("mean"))
    names = mean.agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))  # one row
    rows = c.groupBy("sym1").agg(F.map_from_entries(F.collect_list(F.struct("sym2", "cov"))).alias("of"))
    rows = mean.join(rows, F.col("symbol") == F.col("sym1"), "left").join(F.broadcast(names))
    row = F.expr("transform(symbols, s -> coalesce(of[s], 0D))")
    one = rows.select("symbol", "mean", row.alias("row")).agg(F.array_sort(F.collect_list(F.struct("symbol", "mean", "row"))).alias("m"))
    return one.select(F.col("m.symbol").alias("symbols"), F.col("m.mean").alias("mean"), F.flatten("m.row").alias("cov"))


def frontier_of(moments: DataFrame, n: int = 50_000, seed: int = 36, risk_free: float = 0.0, block: int = 1000) -> DataFrame:
    """As frontier(), for the assets of asset_moments(); nothing comes to the driver.

    Weights are an array column; a block of portfolios meets the one row of moments and is one matrix product.
    """
    u = F.expr(f"transform(sequence(0, k - 1), i -> (pmod(xxhash64({seed}, id, i), {1 << 40}L) + 1) / CAST({(1 << 40) + 1} AS DOUBLE))")
    x = moments.sparkSession.range(n).join(F.broadcast(moments.select(F.size("mean").alias("k")).where("k > 0"))).select("id", u.alias("u"))  # one row
    x = x.select("id", F.expr("transform(u, v -> v / aggregate(u, 0D, (a, b) -> a + b))").alias("weights"))
    x = x.groupBy(F.expr(f"id div {block}").alias("block")).agg(F.collect_list(F.struct("id", "weights")).alias("p")).select(F.col("p.id").alias("id"), F.col("p.weights").alias("weights"))

    def run(frames):
        for p in frames:
            for ids, weights, mean, cov in zip(p["id"], p["weights"], p["mean"], p["cov"], strict=True):
                w, m = np.stack([np.asarray(v, float) for v in weights]), np.asarray(mean, float)
                c = np.asarray(cov, float).reshape(len(m), len(m))
                r = w @ m
                yield pd.DataFrame({"id": np.asarray(ids), "weights": list(w), "ret": r, "vol": np.sqrt(np.maximum(((w @ c) * w).sum(1), 0.0))})

    x = x.join(F.broadcast(moments.select("mean", "cov"))).mapInPandas(run, "id long, weights array<double>, ret double, vol double")  # one row of moments
    return x.withColumn("sharpe", ratio(F.col("ret") - risk_free, F.col("vol")))


def shape_weights(x: DataFrame, cap: float = 0.3) -> DataFrame:
    """Weight * scale, capped, floored at 0 and renormalised per ts (equal if all are 0)."""
    w = Window.partitionBy("ts")
    x = x.withColumn("_w", F.greatest(F.least(F.col("weight") * F.col("scale"), F.lit(cap)), F.lit(0.0)))
    return x.withColumn("weight", F.coalesce(ratio(F.col("_w"), F.sum("_w").over(w)), 1 / F.count("*").over(w))).drop("_w")


def filter_trades(x: DataFrame, min_weight: float = 0.01, min_value: float = 10.0) -> DataFrame:
    """`trade` where weight and value change enough (weight, old_weight, equity); the traded weights are renormalised."""
    w = Window.partitionBy("ts")
    d = F.abs(F.col("weight") - F.col("old_weight"))
    x = x.withColumn("trade", (d >= min_weight) & (d * F.col("equity") >= min_value))
    kept = F.when(~F.col("trade"), F.col("old_weight")).otherwise(0.0)
    free = 1 - F.sum(kept).over(w)
    total = F.sum(F.when(F.col("trade"), F.col("weight")).otherwise(0.0)).over(w)
    return x.withColumn("new_weight", F.when(F.col("trade"), F.coalesce(ratio(F.col("weight") * F.greatest(free, F.lit(0.0)), total), F.lit(0.0))).otherwise(F.col("old_weight")))


def rebalance_orders(x: DataFrame, keys: list[str] = ["portfolio", "ts"]) -> DataFrame:  # noqa: B006
    """Value changes to reach the targets; buys are scaled to the cash that is there plus what sells bring (target, value, cash)."""
    w = Window.partitionBy(*keys)
    x = x.withColumn("delta", F.col("target") - F.col("value"))
    money = F.col("cash") - F.sum(F.least("delta", F.lit(0.0))).over(w)
    scale = F.least(F.lit(1.0), F.coalesce(ratio(F.greatest(money, F.lit(0.0)), F.sum(F.greatest("delta", F.lit(0.0))).over(w)), F.lit(1.0)))
    return x.withColumn("order_value", F.when(F.col("delta") > 0, F.col("delta") * scale).otherwise(F.col("delta")))


def slippage(qty: Column, volume: Column, price: Column, impact: float = 0.1, most: float = 0.025) -> Column:
    """Fill price: moved by impact * (share of volume, capped) squared against the order."""
    share = F.least(F.coalesce(ratio(F.abs(qty), volume), F.lit(most)), F.lit(most))
    return price * (1 + F.signum(qty) * impact * share * share)


def commission(value: Column, rate: float = 0.001, least: float = 1.0, most: float = 50.0) -> Column:
    """A rate on the value between a least and a most amount."""
    return F.least(F.greatest(F.abs(value) * rate, F.lit(least)), F.lit(most))


def rebalance_flags(x: DataFrame, threshold: float = 0.05, every: int = 20, keys: list[str] = ["portfolio"]) -> DataFrame:  # noqa: B006
    """Per ts whether the largest drift of weight from target exceeds the threshold, and whether it is a k-th bar."""
    g = x.groupBy(*keys, "ts").agg(F.max(F.abs(F.col("weight") - F.col("target_weight"))).alias("drift"))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1
    return g.withColumns({"by_threshold": F.col("drift") > threshold, "by_period": i % every == 0})


def beta_neutral(x: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """Long RSI < low (low - rsi), short RSI > high (high - rsi); longs scaled so that betas cancel; weights sum to 1 in size per ts."""
    w = Window.partitionBy("ts")
    q = F.when(F.col("rsi") < low, low - F.col("rsi")).when(F.col("rsi") > high, high - F.col("rsi")).otherwise(0.0)
    x = x.withColumn("_q", q)
    bl = F.sum(F.when(F.col("_q") > 0, F.col("_q") * F.col("beta")).otherwise(0.0)).over(w)
    bs = F.sum(F.when(F.col("_q") < 0, F.col("_q") * F.col("beta")).otherwise(0.0)).over(w)
    x = x.withColumn("_q", F.when(F.col("_q") > 0, F.col("_q") * F.coalesce(F.greatest(ratio(-bs, bl), F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_q")))
    return x.withColumn("weight", F.coalesce(ratio(F.col("_q"), F.sum(F.abs("_q")).over(w)), F.lit(0.0))).drop("_q")


def premium(bars: DataFrame, finals: DataFrame, capital: float) -> DataFrame:
    """Annualised growth of a strategy's final balance over buying and holding, by hours. finals: symbol, balance."""
    g = bars.groupBy("symbol").agg(
        ratio(F.max_by("close", "ts"), F.min_by("close", "ts")).alias("hold"),
        (F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600).alias("hours"),
    )
    years = 8760.0 / F.nullif(F.col("hours"), F.lit(0.0))
    x = g.join(finals, "symbol").withColumns({"hold_year": F.pow("hold", years) - 1, "run_year": F.pow(F.col("balance") / capital, years) - 1})
    return x.withColumn("premium", F.col("run_year") - F.col("hold_year"))


def book(bars: DataFrame, weights: DataFrame, capital: float) -> DataFrame:
    """Ts, value, pnl, ret and cum_ret of shares that are bought at the first close. weights: symbol, weight."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("_p")).join(weights, "symbol")
    shares = first.select("symbol", F.coalesce(ratio(F.col("weight") * capital, F.col("_p")), F.lit(0.0)).alias("shares"))
    x = bars.join(shares, "symbol").groupBy("ts").agg(F.sum(F.col("shares") * F.col("close")).alias("value"))
    x = running(x, ["ts"], {}, {"_prev": "value"})
    start = x.agg(F.min_by("value", "ts").alias("_start"))
    x = x.join(F.broadcast(start)).withColumns({"pnl": F.col("value") - F.col("_prev"), "ret": ratio(F.col("value"), F.col("_prev")) - 1})  # one row
    return x.withColumn("cum_ret", ratio(F.col("value"), F.col("_start")) - 1).drop("_prev", "_start")


def position_weights(positions: DataFrame) -> DataFrame:
    """Value and share of the total per ts (ts, symbol, qty, price)."""
    x = positions.withColumn("value", F.col("qty") * F.col("price"))
    return x.withColumn("weight", ratio(F.col("value"), F.sum("value").over(Window.partitionBy("ts"))))


def ledger_equity(ledger: DataFrame, capital: float, key: str = "portfolio") -> DataFrame:
    """Per (key, ts) cash and equity: running cash flows plus the running quantity of each symbol at its last traded price.

    What changes at a time is summed before the running sums, so a day is one row per symbol and then one per portfolio.
    """
    w = Window.partitionBy(key, "symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    day = ledger.groupBy(key, "symbol", "ts").agg(F.sum("qty").alias("qty"), F.sum(-F.col("qty") * F.col("price") - F.col("commission")).alias("flow"), F.max("price").alias("price"))
    x = day.withColumn("mark", F.sum("qty").over(w) * F.col("price"))
    x = x.withColumn("step", F.col("mark") - F.coalesce(F.lag("mark").over(Window.partitionBy(key, "symbol").orderBy("ts")), F.lit(0)))
    per = x.groupBy(key, "ts").agg(F.sum("flow").alias("flow"), F.sum("step").alias("step"))
    run = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"cash": capital + F.sum("flow").over(run), "market_value": F.sum("step").over(run)})
    return per.select(key, "ts", "cash", "market_value", (F.col("cash") + F.col("market_value")).alias("equity"))


def with_return(curve: DataFrame, key: str = "portfolio") -> DataFrame:
    return curve.withColumn("ret", ret("equity", 1, (key,)))


def minimum_variance(cov: DataFrame) -> DataFrame:
    """Closed-form minimum-variance weights of each book (book, sym1, sym2, cov), and its target risk."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["sym1"]) | set(pdf["sym2"]))
        at = {n: i for i, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf["sym1"], pdf["sym2"], pdf["cov"], strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = c
        w = np.linalg.pinv(m) @ np.ones(len(names))
        w = w / w.sum()
        e = np.full(len(names), 1 / len(names))
        risk = (np.sqrt(w @ m @ w) + np.sqrt(e @ m @ e)) / 2
        return pd.DataFrame({"book": key[0], "symbol": names, "weight": w, "target_risk": risk})

    return cov.groupBy("book").applyInPandas(run, "book string, symbol string, weight double, target_risk double")
