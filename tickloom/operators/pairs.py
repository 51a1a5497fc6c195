"""Pair trading: spreads, screens, tests, copulas and held positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import rolling as R
from ..functions import stats
from ..functions.rolling import col, frame, ratio

PAIR = ("sym1", "sym2")


def pair_returns(pair_bars: DataFrame) -> DataFrame:
    """Adds ret1 and ret2, simple returns of both legs."""
    return pair_bars.withColumns({"ret1": R.ret("close1", 1, PAIR), "ret2": R.ret("close2", 1, PAIR)})


def hedge_origin(n: int, end: int = 0) -> Column:
    """Rolling slope through the origin of close1 on close2."""
    w = frame(n, PAIR, end=end)
    return F.when(F.count("close2").over(w) == n, ratio(F.sum(col("close1") * col("close2")).over(w), F.sum(col("close2") * col("close2")).over(w)))


def hedge_ratios(pair_bars: DataFrame) -> DataFrame:
    """Whole-sample hedge ratios without and with an intercept."""
    return pair_bars.groupBy(*PAIR).agg(
        ratio(F.sum(F.col("close1") * F.col("close2")), F.sum(F.col("close2") * F.col("close2"))).alias("beta_origin"),
        F.regr_slope("close1", "close2").alias("beta_ols"),
        F.count("*").alias("n"),
    )


def spreads(beta: str = "beta") -> dict[str, Column]:
    """Difference, beta spread, log spread and ratio of the legs (needs column beta)."""
    pos = (col("close1") > 0) & (col("close2") > 0)
    return {
        "diff": col("close1") - col("close2"), "beta_spread": col("close1") - col(beta) * col("close2"),
        "log_spread": F.when(pos, F.ln("close1") - F.ln("close2")), "price_ratio": ratio(col("close1"), col("close2")),
    }


def spread_zscores(x: DataFrame, n: int = 20) -> DataFrame:
    """Volatility of the log spread and z-score of the ratio."""
    return x.withColumns({"spread_vol": R.std("log_spread", n, key=PAIR), "ratio_z": R.zscore("price_ratio", n, key=PAIR)})


def rolling_beta_zscore(pair_bars: DataFrame, n: int = 72) -> DataFrame:
    """T4: at each bar, from the bars before it: the slope through the origin over n bars, the spread of the last one,
    and its population z-score among the last n such spreads. Two windows over one partitioning."""
    x = pair_bars.withColumn("beta", hedge_origin(n, end=-1))
    x = x.withColumn("spread", R.lag("close1", 1, PAIR) - col("beta") * R.lag("close2", 1, PAIR))
    return x.withColumn("z", R.zscore("spread", n, population=True, key=PAIR))


def screen(pair_bars: DataFrame, n: int = 60, min_corr: float = 0.8, at_least: int = 100) -> DataFrame:
    """T5: mean rolling correlation, spread volatility, mean and deviation of the ratio's z-score; best first."""
    x = pair_returns(pair_bars)
    w = frame(n, PAIR)
    ok = F.count(F.when(col("ret1").isNotNull() & col("ret2").isNotNull(), 1)).over(w) == n
    x = x.withColumns({"corr": F.when(ok, F.corr("ret1", "ret2").over(w)), "price_ratio": ratio(col("close1"), col("close2")), "log_spread": spreads("close1")["log_spread"]})
    x = x.withColumn("z", R.zscore("price_ratio", n, key=PAIR))
    g = x.groupBy(*PAIR).agg(F.avg("corr").alias("mean_corr"), F.stddev_samp("log_spread").alias("spread_vol"), F.avg("z").alias("z_mean"), F.stddev_samp("z").alias("z_std"), F.count("*").alias("n"))
    return g.where((F.col("mean_corr") >= min_corr) & (F.col("n") >= at_least)).orderBy(F.desc("mean_corr"), *PAIR)


def _none(v: float) -> float | None:
    return float(v) if v is not None and np.isfinite(v) else None


def adf_tests(spread: DataFrame, keys: list[str]) -> DataFrame:
    """T, p and lag of the unit-root test of `spread` for each group of keys (a pair, or a pair and a window)."""
    kinds = ", ".join(f"{k} {spread.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ts")["spread"].dropna().to_numpy(float)
        t, p, lag = stats.adf(y)
        return pd.DataFrame([[*key, _none(t), _none(p), lag, len(y)]], columns=[*keys, "t", "p", "lag", "n"])

    return spread.select(*keys, "ts", "spread").groupBy(*keys).applyInPandas(run, f"{kinds}, t double, p double, lag int, n long")


def cointegration(pair_bars: DataFrame) -> DataFrame:
    """T, p and hedge ratio of the Engle-Granger test for each pair; one group is one pair's common bars."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        t, p, b = stats.engle_granger(pdf["close1"].to_numpy(float), pdf["close2"].to_numpy(float))
        return pd.DataFrame([[*key, _none(t), _none(p), _none(b), len(pdf)]], columns=["sym1", "sym2", "t", "p", "beta", "n"])

    return pair_bars.groupBy(*PAIR).applyInPandas(run, "sym1 string, sym2 string, t double, p double, beta double, n long")


def zscore_signal(z: Column, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> Column:
    """Stateless: stop, short, long or close by where z lies; hold between."""
    return F.when(z.isNull(), None).when(F.abs(z) >= stop, "stop").when(z >= enter, "short").when(z <= -enter, "long").when(F.abs(z) <= leave, "close").otherwise("hold")


def fold(z: np.ndarray, p: np.ndarray, enter: float, max_p: float, leave_p: float) -> np.ndarray:
    """-1 above enter, +1 below -enter, kept until z crosses 0 or p gets large."""
    out, s = np.zeros(len(z)), 0
    for i, (a, b) in enumerate(zip(z, p, strict=True)):
        if s and (np.isnan(a) or (s > 0 and a >= 0) or (s < 0 and a <= 0) or b >= leave_p):
            s = 0
        elif not s and not np.isnan(a) and b <= max_p and abs(a) >= enter:
            s = -1 if a > 0 else 1
        out[i] = s
    return out


def held_signal(x: DataFrame, enter: float = 2.0, max_p: float = 0.05, leave_p: float = 0.10) -> DataFrame:
    """Adds `position`, a fold over each pair's ordered bars (z, p)."""
    from pyspark.sql import types as T

    schema = T.StructType(x.schema.fields + [T.StructField("position", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        pdf["position"] = fold(pdf["z"].to_numpy(float), pdf["p"].to_numpy(float), enter, max_p, leave_p)
        return pdf

    return x.groupBy(*PAIR).applyInPandas(run, schema)


def dynamic_thresholds(recent: Column, base: Column, enter: float = 2.0, leave: float = 0.5) -> dict[str, Column]:
    """Thresholds scaled by recent over base volatility, between half and double."""
    k = F.greatest(F.least(F.coalesce(ratio(recent, base), F.lit(1.0)), F.lit(2.0)), F.lit(0.5))
    return {"enter_at": enter * k, "leave_at": leave * k}


def pair_size(capital: float, z: Column, confidence: Column, vol: Column, target: float = 0.02, least: float = 0.01, most: float = 0.1) -> Column:
    """Money for a pair: volatility target over volatility, times confidence and |z| / 2 (up to 1), within bounds."""
    share = F.coalesce(ratio(F.lit(target), vol), F.lit(0.0)) * confidence * F.least(F.abs(z) / 2, F.lit(1.0))
    return capital * F.greatest(F.least(share, F.lit(most)), F.lit(least))


def fit_marginals(returns: DataFrame) -> DataFrame:
    """Df, loc, scale of a t distribution, and the p-value of the fit, per symbol."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["ret"].dropna().to_numpy(float)
        df, loc, scale = stats.fit_t(x)
        d, p = stats.ks(stats.t_cdf(x, df, loc, scale)) if np.isfinite(df) else (np.nan, np.nan)
        return pd.DataFrame([[*key, _none(df), _none(loc), _none(scale), _none(d), _none(p), len(x)]], columns=["symbol", "df", "loc", "scale", "ks", "ks_p", "n"])

    return returns.select("symbol", "ret").groupBy("symbol").applyInPandas(run, "symbol string, df double, loc double, scale double, ks double, ks_p double, n long")


@F.pandas_udf(DoubleType())
def _t_cdf(x: pd.Series, df: pd.Series, loc: pd.Series, scale: pd.Series) -> pd.Series:
    x, p = x.to_numpy(float), np.stack([df.to_numpy(float), loc.to_numpy(float), scale.to_numpy(float)], 1)
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x) & np.isfinite(p).all(1)
    kinds, of = np.unique(p[ok], axis=0, return_inverse=True)  # a batch holds few symbols, so few parameter sets
    at = np.flatnonzero(ok)
    for k, (d, m, s) in enumerate(kinds):
        rows = at[of.reshape(-1) == k]
        out[rows] = stats.t_cdf(x[rows], d, m, s)
    return pd.Series(np.where(np.isfinite(out), out, np.nan)).astype(object).where(np.isfinite(out), None).astype(float)


def to_uniform(pair_ret: DataFrame, marginals: DataFrame) -> DataFrame:
    """u1 and u2, the fitted distribution functions of the legs' returns. marginals are a row a symbol."""
    m = marginals.select("symbol", "df", "loc", "scale")
    x = pair_ret
    for leg in "12":
        x = x.join(m.select(F.col("symbol").alias(f"sym{leg}"), F.col("df").alias("_d"), F.col("loc").alias("_l"), F.col("scale").alias("_s")), f"sym{leg}")
        x = x.withColumn(f"u{leg}", _t_cdf(F.col(f"ret{leg}"), "_d", "_l", "_s")).drop("_d", "_l", "_s")
    return x


def fit_copulas(uniform: DataFrame) -> DataFrame:
    """Theta, psi, log-likelihood and Cramer-von Mises distance per pair (u1, u2)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["u1", "u2"])
        u, v = pdf["u1"].to_numpy(float), pdf["u2"].to_numpy(float)
        if len(u) < 5:
            row = [*key, None, None, None, None, len(u)]
        else:
            t, p, ll = stats.fit_tawn(u, v)
            row = [*key, t, p, ll, stats.cramer_von_mises(u, v, t, p), len(u)]
        return pd.DataFrame([row], columns=["sym1", "sym2", "theta", "psi", "loglik", "cvm", "n"])

    return uniform.select(*PAIR, "u1", "u2").groupBy(*PAIR).applyInPandas(run, "sym1 string, sym2 string, theta double, psi double, loglik double, cvm double, n long")


def tawn_cdf(u: Column, v: Column, theta: Column, psi: Column) -> Column:
    """The type-1 Tawn copula as built-in expressions."""
    lu, lv = F.ln(F.greatest(F.least(u, F.lit(1 - 1e-10)), F.lit(1e-10))), F.ln(F.greatest(F.least(v, F.lit(1 - 1e-10)), F.lit(1e-10)))
    w = lv / (lu + lv)
    a = (1 - psi) * (1 - w) + F.pow(F.pow(psi * (1 - w), theta) + F.pow(w, theta), 1 / theta)
    return F.exp((lu + lv) * a)


def mispricing(u: Column, v: Column, theta: Column, psi: Column, step: float = 1e-5) -> tuple[Column, Column]:
    """h1 = P(U <= u | v) and h2 = P(V <= v | u), central differences of the copula."""
    lim = lambda c: F.greatest(F.least(c, F.lit(1 - 2 * step)), F.lit(2 * step))
    a, b = lim(u), lim(v)
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    h1 = (tawn_cdf(a, b + step, theta, psi) - tawn_cdf(a, b - step, theta, psi)) / (2 * step)
    h2 = (tawn_cdf(a + step, b, theta, psi) - tawn_cdf(a - step, b, theta, psi)) / (2 * step)
    return unit(h1), unit(h2)


@F.pandas_udf(DoubleType())
def gaussian_conditional(u: pd.Series, v: pd.Series, rho: pd.Series) -> pd.Series:
    """P(U <= u | v) under a Gaussian copula, column by column."""
    x, y = stats.normal_quantile(u.to_numpy(float)), stats.normal_quantile(v.to_numpy(float))
    r = np.clip(rho.to_numpy(float), -1 + 1e-9, 1 - 1e-9)
    return pd.Series(stats.normal_cdf((x - r * y) / np.sqrt(1 - r * r)))


def t_conditional(rho: float, df: float):
    """A column function P(U <= u | v) under a t copula, whole columns at once."""

    @F.pandas_udf(DoubleType())
    def run(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(stats.conditional_t(u.to_numpy(float), v.to_numpy(float), rho, df))

    return run


def copula_signal(h1: Column, h2: Column, high: float = 0.95, low: float = 0.05) -> Column:
    """+1: leg 1 is cheap and leg 2 dear; -1: the other way round; 0 else."""
    return F.when(h1.isNull() | h2.isNull(), None).when((h1 <= low) & (h2 >= high), 1).when((h1 >= high) & (h2 <= low), -1).otherwise(0)


def copula_exit(h1: Column, h2: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """Whether both indices are back in the middle."""
    return h1.between(low, high) & h2.between(low, high)


def regimes(returns: DataFrame, states: int = 3) -> DataFrame:
    """Symbol, ts, ret and the most likely hidden state (0: lowest mean) of each symbol's returns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ret"]).sort_values("ts")
        path, _, _ = stats.hmm(pdf["ret"].to_numpy(float), states)
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "ret": pdf["ret"], "regime": path.astype("int32")})

    return returns.select("symbol", "ts", "ret").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, ret double, regime int")


def kappa_spread(pair_bars: DataFrame, n: int = 60) -> DataFrame:
    """z1 - kappa z2 with kappa the ratio of the legs' rolling deviations, limited to [0, 4]."""
    x = pair_bars.withColumns({f"z{i}": R.zscore(f"close{i}", n, key=PAIR) for i in "12"} | {f"_s{i}": R.std(f"close{i}", n, key=PAIR) for i in "12"})
    x = x.withColumn("kappa", F.greatest(F.least(ratio(col("_s1"), col("_s2")), F.lit(4.0)), F.lit(0.0)))
    return x.withColumn("kappa_spread", col("z1") - col("kappa") * col("z2")).drop("_s1", "_s2")


def gated_orders(signals: DataFrame, max_p: float = 0.05, max_vol: float = 0.1, stop: float = 4.0, min_confidence: float = 0.3) -> DataFrame:
    """Two leg orders for each pair signal that passes (signal, z, p, vol1, vol2, beta): confidence is 1 - |z| / stop."""
    x = signals.withColumn("confidence", 1 - F.abs("z") / stop)
    x = x.where((F.col("signal") != 0) & (F.col("p") <= max_p) & (F.col("vol1") <= max_vol) & (F.col("vol2") <= max_vol) & (F.abs("z") < stop) & (F.col("confidence") >= min_confidence))
    legs = F.array(F.struct(F.lit(1).alias("leg"), F.col("sym1").alias("symbol"), F.col("signal").cast("double").alias("side")), F.struct(F.lit(2).alias("leg"), F.col("sym2").alias("symbol"), (-F.col("signal") * F.col("beta")).alias("side")))
    return x.select("sym1", "sym2", "ts", "confidence", F.inline(legs))


def latest(x: DataFrame, key=("symbol",)) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"))
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
