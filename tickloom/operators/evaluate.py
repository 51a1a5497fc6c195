"""Rule sets over long histories: positions, fills, sweeps and folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import col, last_known, ordered, ratio
from . import recursive


def position(enter: Column, leave: Column) -> Column:
    """1 from a bar that enters until one that leaves, else 0; entering wins."""
    event = F.when(enter, 1).when(leave, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def apply_system(bars: DataFrame, capital: float = 10_000.0, shares: float = 1.0) -> DataFrame:
    """From `position` (decided at the close): events, entry at the next open, open and closed equity."""
    held = F.coalesce(F.lag("position").over(ordered()), F.lit(0))
    x = bars.withColumn("held", held).withColumn("_was", F.coalesce(F.lag("held").over(ordered()), F.lit(0)))
    x = x.withColumns({"entry": (col("held") == 1) & (col("_was") == 0), "exit": (col("held") == 0) & (col("_was") == 1)})
    x = x.withColumn("_e", F.when(col("entry"), col("open"))).withColumn("entry_price", last_known("_e"))
    won = F.when(col("exit"), (col("open") - col("entry_price")) * shares).otherwise(0.0)
    x = x.withColumn("trade_pnl", won)
    x = x.withColumn("closed_equity", capital + F.sum("trade_pnl").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    now = F.when(col("held") == 1, (col("close") - col("entry_price")) * shares).otherwise(0.0)
    return x.withColumn("open_equity", col("closed_equity") + now).drop("_was", "_e")


def bracket_fold(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, signal: np.ndarray, tp: float, sl: float) -> tuple[np.ndarray, np.ndarray]:
    """E3 for one symbol: quantity after each bar and running profit of one unit.

    A signal of +1 or -1 fills at the next open; take-profit is checked before stop-loss from the bar of the fill on; an
    opposite signal closes at the next open and turns. Equal signals while in a position change nothing.
    """
    n = len(c)
    qty, pnl, cash, q, entry = np.zeros(n), np.zeros(n), 0.0, 0, 0.0
    for i in range(n):
        s = signal[i - 1] if i else 0
        if s and not np.isnan(s) and s != q and not np.isnan(o[i]):
            if q:
                cash += q * (o[i] - entry)
            q, entry = int(np.sign(s)), o[i]
        if q:
            up, down = entry * (1 + q * tp), entry * (1 - q * sl)
            if (q > 0 and h[i] > up) or (q < 0 and l[i] < up):
                cash, q = cash + q * (up - entry), 0
            elif (q > 0 and l[i] < down) or (q < 0 and h[i] > down):
                cash, q = cash + q * (down - entry), 0
        qty[i], pnl[i] = q, cash + (q * (c[i] - entry) if q else 0.0)
    return qty, pnl


def bracket_run(bars: DataFrame, tp: float = 0.03, sl: float = 0.02) -> DataFrame:
    """Adds qty and pnl from column `signal`, per symbol."""

    def run(p: pd.DataFrame) -> dict[str, np.ndarray]:
        q, v = bracket_fold(*(p[k].to_numpy(float) for k in ("open", "high", "low", "close", "signal")), tp, sl)
        return {"qty": q, "pnl": v}

    return recursive.per_symbol(bars, ["qty", "pnl"], run)


def wallet(bars: DataFrame, capital: float = 1_000.0) -> DataFrame:
    """Final balance of a wallet that buys all in on BUY and sells all on SELL, with a forced sale at the end.

    Signals that repeat the last action do nothing, so trades alternate: a purchase's exit is the next sale or the
    last bar, and the balance is the product of exits over entries.
    """
    x = bars.where("action in ('BUY', 'SELL') and close > 0")
    x = x.withColumn("_p", F.lag("action").over(ordered())).where("_p is null or _p <> action")
    x = x.withColumn("_next", F.lead("close").over(ordered())).where("action = 'BUY'")
    end = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("_end"))
    x = end.join(x.select("symbol", "close", "_next"), "symbol", "left")
    r = F.when(F.col("close").isNotNull(), F.coalesce("_next", "_end") / F.col("close")).otherwise(1.0)
    return x.groupBy("symbol").agg((F.product(r) * capital).alias("balance"), F.count("close").alias("n_buys"))


def sweep(bars: DataFrame, grid: DataFrame, capital: float = 1_000.0) -> DataFrame:
    """E5: final balance of the average-and-RSI rule for every symbol and parameter set (short, long, rsi).

    A group is a symbol and a block of the grid, the sets of one short length: its averages are computed once for each distinct
    length and shared by the block. The grid is a small stated table, and bars are dealt once for each block.
    """
    blocks: dict[int, list[tuple[int, int, int]]] = {}
    for r in grid.select("short", "long", "rsi").distinct().orderBy("short", "long", "rsi").collect():
        blocks.setdefault(r["short"], []).append(tuple(r))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets, key = blocks[key[1]], key[:1]
        c = pdf.sort_values("ts")["close"].to_numpy(float)
        s = pd.Series(c)
        sma = {n: s.rolling(n).mean().to_numpy() for n in {x for a, b, _ in sets for x in (a, b)}}
        rsi = {n: recursive.rsi_wilder(c, n) for n in {x for _, _, x in sets}}
        out = []
        for a, b, r in sets:
            buy, sell = (sma[a] < sma[b]) & (rsi[r] < 30), (sma[a] > sma[b]) & (rsi[r] > 70)
            money, units, n = capital, 0.0, 0
            for i in np.flatnonzero((buy | sell) & (c > 0)):
                if buy[i] and money > 0:
                    units, money, n = money / c[i], 0.0, n + 1
                elif sell[i] and units > 0:
                    money, units = units * c[i], 0.0
            out.append((*key, a, b, r, money + units * c[-1], n))
        return pd.DataFrame(out, columns=["symbol", "short", "long", "rsi", "balance", "n_buys"])

    x = bars.select("symbol", "ts", "close", F.explode(F.array(*map(F.lit, blocks)).cast("array<int>")).alias("block"))
    return x.groupBy("symbol", "block").applyInPandas(run, "symbol string, short int, long int, rsi int, balance double, n_buys int")


def pair_fold(p1: np.ndarray, p2: np.ndarray, beta: np.ndarray, signal: np.ndarray, capital: float, rate: float, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E10 for one pair: position, portfolio value and commission of each bar.

    Legs are sized 1 : |beta| of the money; a position ends by the stop, or when the signal leaves it. After a stop the
    same side isn't taken again until another side was.
    """
    n = len(p1)
    pos, value, fee = np.zeros(n), np.full(n, capital), np.zeros(n)
    v, side, u1, u2, e1, e2, base, barred = capital, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
    for i in range(n):
        s = 0 if np.isnan(signal[i]) else int(signal[i])
        if not side and s and s != barred and np.isfinite(beta[i]) and beta[i] != 0 and p1[i] > 0 and p2[i] > 0:
            side, barred, e1, e2, base = s, 0, p1[i], p2[i], v
            c1 = v / (1 + abs(beta[i]))
            u1, u2 = side * c1 / e1 * np.sign(beta[i]), -side * (v - c1) / e2 * np.sign(beta[i])
            fee[i] = (abs(u1) * e1 + abs(u2) * e2) * rate
        elif side:
            gain = u1 * (p1[i] - e1) + u2 * (p2[i] - e2)
            v = base + gain
            stopped = -gain > stop * (abs(u1) * e1 + abs(u2) * e2)
            if stopped or s != side:
                fee[i] = (abs(u1) * p1[i] + abs(u2) * p2[i]) * rate
                barred, side = (side if stopped else barred), 0
        pos[i], value[i] = side, v
    return pos, value, fee


def pair_run(x: DataFrame, capital: float = 10_000.0, rate: float = 0.0004, stop: float = 0.05) -> DataFrame:
    """Adds held, value and commission to (sym1, sym2, ts, close1, close2, beta, position); value is before commission."""
    schema = T.StructType(x.schema.fields + [T.StructField(n, T.DoubleType()) for n in ("held", "value", "commission")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        pdf["held"], pdf["value"], pdf["commission"] = pair_fold(*(pdf[k].to_numpy(float) for k in ("close1", "close2", "beta", "position")), capital, rate, stop)
        return pdf

    return x.groupBy("sym1", "sym2").applyInPandas(run, schema)


def hysteresis(score: np.ndarray, enter: float = 0.3, leave: float = 0.1) -> np.ndarray:
    """1 above `enter`, -1 below -enter; a state is kept until the score falls inside `leave`, then 0."""
    out, s = np.zeros(len(score)), 0
    for i, v in enumerate(score):
        if np.isnan(v):
            out[i] = s
            continue
        if s > 0 and v < leave or s < 0 and v > -leave:
            s = 0
        if s == 0:
            s = 1 if v >= enter else -1 if v <= -enter else 0
        out[i] = s
    return out


def regime_with_hysteresis(x: DataFrame, enter: float = 0.3, leave: float = 0.1) -> DataFrame:
    """Adds `regime` from column score, per symbol."""
    return recursive.per_symbol(x, ["regime"], lambda p: {"regime": hysteresis(p["score"].to_numpy(float), enter, leave)})


def final_growth(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg((ratio(F.max_by("close", "ts"), F.min_by("close", "ts")) - 1).alias("growth"))
