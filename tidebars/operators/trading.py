"""Trading rules on forecasts: projections, running windows and conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.scalar import num
from tidebars.operators.series import along, equity, positioned


def even_money(p: Column, y: Column, tau: Column, fee: float = 0.0) -> Column:
    """+-1 less a fee for a bet on the side of p, 0 where |p - 0.5| < tau."""
    right = (p > 0.5) == (y == 1)
    return F.when(F.abs(p - num(0.5)) >= tau, F.when(right, num(1)).otherwise(num(-1)) - num(fee)).otherwise(num(0))


def even_money_summary(rows: DataFrame, tau: float, fee: float = 0.0) -> DataFrame:
    """(asset, n_bets, pnl, max_drawdown, sharpe) of betting along each series."""
    rows = rows.withColumn("pnl", even_money(F.col("p"), F.col("y"), num(tau), fee))
    out = equity(rows, "pnl", along(order="pos"))
    sd = F.stddev_pop("pnl")
    return out.groupBy("asset").agg(
        F.count(F.when(F.abs(F.col("p") - num(0.5)) >= tau, 1)).alias("n_bets"), F.sum("pnl").alias("total"), F.max("drawdown").alias("max_drawdown"),
        F.when(sd > 0, F.avg("pnl") / sd).otherwise(num(0)).alias("sharpe"),
    )


def best_tau(rows: DataFrame, taus: list[float], least: int = 20, fee: float = 0.0) -> DataFrame:
    """(asset, tau, n_bets, pnl): the threshold that earned most a bet in the first half (ties to the smaller, at least
    ``least`` bets), and what it earns in the second."""
    half = positioned(rows.drop("pos", "n"), order="slot").withColumn("first", F.col("pos") < F.floor(F.col("n") / 2))
    each = half.withColumn("tau", F.explode(F.array(*map(num, taus))))
    each = each.withColumn("pnl", even_money(F.col("p"), F.col("y"), F.col("tau"), fee)).withColumn("bet", (F.abs(F.col("p") - num(0.5)) >= F.col("tau")).cast("int"))
    sums = each.groupBy("asset", "tau").agg(
        *(F.sum(F.when(F.col("first") == on, F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, on in ((1, True), (2, False)) for c in ("pnl", "bet"))
    )
    good = sums.where(F.col("bet1") >= least).withColumn("rate", F.round(F.col("pnl1") / F.col("bet1"), 9))
    best = good.groupBy("asset").agg(F.max_by(F.struct("tau", "bet2", "pnl2"), F.struct("rate", -F.col("tau"))).alias("b"))
    return best.select("asset", "b.tau", F.col("b.bet2").cast("long").alias("n_bets"), F.col("b.pnl2").alias("pnl"))


def kelly(rows: DataFrame, rho: float, spread: float = 0.02, fraction: float = 0.25, cap: float = 0.05, edge: float = 0.01) -> DataFrame:
    """Adds price, stake and ret: a fractional-Kelly bet against a market price 0.5 + rho (ref - 0.5).

    Buys YES at the ask if p is ``edge`` above it, NO if it is as far below the bid; NO wins where both hold.
    """
    price = num(0.5) + num(rho) * (F.col("ref") - num(0.5))
    ask, bid = price + num(spread / 2), price - num(spread / 2)
    p = F.col("p")
    yes, no = p - ask > edge, bid - p > edge
    size = lambda win, cost: F.least(F.greatest(num(fraction) * (win - cost) / (num(1) - cost), num(0)), num(cap))
    stake = F.when(no, size(num(1) - p, num(1) - bid)).when(yes, size(p, ask)).otherwise(num(0))
    won = F.when(no, F.when(F.col("y") == 0, bid / (num(1) - bid)).otherwise(num(-1))).when(yes, F.when(F.col("y") == 1, (num(1) - ask) / ask).otherwise(num(-1))).otherwise(num(0))
    return rows.withColumn("price", price).withColumn("stake", stake).withColumn("ret", stake * won)
