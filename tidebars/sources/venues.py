"""Candles of trading venues, each in its own shape, as rows of one: (venue, symbol, ts, open, high, low, close, volume).

A venue's candle is an array of texts or numbers. Fixed values: at which place it has what, and how many units of its time
make a second.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of (time, open, high, low, close, volume), and units of time a second.
VENUES: dict[str, tuple[tuple[int, int, int, int, int, int], int]] = {
    "binance": ((0, 1, 2, 3, 4, 5), 1000),
    "bybit": ((0, 1, 2, 3, 4, 5), 1000),
    "coinbase": ((0, 3, 2, 1, 4, 5), 1),
    "okx": ((0, 1, 2, 3, 4, 5), 1000),
}


def candles(raw: DataFrame, venue: str) -> DataFrame:
    """The rows of ``raw`` (symbol, candle: array<string>) of one venue. What is missing or no number is null; a candle without
    time is left out."""
    places, units = VENUES[venue]
    at = lambda i: F.expr(f"try_cast(get(candle, {i}) as double)")
    names = ("ts", "open", "high", "low", "close", "volume")
    out = raw.select(F.lit(venue).alias("venue"), "symbol", *(at(i).alias(n) for i, n in zip(places, names)))
    return out.where("ts is not null").withColumn("ts", F.floor(F.col("ts") / units))


def all_candles(raw: dict[str, DataFrame]) -> DataFrame:
    """Candles of several venues, all that there are."""
    return reduce(lambda a, b: a.unionByName(b), (candles(df, venue) for venue, df in sorted(raw.items())))


def batches(symbols: list[str], size: int = 40) -> list[list[str]]:
    """Symbols as a broker takes them: so many a request, in order, each once."""
    once = list(dict.fromkeys(symbols))
    return [once[i : i + size] for i in range(0, len(once), size)]


def long_enough(bars: DataFrame, least: int = 5000) -> DataFrame:
    """The rows of the symbols that have ``least`` of them."""
    good = bars.groupBy("symbol").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("symbol")
    return bars.join(good, "symbol", "left_semi")
