"""Fixed schemas of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR = "timestamp LONG, datetime STRING, up BOOLEAN, change DOUBLE"
BAR_OHLCV = BAR + ", open DOUBLE, close DOUBLE, volume DOUBLE, qvol DOUBLE"
BAR_FLOW = BAR + ", vol DOUBLE, ntr INT, tbv DOUBLE, qvol DOUBLE"
PERP_BAR = BAR + ", close DOUBLE"
FUNDING = "fundingTime LONG, fundingRate DOUBLE"
FORCED_BAR = "timestamp LONG, sell_notional DOUBLE, sell_n LONG, buy_notional DOUBLE, buy_n LONG"
SIDE_CANDLE = "timestamp LONG, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"
OOS = "asset STRING, cls STRING, ts LONG, actual TINYINT, p_ising FLOAT, p_free FLOAT"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns: engines sort and aggregate NaN as the largest number."""
    out = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*out)
