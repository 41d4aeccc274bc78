"""Series derived from the session's tables, each as a plan and as SQL: ticks are events, a series is an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions.scalar import num, sigmoid
from tidebars.operators import bars as B
from tidebars.operators.series import along, kernel_field, positioned, power_law
from tidebars.plans.catalog import Tables


def bars(t: Tables, seconds: int = 3600, offset: int = 0) -> DataFrame:
    return B.tick_bars(t.events, "event_type", "value", ["ts"], seconds, offset=offset, buy=F.col("user_id") % 2 == 0)


def bars_sql(seconds: int = 3600, name: str = "bars", offset: int = 0) -> str:
    return f"""{name} AS (SELECT *, slot * {seconds} + {offset} AS ts, CASE WHEN open <> 0 THEN (close - open) / open ELSE 0 END AS change, close > open AS up FROM (
        SELECT event_type AS asset, CAST(floor((epoch(ts) - {offset}) / {seconds}) AS BIGINT) AS slot, arg_min(value, ts) AS open, arg_max(value, ts) AS close,
        sum(value) AS vol, count(*) AS ntr, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS tbv FROM events GROUP BY 1, 2) AS b_)"""


H = bars_sql()


def days(t: Tables) -> DataFrame:
    """Daily bars of order prices by priority, with positions: (asset, slot, pos, n, open, close, change, y)."""
    o = t.orders.withColumn("slot", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"))
    b = o.groupBy(F.col("o_orderpriority").alias("asset"), "slot").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    b = b.withColumn("change", (F.col("close") - F.col("open")) / F.col("open")).withColumn("y", (F.col("close") > F.col("open")).cast("int"))
    return positioned(b)


DAYS = """days AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY slot) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n FROM (
    SELECT asset, slot, open, close, (close - open) / open AS change, CAST(close > open AS INTEGER) AS y FROM (
    SELECT o_orderpriority AS asset, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS slot, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close
    FROM orders GROUP BY 1, 2) AS d0_) AS d_)"""


def scored(t: Tables) -> DataFrame:
    """Hourly bars with a forecast from the 12 signs before: (asset, slot, pos, n, change, y, p)."""
    b = bars(t).select("asset", "slot", "change", F.col("up").cast("int").alias("y"), F.signum("change").alias("s"))
    field = kernel_field(F.col("s"), power_law(12, 1.0), along())
    return positioned(b.withColumn("p", F.round(sigmoid(field * num(-0.3)), 3))).drop("s")


def lag_sql(x: str, k: int, part: str = "asset", order: str = "slot") -> str:
    return f"coalesce(lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order}), 0)"


def field_sql(x: str, n: int = 12, alpha: float = 1.0) -> str:
    return "(" + " + ".join(f"{k**-alpha!r} * {lag_sql(x, k)}" for k in range(1, n + 1)) + ")"


SCORED = f"""{H}, scored AS (SELECT asset, slot, row_number() OVER (PARTITION BY asset ORDER BY slot) - 1 AS pos, count(*) OVER (PARTITION BY asset) AS n, change,
    CAST(up AS INTEGER) AS y, round(1 / (1 + exp(0.3 * {field_sql("CAST(sign(change) AS DOUBLE)")})), 3) AS p FROM bars)"""
