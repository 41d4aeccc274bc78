"""Scalar functions as column expressions: all of them run inside whole-stage code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x: float) -> Column:
    """A double literal (a bare decimal literal would make decimal results)."""
    return F.lit(float(x))


def spin(r: Column, scale: float = 150.0) -> Column:
    """Soft spin tanh(scale r); the sign where ``scale`` is not positive."""
    return F.tanh(r * num(scale)) if scale > 0 else F.signum(r)


def sigmoid(x: Column) -> Column:
    """Logistic function of x clipped to +-60."""
    return num(1) / (num(1) + F.exp(-F.least(F.greatest(x, num(-60)), num(60))))


def log_loss(y: Column, p: Column, clip: float = 1e-15) -> Column:
    """Negative log-likelihood of one label."""
    q = F.least(F.greatest(p, num(clip)), num(1 - clip))
    return -(y * F.ln(q) + (num(1) - y) * F.ln(num(1) - q))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is positive."""
    return F.when(b > 0, a / b)


def corr(x: str | Column, y: str | Column) -> Column:
    """Correlation as an aggregate; null where either side does not vary."""
    both = lambda a, b: F.when(b.isNotNull(), a)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x)))


def imbalance(taker_buy: Column, volume: Column) -> Column:
    """2 buy / volume - 1 in [-1, 1]; null for no volume."""
    return num(2) * ratio(taker_buy, volume) - num(1)


def simple_return(open_: Column, close: Column) -> Column:
    """(close - open) / open, 0 where open is 0."""
    return F.when(open_ != 0, (close - open_) / open_).otherwise(num(0))


def move_side(change: Column, ask: Column, bid: Column) -> Column:
    """The ask side after a rise, the bid side after a fall, null on a flat bar."""
    return F.when(change > 0, ask).when(change < 0, bid)


def consumption(first: Column, last: Column) -> Column:
    """ln(first / last) of a book side; null unless both are positive."""
    return F.when((first > 0) & (last > 0), F.ln(first / last))


def alignment(change: Column, with_up: Column, with_down: Column) -> Column:
    """Forced flow that goes along with the bar's move; 0 on a flat bar."""
    return F.when(change > 0, with_up).when(change < 0, with_down).otherwise(num(0))


def chi2_survival(x: Column, dof: int) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom, in closed form."""
    if dof % 2:
        raise ValueError("the closed form needs an even number of degrees of freedom")
    half, term, total = x / num(2), num(1), num(1)
    for i in range(1, dof // 2):
        term = term * half / num(i)
        total = total + term
    return F.exp(-half) * total


def student_t_p(t: Column, dof: int) -> Column:
    """Two-sided p-value of Student's t for an even number of degrees of freedom, as a finite sum."""
    if dof % 2:
        raise ValueError("the closed form needs an even number of degrees of freedom")
    s2 = num(dof) / (num(dof) + t * t)
    term, total = num(1), num(1)
    for i in range(1, dof // 2):
        term = term * s2 * num((2 * i - 1) / (2 * i))
        total = total + term
    return num(1) - F.abs(t) / F.sqrt(num(dof) + t * t) * total


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the complementary error function's rational bound (error below 1.5e-7)."""
    z = F.abs(x) / num(math.sqrt(2))
    t = num(1) / (num(1) + num(0.3275911) * z)
    poly = num(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = poly * t + num(c)
    erf = num(1) - poly * t * F.exp(-z * z)
    return num(0.5) * (num(1) + F.signum(x) * erf)


def block_length(n: Column, base: int = 384, at: int = 33217, least: int = 64) -> Column:
    """max(least, round(base (n / at)^(1/3))), rounded half to even."""
    return F.greatest(F.lit(least), F.bround(num(base) * F.pow(n / num(at), num(1 / 3))).cast("int"))


def symbol(x: Column) -> Column:
    """Lower case, dots as dashes, without the quote currency's suffix."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"\.", "-"), "usdt$", "")


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without time zone (read as UTC in a UTC session)."""
    return F.unix_micros(ts.cast("timestamp")) / num(1e6)


def slot(ts: Column, seconds: int, offset: int = 0) -> Column:
    """Number of the time bucket that holds a timestamp."""
    return F.floor((seconds_of(ts) - num(offset)) / num(seconds)).cast("long")
