"""Column helpers with the null rules that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(name: str | Column) -> Column:
    """A column by its exact name, whatever characters it has."""
    return name if isinstance(name, Column) else F.col("`" + name.replace("`", "``") + "`")


def dbl(name: str | Column) -> Column:
    return col(name).cast("double")


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(dbl(a), dbl(b))


def ratio_if_positive(a, b) -> Column:
    return F.when(dbl(b) > 0, dbl(a) / dbl(b))


def growth(now, before) -> Column:
    """now / before - 1; null unless before is positive."""
    return F.when(dbl(before) > 0, dbl(now) / dbl(before) - 1)


def latest(value, order) -> Column:
    """Aggregate: the value at the greatest order among rows that have one."""
    v = col(value)
    return F.max_by(v, F.when(v.isNotNull(), col(order)))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def in_range(name: str, low, high) -> Column:
    """Inclusive; a bound that is None is open."""
    return all_of([col(name) >= F.lit(low)] * (low is not None) + [col(name) <= F.lit(high)] * (high is not None))


def pct_rank(value, partition: list, orientation=None) -> Column:
    """Average-tie rank over the count of non-nulls, in (0, 1]; null stays null."""
    v = col(value)
    key = v if orientation is None else v * orientation
    keys = [col(p) for p in partition]
    some = Window.partitionBy(*keys, v.isNull())
    n = F.count(v).over(Window.partitionBy(*keys))
    ties = F.count(v).over(Window.partitionBy(*keys, v))
    place = F.rank().over(some.orderBy(key))
    return F.when(v.isNotNull(), (place + (ties - 1) / F.lit(2.0)) / n)


def usable(name) -> Column:
    """Neither null nor NaN."""
    return col(name).isNotNull() & ~F.isnan(dbl(name))


def fixed(value, digits: int) -> Column:
    """A double as text with so many digits behind the point, rounded by its exact value and, halfway, to the even digit, as SQL's printf and Python do; Java's formatter rounds the shortest decimal form, up."""
    x = dbl(value)
    a = F.when(F.abs(x) < 2.0**53, F.abs(x))
    whole = F.floor(a).cast("long")
    # What is behind the point in steps of 2**-52, and what numbers below 1 have beyond these in steps of 2**-92.
    steps = (a - whole) * 2.0**52
    rest = F.floor(steps).cast("long")
    fine = F.floor((steps - rest) * 2.0**40).cast("long")
    shown = F.lit(0).cast("long")
    for n in [2] * (digits // 2) + [1] * (digits % 2):
        fine = fine * 10**n
        rest, fine = rest * 10**n + F.shiftright(fine, 40), fine.bitwiseAND(F.lit(2**40 - 1))
        shown, rest = shown * 10**n + F.shiftright(rest, 52), rest.bitwiseAND(F.lit(2**52 - 1))
    odd = (shown if digits else whole) % 2 == 1
    up = (rest > 2**51) | ((rest == 2**51) & ((fine > 0) | odd))
    shown = shown + up.cast("long")
    carried = shown >= 10**digits if digits else up
    text = (whole + carried.cast("long")).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((shown % 10**digits).cast("string"), digits, "0"))
    return F.coalesce(F.concat(F.when(x < 0, "-").otherwise(""), text), F.format_string(f"%.{digits}f", x))
