"""Decimal rounding of doubles by their exact binary value, ties to even."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


#: From here on a double has no fraction.
_WHOLE = float(2**52)
#: Bits of the fraction that are compared; those below are cut off.
_BITS = 62


def _units(value: Column, places: int) -> Column:
    """``|value|`` below 2**52 as a whole number of ``10**-places``, as a decimal.

    The built-in half-even rounding works on the shortest decimal text of a double, where
    0.145 looks like a tie although its binary value lies below it. The fraction is below one, and
    scaling it by a power of two is exact, so the comparison with one half is too.
    """
    size = F.abs(value)
    whole = F.floor(size)
    unit = F.lit(Decimal(2**_BITS))
    scaled = ((size - whole) * F.lit(float(2**_BITS))).cast("bigint").cast("decimal(19,0)") * F.lit(Decimal(10**places))
    part = F.call_function("div", scaled, unit)
    rest = (scaled - part.cast("decimal(19,0)") * unit) * F.lit(Decimal(2))
    before = whole.cast("decimal(19,0)") * F.lit(Decimal(10**places)) + part.cast("decimal(19,0)")
    up = (rest > unit) | ((rest == unit) & (before % 2 == 1))
    return before + F.when(up, 1).otherwise(0).cast("decimal(1,0)")


def rounded(value: Column, places: int) -> Column:
    """``value`` rounded to ``places`` decimals, as a double. Infinities, NaN and values without a fraction stay."""
    near = F.abs(value) < _WHOLE
    units = _units(F.when(near, value), places)
    return F.when(near, F.signum(value) * (units.cast("double") / F.lit(float(10**places)))).otherwise(value)


def fixed(value: Column, places: int) -> Column:
    """``value`` as text with exactly ``places`` decimals; infinities and NaN as they are written."""
    near = F.abs(value) < _WHOLE
    sign = F.when(value < 0, "-").otherwise("")
    digits = F.lpad(_units(F.when(near, value), places).cast("decimal(38,0)").cast("string"), 38, "0")
    head = F.regexp_replace(F.substring(digits, 1, 38 - places), "^0+(?=.)", "")
    text = F.concat(sign, head, F.lit("."), F.substring(digits, 39 - places, places))
    large = F.concat(value.cast("decimal(38,0)").cast("string"), F.lit("." + "0" * places))
    return F.when(near, text).otherwise(F.coalesce(F.when(F.abs(value) < 1e37, large), value.cast("string")))
