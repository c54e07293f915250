"""Column helpers with the semantics of template values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, as a Java pattern class.
_SPACE = r"[\x09-\x0D\x20\x85\xA0  -     　]"
MAX, MIN = (1 << 63) - 1, -(1 << 63)


def _whole(x: Column) -> Column:
    """A number from 2**53, where all are whole, to 9.2e18: the exact value, rounded as far as it still reads as the same number."""
    exact = x.cast("long")
    rounded = [F.round(exact, -k) for k in (4, 3, 2, 1)]
    return F.coalesce(*[F.when(n.cast("double") == x, n) for n in rounded], exact).cast("string")


def _large(x: Column) -> Column:
    """From 9.2e18 to 1e30: as few digits as read as the same number."""
    forms = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    return F.coalesce(*[F.when(f.cast("double") == x, f) for f in forms]).cast("decimal(38,0)").cast("string")


def _least(x: Column) -> Column:
    """Below 1e-300, where few of the JVM's digits mean anything: as few digits as read as the same number."""
    forms = [F.format_string(f"%.{n}e", x) for n in range(17)]
    found = F.coalesce(*[F.when(f.cast("double") == x, f) for f in forms])
    digits = F.regexp_replace(F.substring_index(found, "e", 1), r"\.", "")
    return F.concat(F.lit("0."), F.repeat(F.lit("0"), F.substring_index(found, "e-", -1).cast("int") - 1), digits)


def _endless(x: Column) -> Column:
    return F.when(x > 0, "inf").otherwise("-inf")


def show_float(x: Column) -> Column:
    """Shortest digits without an exponent; -0.0 is 0.

    Whole numbers go by way of long and the middle range by the plain cast, which are cheap; the rest
    needs a number format.  Before version 19 the JVM's digits are not always the shortest
    from 1e16 to 1e26, so whole numbers from 2**53 on have ways of their own."""
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "NaN")
        .when((x == F.floor(x)) & (size < 1e15), x.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), x.cast("string"))
        .when(size == float("inf"), _endless(x))
        .when((size >= 2.0**53) & (size < 1e30), F.concat(F.when(x < 0, "-").otherwise(""), F.when(size < 9.2e18, _whole(size)).otherwise(_large(size))))
        .when(size < 1e-300, F.concat(F.when(x < 0, "-").otherwise(""), _least(size)))
        .otherwise(F.call_function("format_number", x, F.lit("0." + "#" * 340)))
    )


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def fixed_exact(x: Column, n: int) -> Column:
    """N decimals of the exact binary value, ties to even."""
    made = F.call_function("format_number", x, F.lit("0" + ("." + "0" * n if n else "")))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), _endless(x)).otherwise(made)


def fixed_fast(x: Column, n: int) -> Column:
    """N decimals by scaling and adding a half; the sign stays even of what rounds to 0."""
    if n > 18:
        return fixed_exact(x, n)
    scale = 10.0**n
    v = F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)).cast("long")
    unit = F.lit(10**n).cast("long")
    whole = F.call_function("div", v, unit).cast("string") if n else v.cast("string")
    part = F.concat(F.lit("."), F.lpad((v % unit).cast("string"), n, "0")) if n else F.lit("")
    small = F.abs(x) * F.lit(scale) < F.lit(2.0**63)
    return F.when(small, F.concat(F.when(x < 0, "-").otherwise(""), whole, part)).otherwise(fixed_exact(x, n))


def saturated(x: Column, n: int, minus: bool) -> Column:
    """x + n or x - n on longs, kept within their range."""
    got = F.try_subtract(x, F.lit(n).cast("long")) if minus else F.try_add(x, F.lit(n).cast("long"))
    bound = MAX if (n > 0) != minus else MIN
    return F.when(x.isNotNull(), F.coalesce(got, F.lit(bound).cast("long")))


def less(a: Column, b: Column, ints: tuple[bool, bool], or_equal: bool) -> Column:
    """Ordering of numbers without rounding; NaN is in no order."""
    if ints[0] and ints[1]:
        got = a <= b if or_equal else a < b
    elif not ints[0] and not ints[1]:
        got = (a <= b if or_equal else a < b) & ~F.isnan(a) & ~F.isnan(b)
    else:
        # A long beside a double: the double's floor is exact as a long within its range.
        whole, number = (a, b) if ints[0] else (b, a)
        low = F.floor(number)
        at = low.cast("long")
        top, bottom = number >= F.lit(2.0**63), number < F.lit(-(2.0**63))
        if ints[0]:
            inside = (whole <= at) if or_equal else (whole < at) | ((whole == at) & (number > low))
            got = F.when(F.isnan(number) | bottom, False).when(top, True).otherwise(inside)
        else:
            inside = (whole > at) | ((whole == at) & (number == low)) if or_equal else whole > at
            got = F.when(F.isnan(number) | top, False).when(bottom, True).otherwise(inside)
    return F.coalesce(got, F.lit(False))


def same_float(a: Column, b: Column) -> Column:
    """Equal as numbers and in the sign of zero; NaN equals NaN."""
    zero = F.when(a == 0, a.cast("string") == b.cast("string")).otherwise(True)
    return a.eqNullSafe(b) & F.coalesce(zero, F.lit(True))
