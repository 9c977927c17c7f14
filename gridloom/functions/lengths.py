"""Exact length arithmetic: lengths are integer eighths of an inch, never floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the eighths 1 to 7, and the vulgar fractions that stand for them.
EIGHTHS = ("1/8", "1/4", "3/8", "1/2", "5/8", "3/4", "7/8")
VULGAR = {"⅛": 1, "¼": 2, "⅜": 3, "½": 4, "⅝": 5, "¾": 6, "⅞": 7}
QUARTER_YARD = 72


def _int(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def int_div(a: Column, b: Column | int) -> Column:
    """Integer quotient of operands that aren't negative."""
    return F.call_function("div", _int(a), _int(b)).cast("long")


def half_up_div(a: Column, b: Column | int) -> Column:
    """a / b, halves rounded up, for a >= 0 and b > 0."""
    return int_div(_int(a) + int_div(_int(b), 2), b)


def ceil_div(a: Column, b: Column | int) -> Column:
    return int_div(_int(a) + _int(b) - 1, b)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quarter_inch(x: Column, low: int = 160, high: int = 1120) -> Column:
    """The nearest quarter inch between 20 and 140 inches."""
    return clamp(half_up_div(x, 2) * 2, low, high)


def shown(x: Column) -> Column:
    """A length as a mixed fraction of inches: 12 is 1 1/2", -2 is -1/4"."""
    whole, rest = int_div(F.abs(x), 8), F.abs(x) % 8
    fraction = F.element_at(F.array(*[F.lit(e) for e in EIGHTHS]), F.greatest(rest, F.lit(1)).cast("int"))
    body = F.when(rest == 0, whole.cast("string")).when(whole == 0, fraction).otherwise(F.concat_ws(" ", whole.cast("string"), fraction))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body, F.lit('"'))


def size_shown(width: Column, height: Column) -> Column:
    return F.concat(shown(width), F.lit(" x "), shown(height))


def cut_label(fw: Column, fh: Column, cw: Column, ch: Column) -> Column:
    """What a cut-list line says of a center piece."""
    finished = F.when(fw == fh, F.concat(shown(fw), F.lit(" square"))).otherwise(size_shown(fw, fh))
    return F.concat(finished, F.lit(", cut "), size_shown(cw, ch))


def yards_shown(quarters: Column) -> Column:
    """Quarter yards: 22 is 5 1/2 yd."""
    whole, rest = int_div(quarters, 4), quarters % 4
    part = F.element_at(F.array(F.lit(""), F.lit("1/4"), F.lit("1/2"), F.lit("3/4")), (rest + 1).cast("int"))
    return F.concat(F.when((whole == 0) & (rest > 0), part).when(rest > 0, F.concat_ws(" ", whole.cast("string"), part)).otherwise(whole.cast("string")), F.lit(" yd"))


def parsed(text: Column) -> Column:
    """Strict parser: whole inches, W N/D with D dividing 8, a vulgar fraction, or a decimal that is exact in
    eighths, with an inch mark or without; null for anything else. Up to 9 digits a number."""
    s = F.regexp_replace(F.lower(F.trim(text)), r'\s*(?:"|”|in(?:ch(?:es)?)?)$', "")
    vulgar = r"^(\d{0,9})\s*([" + "".join(VULGAR) + "])$"
    marks = F.create_map(*[F.lit(v) for kv in VULGAR.items() for v in kv])
    fraction, decimal = r"^(?:(\d{1,9})\s+)?(\d{1,9})\s*/\s*(\d{1,9})$", r"^\d{1,9}(?:\.\d{1,9})?$"

    def number(pattern: str, group: int) -> Column:
        return F.coalesce(F.regexp_extract(s, pattern, group).try_cast("long"), F.lit(0).cast("long"))

    den = number(fraction, 3)
    exact = s.try_cast("decimal(28,9)") * 8
    return (
        F.when(s.rlike(vulgar), number(vulgar, 1) * 8 + F.element_at(marks, F.regexp_extract(s, vulgar, 2)))
        .when(s.rlike(fraction), F.when(den.isin(1, 2, 4, 8), number(fraction, 1) * 8 + number(fraction, 2) * F.call_function("div", F.lit(8), F.greatest(den, F.lit(1)))))
        .when(s.rlike(decimal), F.when(exact == F.floor(exact), exact.cast("long")))
    )


def parsed_rounded(text: Column) -> Column:
    """Lenient parser: like parsed, but any denominator and any decimal, rounded half up to eighths."""
    s = F.regexp_replace(F.lower(F.trim(text)), r'\s*(?:"|”|in(?:ch(?:es)?)?)$', "")
    fraction, decimal = r"^(?:(\d{1,9})\s+)?(\d{1,9})\s*/\s*(\d{1,9})$", r"^\d{1,9}(?:\.\d{1,9})?$"
    whole, num, den = (F.coalesce(F.regexp_extract(s, fraction, i).try_cast("long"), F.lit(0).cast("long")) for i in (1, 2, 3))
    return F.when(s.rlike(fraction), F.when(den > 0, whole * 8 + half_up_div(num * 8, F.greatest(den, F.lit(1))))).when(s.rlike(decimal), F.floor(s.try_cast("double") * 8 + 0.5).cast("long"))


def from_cm(cm: Column) -> Column:
    return F.floor(cm * 8 / 2.54 + 0.5).cast("long")
