"""Pay as a yearly range, read from salary texts of either language.

An amount may have thousands separators of either kind, decimals, a K, and a currency before or after
it; the period is named in the text or, without a name, follows from the amount's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: An amount with its groups, and how often a year has each period.
AMOUNT = r"(?:[0-9]{1,3}(?:[.,'\x{00a0} ][0-9]{3})+|[0-9]+)(?:[.,][0-9]{1,2})?(?:[ \x{00a0}]?[kK])?(?![0-9A-Za-z%.,]*[0-9A-Za-z%])"
PERIODS = {
    "hour": (r"(?i)stunde|stündlich|hour|/ ?h(?:$|[^a-z])|(?:^|[^a-z])p\.? ?h\.?(?:$|[^a-z])", 2080),
    "day": (r"(?i)tagessatz|pro tag|je tag|täglich|daily|per day|/ ?(?:day|tag)", 260),
    "month": (r"(?i)monat|month|/ ?mo(?:$|[^a-z])|mtl", 12),
    "year": (r"(?i)jahr|jährlich|year|annual|annum|p\.? ?a\.?(?:$|[^a-z])", 1),
}
#: Without a named period: up to an hourly rate, a daily rate, a monthly wage; beyond, a yearly one.
UP_TO = (("hour", 300), ("day", 2000), ("month", 15_000))
_RANGE = r"[ \x{00a0}€$]*(?:-|–|—|bis|to|und|and)[ \x{00a0}€$]*(?:EUR|USD|CHF)?[ \x{00a0}€$]*"


def _number(text: Column) -> Column:
    """An amount as a number: separators of groups dropped, a K as thousands."""
    bare = F.regexp_replace(text, r"[ \x{00a0}']|[kK]$", "")
    # One or two digits after the last separator are decimals, three are a group.
    whole = F.regexp_replace(F.regexp_replace(bare, r"[.,]([0-9]{1,2})$", "_$1"), "[.,]", "")
    return F.replace(whole, F.lit("_"), F.lit(".")).cast("double") * F.when(text.rlike("[kK]$"), 1000).otherwise(1)


def _times(text: Column, amount: Column) -> Column:
    """How often a year pays the amount."""
    named = F.when(text.rlike(PERIODS["hour"][0]), PERIODS["hour"][1])
    for period in ("day", "month", "year"):
        pattern, times = PERIODS[period]
        named = named.when(text.rlike(pattern), times)
    for period, limit in UP_TO:
        named = named.when(amount <= limit, PERIODS[period][1])
    return named.otherwise(1)


def yearly_pay(text: Column) -> Column:
    """``low`` and ``high`` of a year's pay; NULL without an amount.

    Two amounts joined as a range are its ends, whichever comes first; a K after the second holds for a first
    one below 1,000 as well. Otherwise the first amount counts as both.
    """

    def pay(t: Column) -> Column:
        ends = F.regexp_extract_all(t["used"], F.lit(f"({AMOUNT})"), F.lit(1))
        return F.when(F.size(ends) > 0, _bound(ends, lambda e: _range(t["given"], e, t["pair"] != "")))

    def used(given: Column) -> Column:
        pair = F.regexp_extract(given, f"({AMOUNT}){_RANGE}({AMOUNT})", 0)
        return _bound(pair, lambda p: F.struct(given.alias("given"), p.alias("pair"), F.when(p != "", p).otherwise(given).alias("used")))

    return _bound(_bound(F.coalesce(text, F.lit("")), used), pay)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _range(given: Column, ends: Column, joined: Column) -> Column:
    first = F.get(ends, F.lit(0))
    last = F.when(joined, F.get(ends, F.size(ends) - 1)).otherwise(first)

    def yearly(x: Column) -> Column:
        a = F.when(x["last"].rlike("[kK]$") & ~x["first"].rlike("[kK]$") & (x["a"] < 1000), x["a"] * 1000).otherwise(x["a"])
        return _bound(a, lambda a: F.struct(F.least(a, x["b"]).alias("low"), F.greatest(a, x["b"]).alias("high")))

    read = F.struct(first.alias("first"), last.alias("last"), _number(first).alias("a"), _number(last).alias("b"))
    return _bound(
        _bound(read, yearly),
        lambda p: _bound(
            _times(given, p["high"]), lambda n: F.struct((p["low"] * n).alias("low"), (p["high"] * n).alias("high"))
        ),
    )


def reaches(text: Column, least: float, unknown: bool = True) -> Column:
    """Whether a year's pay can reach ``least``; texts without an amount follow ``unknown``."""
    return F.coalesce(yearly_pay(text)["high"] >= float(least), F.lit(unknown))
