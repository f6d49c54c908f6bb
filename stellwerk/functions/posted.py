"""When a posting was published, read from what portals say in either language, relative to when it was scraped."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: How portals name spans of time, with seconds where they have a length.
UNITS = {
    "minute": ("minut|min", 60),
    "hour": ("stunde|std|hour|h(?:$|[^a-zäöü])", 3600),
    "day": ("tag|day", 86_400),
    "week": ("woche|week", 7 * 86_400),
    "month": ("monat|month", None),
    "year": ("jahr|year", None),
}
NOW_WORDS, YESTERDAY_WORDS = r"heute|today|just now|gerade eben|soeben", r"gestern|yesterday"
_UNIT = "|".join(p for p, _ in UNITS.values())
SPAN = rf"(?:(?:([0-9]{{1,4}})([+]?))|(?:^|[^a-z])(?:einem|einer|eine|ein|an|a|one))\s*({_UNIT})"
ISO = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
DOTTED = r"(?:^|[^0-9.])([0-9]{1,2})\.\s?([0-9]{1,2})\.\s?([0-9]{4}|[0-9]{2})?(?:$|[^0-9])"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("y-M-d")).cast("date")


def _dotted(low: Column, today: Column) -> Column:
    """Day and month, with a year of four or two digits, or the last such day that is not after today."""
    day, month, year = (F.regexp_extract(low, DOTTED, k) for k in (1, 2, 3))
    this = F.year(today)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    own = _date(this.cast("string"), month, day)
    before = _date((this - 1).cast("string"), month, day)
    # The 29th of February may be further back than a year.
    leap = _date((this - F.pmod(this, F.lit(4))).cast("string"), month, day)
    latest = F.coalesce(F.when(own <= today, own), before, F.when(leap <= today, leap))
    return F.when(full != "", _date(full, month, day)).otherwise(latest)


def posted_range(text: Column, scraped_at: Column) -> Column:
    """``first`` and ``last`` day (UTC) on which the posting can have been published; NULL if the text cannot be read.

    "3 days ago" was said up to the fourth day, so it spans two days; "30+ days ago" has no first day.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.to_utc_timestamp(scraped_at, F.current_timezone())
    today = F.to_date(at)
    n = F.coalesce(F.nullif(F.regexp_extract(low, SPAN, 1), F.lit("")).cast("int"), F.lit(1))
    more, unit = F.regexp_extract(low, SPAN, 2) == "+", F.regexp_extract(low, SPAN, 3)

    def ago(k: Column) -> Column:
        out = None
        for pattern, seconds in UNITS.values():
            if seconds:
                then = F.to_date(F.timestamp_micros(F.unix_micros(at) - k.cast("bigint") * seconds * 1_000_000))
            else:
                then = F.add_months(today, -k * (12 if "year" in pattern else 1))
            test = unit.rlike(f"^(?:{pattern})")
            out = F.when(test, then) if out is None else out.when(test, then)
        return out

    def one(day: Column) -> Column:
        return F.struct(day.alias("first"), day.alias("last"))

    iso = _date(*(F.regexp_extract(low, ISO, k) for k in (1, 2, 3)))
    relative = F.struct(F.when(~more, ago(n + 1)).alias("first"), ago(n).alias("last"))
    read = (
        F.when(low.rlike(ISO), one(iso))
        .when(low.rlike(DOTTED), one(_dotted(low, today)))
        .when(unit != "", relative)
        .when(low.rlike(NOW_WORDS), one(today))
        .when(low.rlike(YESTERDAY_WORDS), one(F.date_sub(today, 1)))
    )
    return F.when(read["last"].isNotNull(), read)


def posted_since(text: Column, scraped_at: Column, day: Column, unknown: bool = False) -> Column:
    """Whether a posting can have been published on ``day`` or later; unreadable texts follow ``unknown``."""
    return F.coalesce(posted_range(text, scraped_at)["last"] >= day, F.lit(unknown))
