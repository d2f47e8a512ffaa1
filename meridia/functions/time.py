"""Dates and times as Column expressions; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# fixed values: accepted layouts in order, zone names
LAYOUTS = (
    "yyyy-M-d'T'H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'",
    "yyyy-M-d'T'H:m:sXXX",
    "yyyy-M-d'T'H:m:sXX",
    "yyyy-M-d'T'H:m:s",
    "yyyy-M-d H:m:s",
    "yyyy-M-d",
    "yyyy/M/d",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
MAIL = ("d MMM yyyy H:m:s Z", "d MMM yyyy H:m Z", "d MMM yyyy H:m:s", "d MMM yy H:m:s Z")
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def to_utc(c: Column) -> Column:
    """A timestamp without zone is read as UTC."""
    return c.cast("timestamp")


def _first(text: Column, *layouts: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in layouts])


def parse_filing_date(c: Column) -> Column:
    """The first layout that fits; null for what none fits.

    What a text looks like says which layouts can fit it; a layout that does not
    fails by an exception, which costs more than all the tests here.
    """
    text = strip(c)
    named = F.initcap(text)
    z, offset, colon, plain, time, day, slash, short_first, long_first, short, long = LAYOUTS
    dated = F.when(text.contains("T"), F.when(text.endswith("Z"), _first(text, z, offset, colon)).when(text.rlike(r"[+-]\d+(?::?\d+)*$"), F.when(text.rlike(r":\d+[+-]|\.\d+[+-]"), _first(text, offset, colon))).otherwise(_first(text, plain)))
    dated = dated.when(text.contains(":"), _first(text, time)).otherwise(_first(text, day))
    clock = text.contains(":")
    brief = text.rlike(r"(?i)\b[a-z]{3}\b")
    first = F.when(brief, _first(named, short_first, long_first)).otherwise(_first(named, long_first))
    last = F.when(brief, _first(named, short, long)).otherwise(_first(named, long))
    return F.when(text.rlike(r"^\d+-"), dated).when(text.rlike(r"^\d+/"), _first(text, slash)).when(clock, None).when(text.rlike(r"^\d"), first).otherwise(last)


def parse_news_datetime(c: Column) -> Column:
    """A filing date, or a mail date such as ``Mon, 15 Apr 2024 10:30:00 GMT``."""
    text = F.regexp_replace(strip(c), r"^[A-Za-z]{3,9},\s*", "")
    zone = F.upper(F.regexp_extract(text, r"\s([A-Za-z]{1,4})\z", 1))
    offsets = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    numeric = F.when(zone == "", text).otherwise(F.concat(F.regexp_replace(text, r"\s[A-Za-z]{1,4}\z", " "), F.coalesce(F.try_element_at(offsets, zone), F.lit("+0000"))))
    named = F.initcap(numeric)
    mail = (
        F.when(numeric.rlike(r"^\d+ +[A-Za-z]+ +\d{3,} .*\d:\d+:\d+ "), _first(named, MAIL[0]))
        .when(numeric.rlike(r"^\d+ +[A-Za-z]+ +\d{3,} .*\d:\d+:\d+$"), _first(named, MAIL[2]))
        .when(numeric.rlike(r"^\d+ +[A-Za-z]+ +\d{3,} "), _first(named, MAIL[1]))
        .when(numeric.rlike(r"^\d+ +[A-Za-z]+ "), _first(named, MAIL[3]))
    )
    return F.coalesce(parse_filing_date(c), F.when(numeric.contains(":"), mail))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays from one date to the other, both ends counted, whichever comes first."""
    lo, hi = F.least(F.to_date(a), F.to_date(b)), F.greatest(F.to_date(a), F.to_date(b))
    n, w = F.datediff(hi, lo) + 1, F.weekday(lo)
    r = n % 7
    saturday_sunday = F.greatest(F.least(w + r, F.lit(7)) - F.greatest(w, F.lit(5)), F.lit(0)) + F.greatest(w + r - 12, F.lit(0))
    return (F.floor(n / 7) * 5 + r - saturday_sunday).cast("int")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """A date whose missing month or day is the first; null where there is no such day."""
    text = F.concat_ws("-", year.cast("string"), F.coalesce(month, F.lit(1)).cast("string"), F.coalesce(day, F.lit(1)).cast("string"))
    return F.when(year.isNotNull(), F.try_to_timestamp(text, F.lit("y-M-d")).cast("date"))


def ceil_to_hour(c: Column) -> Column:
    hour = F.date_trunc("hour", c)
    return F.when(hour == c, c).otherwise(hour + F.expr("interval 1 hour"))


def seconds_between(start: Column, end: Column) -> Column:
    """Never negative, six decimals; nought where a time is missing."""
    gap = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return F.round(F.coalesce(F.greatest(gap, F.lit(0.0)), F.lit(0.0)), 6)


def aware_or_now(c: Column) -> Column:
    """A time as UTC; the time of the query where there is none."""
    return F.coalesce(to_utc(c), F.current_timestamp())


def freshness_seconds(as_of: Column, now: Column | None = None) -> Column:
    """Seconds that have passed since a cut-off, with their fraction; negative before it."""
    return (F.unix_micros(F.current_timestamp() if now is None else now) - F.unix_micros(as_of)) / F.lit(1e6)
