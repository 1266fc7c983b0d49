"""Dates and times, in UTC.  Dates go in as dates, timestamps or texts; a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import arg, named, strict

#: Days from the year 0 to 1970-01-01.
EPOCH_DAYS = 719528
#: Format letters after % and the Java patterns for them.
TOKENS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss",
    "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "%",
}


def java_pattern(pattern: str) -> str:
    """A pattern with % letters as a Java one."""
    out, i, plain = "", 0, ""

    def flush() -> str:
        if not plain:
            return ""
        return "'" + plain.replace("'", "''") + "'" if any(ch.isalpha() or ch == "'" for ch in plain) else plain

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            out += flush() + TOKENS.get(pattern[i + 1], f"'{pattern[i + 1]}'")
            plain = ""
            i += 2
        else:
            plain += pattern[i]
            i += 1
    return out + flush()


def _ts(x: object) -> Column:
    """A timestamp from a date, a timestamp or a text; null if it can't be read."""
    return arg(x).try_cast("timestamp_ntz")


def _date(x: object) -> Column:
    return _ts(x).cast("date")


def _seconds(x: object) -> Column:
    """Seconds of a time such as [-]HH:MM:SS, or of an integer number of seconds, or of a timestamp's time."""
    s = F.trim(arg(x).cast("string"))
    time = F.regexp_extract(s, r"(-?\d+:\d{1,2}(?::\d{1,2})?)(?:\.\d+)?$", 1)
    parts = F.split(F.ltrim(time, F.lit("-")), ":")
    total = F.get(parts, F.lit(0)).try_cast("long") * 3600 + F.get(parts, F.lit(1)).try_cast("long") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("long"), F.lit(0))
    return F.when(time != "", F.when(time.startswith("-"), -total).otherwise(total)).otherwise(s.try_cast("long"))


def _clock(seconds: Column) -> Column:
    n = F.abs(seconds)
    text = F.format_string("%02d:%02d:%02d", F.floor(n / 3600).cast("long"), F.pmod(F.floor(n / 60).cast("long"), F.lit(60)), F.pmod(n, F.lit(60)))
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def _shift(x: object, seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), _ts(x) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))


@named("adddate", "date_add", args=(2, 2))
def adddate(x: object, days: object) -> Column:
    """A date so many days later."""
    return F.date_add(_date(x), arg(days).cast("int"))


@named("subdate", "date_sub", args=(2, 2))
def subdate(x: object, days: object) -> Column:
    return F.date_sub(_date(x), arg(days).cast("int"))


@named("addtime", args=(2, 2))
def addtime(x: object, time: object) -> Column:
    """A timestamp later by a time or by seconds."""
    return _shift(x, _seconds(time))


@named("subtime", args=(2, 2))
def subtime(x: object, time: object) -> Column:
    return _shift(x, -_seconds(time))


@named("curdate", "current_date", args=(0, 0))
def curdate() -> Column:
    return F.current_date()


@named("curtime", "current_time", args=(0, 0))
def curtime() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


@named("now", args=(0, 0))
def now() -> Column:
    return F.current_timestamp()


@named("sysdate", args=(0, 0))
def sysdate() -> Column:
    return F.current_timestamp()


@named("localtime", args=(0, 0))
def localtime() -> Column:
    return F.localtimestamp()


@named("localtimestamp", args=(0, 0))
def localtimestamp() -> Column:
    return F.localtimestamp()


@named("unix_timestamp", "unixtimestamp", args=(0, 0))
def unix_timestamp() -> Column:
    return F.unix_timestamp()


@named("date", args=(1, 1))
def date(x: object) -> Column:
    return _date(x)


@named("time", args=(1, 1))
def time(x: object) -> Column:
    return _clock(_seconds(x))


@named("timestamp", args=(0, 2))
def timestamp(x: object = None, time: object = None) -> Column:
    """Now; or a value as a timestamp; or a date with a time added."""
    if x is None:
        return F.localtimestamp()
    return _ts(x) if time is None else _shift(_date(x).cast("timestamp_ntz"), _seconds(time))


@named("datediff", args=(2, 2))
def datediff(a: object, b: object) -> Column:
    return F.datediff(_date(a), _date(b))


@named("timediff", args=(2, 2))
def timediff(a: object, b: object) -> Column:
    """Whole seconds between two timestamps or two times."""
    both = F.timestamp_diff("SECOND", _ts(b), _ts(a))
    return F.coalesce(both, _seconds(a) - _seconds(b))


@named("date_format", args=(2, 2))
def date_format(x: object, pattern: str) -> Column:
    return F.date_format(_date(x).cast("timestamp_ntz"), java_pattern(pattern))


@named("time_format", args=(2, 2))
def time_format(x: object, pattern: str) -> Column:
    return F.date_format(_shift(F.lit("1970-01-01"), _seconds(x)), java_pattern(pattern))


@named("str_to_date", args=(2, 2))
def str_to_date(x: object, pattern: str) -> Column:
    """A timestamp read by a pattern; a pattern without a date gives the time on 1970-01-01."""
    return F.try_to_timestamp(arg(x).cast("string"), F.lit(java_pattern(pattern)))


def _part(*names: str):
    def put(f):
        def out(x: object) -> Column:
            return f(_ts(x))

        out.__name__ = names[0]
        return named(*names, args=(1, 1))(out)

    return put


day = _part("day")(F.day)
dayofmonth = _part("dayofmonth")(F.dayofmonth)
dayname = _part("dayname")(F.dayname)
dayofweek = _part("dayofweek")(F.dayofweek)
dayofyear = _part("dayofyear")(F.dayofyear)
month = _part("month")(F.month)
quarter = _part("quarter")(F.quarter)
year = _part("year")(F.year)
weekday = _part("weekday")(F.weekday)
weekofyear = _part("weekofyear")(F.weekofyear)
last_day = _part("last_day")(F.last_day)
microsecond = _part("microsecond")(lambda x: F.date_format(x, "SSSSSS").cast("int"))


def _clock_part(name: str, f):
    def out(x: object) -> Column:
        return f(_seconds(F.when(arg(x).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("00:00:00")).otherwise(arg(x).cast("string")))).cast("int")

    out.__name__ = name
    return named(name, args=(1, 1))(out)


hour = _clock_part("hour", lambda s: F.floor(s / 3600))
minute = _clock_part("minute", lambda s: F.pmod(F.floor(s / 60).cast("long"), F.lit(60)))
second = _clock_part("second", lambda s: F.pmod(s, F.lit(60)))


@named("week", args=(1, 2))
def week(x: object, mode: object = None) -> Column:
    """The ISO week."""
    return F.weekofyear(_ts(x))


@named("yearweek", args=(1, 2))
def yearweek(x: object, mode: object = None) -> Column:
    return (F.extract(F.lit("YEAROFWEEK"), _ts(x)) * 100 + F.weekofyear(_ts(x))).cast("int")


#: The units of extract().
UNITS = {
    "year": year, "quarter": quarter, "month": month, "week": week, "day": day, "hour": hour, "minute": minute, "second": second, "microsecond": microsecond,
}


@named("extract", args=(2, 2))
def extract(unit: str, x: object) -> Column:
    """One of 13 units; two-part ones are numbers such as YYYYMM."""
    u = unit.lower()
    if u in UNITS:
        return UNITS[u](x)
    pairs = {"year_month": (year, month), "day_hour": (day, hour), "hour_minute": (hour, minute), "minute_second": (minute, second)}
    if u not in pairs:
        raise ValueError(f"unknown unit {unit}")
    a, b = pairs[u]
    return (a(x) * 100 + b(x)).cast("int")


@named("from_days", args=(1, 1))
def from_days(n: object) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), arg(n).cast("int") - EPOCH_DAYS)


@named("to_days", args=(1, 1))
def to_days(x: object) -> Column:
    return F.datediff(_date(x), F.lit("1970-01-01").cast("date")) + EPOCH_DAYS


@named("makedate", args=(2, 2))
def makedate(y: object, n: object) -> Column:
    """The n-th day of a year; null outside the year."""
    y, n = arg(y).cast("int"), arg(n).cast("int")
    found = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), n - 1)
    return F.when((n > 0) & (F.year(found) == y), found)


@named("maketime", args=(3, 3))
def maketime(h: object, m: object, s: object) -> Column:
    """A time of any number of hours; any negative part makes it negative."""
    h, m, s = (arg(x).cast("int") for x in (h, m, s))
    text = F.format_string("%02d:%02d:%02d", F.abs(h), F.abs(m), F.abs(s))
    return strict(F.concat(F.when((h < 0) | (m < 0) | (s < 0), "-").otherwise(""), text), h, m, s)


def _months(p: Column) -> Column:
    return F.floor(p / 100).cast("long") * 12 + F.pmod(p, F.lit(100)) - 1


def _valid(p: Column) -> Column:
    return F.pmod(p, F.lit(100)).between(1, 12)


@named("period_add", args=(2, 2))
def period_add(p: object, n: object) -> Column:
    """YYYYMM so many months later; null for a month that isn't 1 to 12."""
    p, n = arg(p).cast("long"), arg(n).cast("long")
    m = _months(p) + n
    return F.when(_valid(p), F.floor(m / 12).cast("long") * 100 + F.pmod(m, F.lit(12)) + 1)


@named("period_diff", args=(2, 2))
def period_diff(a: object, b: object) -> Column:
    a, b = arg(a).cast("long"), arg(b).cast("long")
    return F.when(_valid(a) & _valid(b), _months(a) - _months(b))


@named("sec_to_time", args=(1, 1))
def sec_to_time(n: object) -> Column:
    return _clock(arg(n).cast("long"))


@named("time_to_sec", args=(1, 1))
def time_to_sec(x: object) -> Column:
    return _seconds(x)
