"""Time parsing and formatting. Every result is a UTC instant.

A time without zone is taken as UTC, whatever the session zone is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)? ?(?:Z|UTC|[+-]\d{2}(?::?\d{2})?)?)?$"

# Whole-second range of years 1 to 9999.
_FIRST_SECOND = -62135596800
_LAST_SECOND = 253402300799

# Parts of free-form dates, in lower case. A clock may have seconds, a fraction, a
# meridiem and a zone behind it; a bare hour needs a meridiem.
_CLOCK = (
    r"(?:^|[ ,])(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?: ?([ap])\.?m\.?)?|(\d{1,2}) ?([ap])\.?m\.?)"
    r"(?: ?(z|utc|gmt|[ecmp][sd]t|[+-]\d{2}(?::?\d{2})?))?(?=[ ,]|$)"
)
_MONTH = (
    r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
)
_WEEKDAY = (
    r"^(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs?(?:day)?)?|fri(?:day)?"
    r"|sat(?:urday)?|sun(?:day)?|at|on)$"
)
_NUMBER = r"^(\d{1,4})(?:st|nd|rd|th)?$"
_COMPACT = r"^\d{8}(?:t?\d{6})?$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def compact_utc(col: Column) -> Column:
    """``20240115T093000`` to an instant; bad text becomes NULL."""
    return F.when(
        col.rlike(r"^\d{8}T\d{6}$"),
        F.try_to_timestamp(F.concat(col, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmssX")),
    )


def epoch_utc(col: Column) -> Column:
    """Epoch seconds to an instant; 0, NULL and out-of-range values become NULL."""
    usable = col.between(_FIRST_SECOND, _LAST_SECOND) & (col != 0)
    return F.timestamp_seconds(F.when(usable, col))


def iso_utc(col: Column) -> Column:
    """ISO date or date-time, with ``Z``, an offset or no zone; bad text becomes NULL."""
    minute, rest = F.substring(col, 1, 16), F.substring(col, 17, 40)
    zone = F.when(rest.rlike("[-+ZC]"), "").otherwise("Z")
    text = (
        F.when(F.length(col) == 10, F.concat(col, F.lit(" 00:00:00Z")))
        .when(rest.startswith(":"), F.concat(col, zone))
        .otherwise(F.concat(minute, F.lit(":00"), rest, zone))
    )
    return F.when(col.rlike(_ISO), text.try_cast("timestamp"))


def loose_utc(col: Column) -> Column:
    """Free-form date text to an instant.

    ISO forms are read by :func:`iso_utc`, digits alone as ``yyyyMMdd[HHmmss]``. Any
    other text is cut once: its clock, with meridiem and zone, is taken out, and what
    is left is split at blanks, commas, slashes, dots and dashes into numbers, a month
    name, and weekday names, which are ignored. Year, month and day then follow from
    the kinds of tokens, in whatever order they stand: a number of four digits is the
    year; a month name leaves a year and a day, or a year alone (its first day);
    without one the order is year, month, day, or month, day, year, unless the first
    number is above 12 and can only be a day. Case does not matter. Offsets count;
    zone names other than UTC do not, such times are taken as UTC. Anything else, a
    year of two digits included, is NULL.
    """
    cleaned = F.trim(F.regexp_replace(col, r"\s+", " "))
    return _bound(cleaned, lambda t: F.when(t.rlike(_ISO), iso_utc(t)).otherwise(_read(t)))


def _read(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"(?<=\d)t(?=\d{1,2}:)", " ")
    return _bound(low, lambda t: F.when(t.rlike(_COMPACT), _digits(t)).otherwise(_tokens(t)))


def _digits(text: Column) -> Column:
    plain = F.rpad(F.replace(text, F.lit("t"), F.lit("")), 14, "0")
    return F.try_to_timestamp(F.concat(plain, F.lit("Z")), F.lit("yyyyMMddHHmmssX"))


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _tokens(text: Column) -> Column:
    cut = F.struct(
        F.regexp_extract(text, _CLOCK, 0).alias("clock"),
        F.regexp_replace(text, _CLOCK, " ").alias("rest"),
        F.length(text).alias("length"),
    )
    return _bound(cut, _classes)


def _classes(cut: Column) -> Column:
    words = F.filter(F.split(cut["rest"], r"[ ,/.\-]+"), lambda w: w != "")
    once = (cut["clock"] == "") | (F.length(cut["rest"]) == cut["length"] - F.length(cut["clock"]) + 1)
    return F.when(once, _bound(F.struct(words.alias("words"), cut["clock"].alias("clock")), _numbered))


def _numbered(parts: Column) -> Column:
    months = F.filter(parts["words"], lambda w: w.rlike(_MONTH))
    numbers = F.transform(
        F.filter(parts["words"], lambda w: w.rlike(_NUMBER)), lambda w: F.regexp_replace(w, "[a-z]+", ""))
    classes = F.struct(
        F.size(parts["words"]).alias("words"), numbers.alias("numbers"), F.size(months).alias("months"),
        F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(F.get(months, F.lit(0)), 1, 3)).alias("month"),
        F.size(F.filter(parts["words"], lambda w: w.rlike(_WEEKDAY))).alias("ignored"),
        F.split(F.regexp_replace(parts["clock"], _CLOCK, "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|").alias("clock"),
    )
    return _bound(classes, lambda c: F.when(
        F.size(c["numbers"]) + c["months"] + c["ignored"] == c["words"],
        _bound(F.struct(_date(c).alias("date"), c["clock"].alias("clock")), _instant)))


def _date(classes: Column) -> Column:
    """Year, month and day from the classes of tokens; NULL if a token has no place."""
    numbers = [F.get(classes["numbers"], F.lit(i)) for i in range(3)]
    count, month = F.size(classes["numbers"]), classes["month"]
    year_first, year_second, year_third = (F.length(n) == 4 for n in numbers)

    def day(*parts: Column) -> Column:
        return F.array(*[c.cast("int") for c in parts])

    one = F.lit(1)
    a, b, c = numbers
    named = (
        F.when((count == 2) & year_first, day(a, month, b))
        .when((count == 2) & year_second, day(b, month, a))
        .when((count == 1) & year_first, day(a, month, one))
    )
    plain = (
        F.when((count == 3) & year_first, day(a, b, c))
        .when((count == 3) & year_third & (a.cast("int") > 12), day(c, b, a))
        .when((count == 3) & year_third, day(c, a, b))
        .when((count == 2) & year_first, day(a, b, one))
        .when((count == 1) & year_first, day(a, one, one))
    )
    return F.when(classes["months"] == 1, named).when(classes["months"] == 0, plain)


def _instant(read: Column) -> Column:
    hour, minute, second, fraction, half, bare_hour, bare_half, zone = (F.get(read["clock"], F.lit(i)) for i in range(8))
    given = F.coalesce(F.concat(hour, bare_hour).try_cast("int"), F.lit(0))
    meridiem = F.coalesce(F.concat(half, bare_half), F.lit(""))
    hours = F.when(meridiem == "", given).when(
        given.between(1, 12), given % 12 + F.when(meridiem == "p", 12).otherwise(0))
    seconds = F.concat(F.lit("0"), second, F.lit("."), F.substring(fraction, 1, 6), F.lit("0")).try_cast("decimal(8,6)")
    # Minutes ahead of UTC; names of zones count as none.
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).cast("long") * 60 + F.substring(digits, 3, 2).cast("long")
    ahead = F.when(zone.startswith("+"), minutes).when(zone.startswith("-"), -minutes).otherwise(0)
    year, month, day = (F.get(read["date"], F.lit(i)) for i in range(3))
    local = F.try_make_timestamp(
        year, month, day, hours, F.coalesce(minute.try_cast("int"), F.lit(0)), F.coalesce(seconds, F.lit(0).cast("decimal(8,6)")),
        F.lit("UTC"))
    return F.timestamp_micros(F.unix_micros(local) - ahead * 60_000_000)


def request_window(as_of: Column, hours: int = 2) -> Column:
    """Start and end of the look-back window in each provider's request format."""
    start = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    formats = {"compact": "yyyyMMdd'T'HHmm", "day": "yyyy-MM-dd", "minute": "yyyy-MM-dd'T'HH:mm"}
    return F.struct(
        *[F.date_format(start, fmt).alias(f"{name}_from") for name, fmt in formats.items()],
        *[F.date_format(as_of, fmt).alias(f"{name}_to") for name, fmt in formats.items()],
    )


def age_label(ts: Column, as_of: Column) -> Column:
    """How long ago ``ts`` was, in words, seen from ``as_of``.

    Counted in whole milliseconds; a time after ``as_of`` reads as now.
    """
    elapsed = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))
    minutes = F.when(elapsed.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.floor(elapsed / 60000)))
    return (
        F.when(minutes.isNull(), "Time unavailable")
        .when(minutes < 1, "Just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hr ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" days ago")))
    )
