"""Dates of postings: phrases, epochs and written dates to timestamps; freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

HOURS = 168
MAX_AGE_DAYS, AHEAD_DAYS = 1095, 2
#: Seconds of the units that phrases use; a month has 30 days, a year 365.
UNITS = {"minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
#: What a text must hold to be read as a written date, and words before one.
LOOKS_WRITTEN = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\d{1,4}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}"
BEFORE = r"^(posted\s*on|date\s*posted|posted|published)\s*:?\s*"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_MONTH = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
_TH, _GAP, _END = r"(?:st|nd|rd|th)?", r"[\s,./-]*", r"(?![\d:])"
_DAY, _YEAR = r"(?<![\d:.])(\d{1,2})" + _TH, r"(\d{4}|\d{2})"
#: Shapes of a date in the order in which they are looked for, with year, month and day as their groups say.
SHAPES = (
    (r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", "$1;$2;$3"),
    (r"(?<![\d:.])(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _END, "$3;$1;$2"),
    (r"(?<!\d)(\d{4})" + _GAP + _MONTH + _GAP + r"(\d{1,2})" + _TH + _END, "$1;$2;$3"),
    (_DAY + _GAP + r"(?:of\s+)?" + _MONTH + _GAP + r"'?" + _YEAR + _END, "$3;$2;$1"),
    (_MONTH + _GAP + r"(\d{1,2})" + _TH + r"\s+\d{1,2}:\d{2}(?::\d{2})?\s+(?:[a-z]+\s+)?(\d{4})" + _END, "$3;$1;$2"),
    (_MONTH + _GAP + r"(\d{1,2})" + _TH + _END + _GAP + r"'?" + _YEAR + _END, "$3;$1;$2"),
    (_MONTH + _GAP + r"(\d{4})" + _END, "$2;$1;"),
    (_MONTH + _GAP + r"(\d{1,2})" + _TH + _END, ";$1;$2"),
    (_DAY + _GAP + r"(?:of\s+)?" + _MONTH, ";$2;$1"),
    (_MONTH, ";$1;"),
    (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?=t|\D|$)", "$1;$2;$3"),
    (r"(?<![\d:./-])(\d{1,2})[/-](\d{1,2})(?![\d:/-])", ";$1;$2"),
)
#: Times of day likewise: hour, minute, second, fraction, half of the day, and an offset's sign, hours, minutes.
TIMES = (
    (r"(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?![\d:])\s*(?:([ap])\.?m\b\.?)?(?:\s*[a-z]*\s*([+-])(\d{2}):?(\d{2})?(?!\d))?", "$1;$2;$3;$4;$5;$6;$7;$8"),
    (r"(?<![\d:.])(\d{1,2})\s*([ap])\.?m\b", "$1;;;;$2;;;"),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _first(text: Column, shapes: tuple[tuple[str, str], ...]) -> Column:
    """The parts of the first of the shapes that the text has."""
    out = F.lit(None).cast("array<string>")
    for pattern, parts in reversed(shapes):
        out = F.when(text.rlike(pattern), F.split(F.regexp_replace(text, f"^.*?{pattern}.*$", parts), ";")).otherwise(out)
    return out


def _midnight(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))


def _date(parts: Column, today: Column) -> Column:
    """Midnight of the date. Of two numbers that may be the month the first one is, unless it is over 12. A
    year of two digits is the one nearest to today; what is missing is today's (a day at most the month's last)."""
    y, m, d = (F.when(F.length(parts[i]).between(1, 2 if i else 4), parts[i].cast("int")) for i in range(3))  # a cast that fails is slow
    name = F.coalesce(*[F.when(F.substring(parts[1], 1, 3) == x[:3], F.lit(i + 1)) for i, x in enumerate(MONTHS)])
    now = F.year(today)
    near = F.pmod(y - now + 50, F.lit(100)) + now - 50
    year = F.coalesce(F.when(F.length(parts[0]) <= 2, near).otherwise(y), now)
    last = lambda n: F.least(F.day(today), F.day(F.last_day(_midnight(n.y, n.m, F.lit(1)).cast("date"))))
    numbers = F.struct(year.alias("y"), F.when(m > 12, d).otherwise(F.coalesce(name, m)).alias("m"), F.when(m > 12, m).otherwise(d).alias("d"))
    return _let(numbers, lambda n: _midnight(n.y, n.m, F.coalesce(n.d, last(n))))


def _time(parts: Column) -> Column:
    """Microseconds since midnight in UTC; 0 without a time, null where it is none."""
    number = lambda i: F.when(parts[i] != "", parts[i].cast("long")).otherwise(0)
    micros = F.substring(F.rpad(parts[3], 6, "0"), 1, 6).cast("long")
    offset = F.when(parts[5] == "-", -60).otherwise(60) * (60 * number(6) + number(7))

    def whole(h: Column) -> Column:
        hour = F.when((parts[4] == "p") & (h < 12), h + 12).when((parts[4] == "a") & (h == 12), 0).otherwise(h)
        return F.when((h < 24) & (number(1) < 60) & (number(2) < 60), (3600 * hour + 60 * number(1) + number(2) - offset) * 1_000_000 + micros)

    return F.when(parts.isNull(), 0).otherwise(_let(number(0), whole))


def _written(text: Column, now: Column) -> Column:
    """A timestamp from lower-case text that holds a date, a time of day, or both."""
    day = 86_400_000_000
    today = F.floor(F.unix_micros(now) / day).cast("int")
    weekday = F.coalesce(*[F.when(text.rlike(rf"\b{w[:3]}({w[3:]})?\b"), F.lit(i)) for i, w in enumerate(WEEKDAYS)])

    def whole(f: Column) -> Column:
        coming = f.today + F.coalesce(F.pmod(weekday - F.weekday(F.date_from_unix_date(f.today)), F.lit(7)), F.lit(0))
        start = F.when(f.date.isNotNull(), F.unix_micros(_date(f.date, F.date_from_unix_date(f.today)))).when(f.time.isNotNull(), coming.cast("long") * day)
        return F.timestamp_micros(start + _time(f.time))

    return _let(F.struct(_first(text, SHAPES).alias("date"), _first(text, TIMES).alias("time"), today.alias("today")), whole)


def parse(value: Column, now: Column) -> Column:
    """A timestamp, or null when nothing reliable is said. Phrases ("3 days ago") and epochs of 10 to 13
    digits are taken as said. Else the text must look like a written date; its date, time of day and offset
    are found by their shapes wherever they stand, other words are passed over, and a date over two days
    ahead or three years back is taken for an accident. Times without an offset are UTC."""
    low = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))
    return _let(low, lambda text: _read(text, now))


def _read(low: Column, now: Column) -> Column:
    number = F.when(low.rlike(r"^\d{10,13}$"), low.cast("double"))
    epoch = F.timestamp_seconds(F.when(number > 1e11, number / 1000).otherwise(number))
    amount, unit = (F.regexp_extract(low, r"(\d+)\+?\s*(minute|min|hour|hr|day|week|month|year)s?\s*(ago|old)?", i) for i in (1, 2))
    seconds = amount.try_cast("long") * F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNITS.items()])
    said = (unit != "") & low.rlike("ago|posted|old")
    ago = F.timestamp_seconds(F.unix_micros(now) / 1e6 - seconds)

    def kept(t: Column) -> Column:
        age = (F.unix_micros(now) - F.unix_micros(t)) / 1e6
        return F.when((age >= -AHEAD_DAYS * 86400) & (age <= MAX_AGE_DAYS * 86400), t)

    written = _let(F.trim(F.regexp_replace(low, BEFORE, "")), lambda bare: F.when(bare.rlike(LOOKS_WRITTEN), _let(_written(bare, now), kept)))
    return F.when(number.isNotNull(), epoch).when(low.rlike("just posted|today|just now"), now).when(low.contains("yesterday"), now - F.expr("interval 1 day")).when(said, ago).otherwise(written)


def freshness(posted: Column, first_seen: Column, now: Column, hours: int = HOURS) -> tuple[Column, Column]:
    """(status, which date said so); the edge of the window is inside."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    date = F.coalesce(posted, first_seen)
    status = F.when(date.isNull(), S.UNDATED).when(date >= cutoff, S.WITHIN).otherwise(S.OLDER)
    source = F.when(posted.isNotNull(), S.POSTED).when(first_seen.isNotNull(), S.FIRST_SEEN).otherwise(S.NO_DATE)
    return status, source


def expired(stamp: Column, today: Column, age: int, offset: Column) -> Column:
    """Whether a remembered entry is due: its day plus age and offset has passed; without a day it is, with no age it never is."""
    if age <= 0:
        return F.lit(False)
    return stamp.isNull() | (today > F.date_add(stamp, F.lit(age) + offset.cast("int")))


#: Hours beyond the window at which a walk over newest-first pages may stop.
MARGIN = 48


def freshness_cutoff(now: Column, hours: int = HOURS, margin: int = MARGIN) -> Column:
    """The oldest posting worth paging to."""
    return now - F.make_dt_interval(hours=F.lit(hours + margin))


def iso(moment: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, fractions only where there are any."""
    some = F.unix_micros(moment) % 1_000_000 != 0
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.when(some, F.date_format(moment, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def parse_iso(value: Column) -> Column:
    """A timestamp from ISO 8601 text, UTC where it names no zone; null for anything else."""
    t = F.trim(value)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    return F.when(t.rlike(shape), F.replace(t, F.lit(","), F.lit(".")).try_cast("timestamp"))
