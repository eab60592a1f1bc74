"""Written dates against the public dateutil library, which reads free text the same way."""

import datetime as dt

import pytest
from dateutil import parser
from pyspark.sql import functions as F

from harrow.functions import dates

NOW = dt.datetime(2023, 6, 14, 9, 30, tzinfo=dt.timezone.utc)
MOMENT = dt.datetime(2023, 5, 3, 10, 4, 5)
#: strftime forms; all of them hold a date that can be read off.
FORMS = """%Y-%m-%d|%Y/%m/%d|%Y-%m-%dT%H:%M:%S|%Y-%m-%dT%H:%M:%SZ|%Y-%m-%dT%H:%MZ|%Y-%m-%dT%H:%M:%S.123456Z|%Y-%m-%dT%H:%M:%S.123Z|%Y-%m-%dT%H:%M:%S+00:00
%Y-%m-%dT%H:%M:%S+0000|%Y-%m-%dT%H:%M:%S-05:00|%Y-%m-%dT%H:%M:%S+0530|%Y-%m-%d %H:%M:%S|%Y-%m-%d %H:%M:%S+00:00|%Y-%m-%d %H:%M:%S -0700|%Y-%m-%d %H:%M|%Y-%m-%d %I:%M %p
%m/%d/%Y|%m/%d/%y|%m-%d-%Y|%m/%d/%Y %H:%M|%m/%d/%Y %I:%M:%S %p|%d-%b-%Y|%d-%B-%y|%d %b %Y|%d %B %Y|%d %b %y|%dth of %B, %Y|%d %B %Y %H:%M
%B %d, %Y|%b %d, %Y|%b. %d, %Y|%B %dth, %Y|%b %d %Y %I:%M %p|%B %d, %Y %I:%M %p|%A, %B %d, %Y|%a, %d %b %Y %H:%M:%S GMT|%a, %d %b %Y %H:%M:%S +0200|%A %d %B %Y|%a %b %d %H:%M:%S %Y
%Y %b %d|%Y-%b-%d|%B %Y|%b %d|%d %B|Posted on: %Y-%m-%d|Date posted: %B %d, %Y|Published %d %b %Y|closing %B %d, %Y at noon|%B %d, %Y, %I %p|%H:%M|%I:%M %p|%A %H:%M|%d/%m/%Y %H:%M""".replace("\n", "|").split("|")
NONE = ["Building 7", "Suite 200", "Req 12345", "Team 4", "$120,000 - $150,000", "5 openings", "Full-time", "Level 3", "", None, "2030-01-01", "1998-01-01", "Feb 30, 2023", "2023-13-45", "25:61", "marketing manager", "10/2", "  "]


def parsed(spark, texts, now=NOW):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    at = F.lit(now.isoformat()).cast("timestamp")
    out = {r.i: r.u for r in rows.select("i", F.unix_micros(dates.parse(F.col("t"), at)).alias("u")).collect()}
    return [None if out[i] is None else dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=out[i]) for i in range(len(texts))]


def by_library(text, now=NOW):
    for word in ("Posted on:", "Date posted:", "Published "):
        text = text.removeprefix(word).strip()
    out = parser.parse(text.lower(), fuzzy=True, default=now.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None))
    return out if out.tzinfo else out.replace(tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("moment", [MOMENT, dt.datetime(2023, 6, 13, 23, 59, 59), dt.datetime(2022, 12, 31, 0, 0, 1), dt.datetime(2023, 2, 28, 12, 0, 0)])
def test_all_forms(spark, moment):
    texts = [moment.strftime(f) for f in FORMS]
    assert len(texts) >= 50
    for text, got in zip(texts, parsed(spark, texts), strict=True):
        want = by_library(text)
        inside = NOW - dt.timedelta(days=dates.MAX_AGE_DAYS) <= want <= NOW + dt.timedelta(days=dates.AHEAD_DAYS)
        assert got == (want if inside else None), text


def test_every_day_of_two_years(spark):
    days = [NOW - dt.timedelta(days=k, hours=k % 24) for k in range(730)]
    texts = [d.strftime(FORMS[k % len(FORMS)]) for k, d in enumerate(days)]
    for text, got in zip(texts, parsed(spark, texts), strict=True):
        want = by_library(text)
        inside = NOW - dt.timedelta(days=dates.MAX_AGE_DAYS) <= want <= NOW + dt.timedelta(days=dates.AHEAD_DAYS)
        assert got == (want if inside else None), text


def test_no_dates(spark):
    assert parsed(spark, NONE) == [None] * len(NONE)


def test_phrases_and_epochs(spark):
    got = parsed(spark, ["Posted 3 Days Ago", "Posted Today", "Yesterday", "just posted", "30+ days ago", "1683108245", "1683108245000", "2 hrs old"])
    d = dt.timedelta
    assert got == [NOW - d(days=3), NOW, NOW - d(days=1), NOW, NOW - d(days=30), dt.datetime(2023, 5, 3, 10, 4, 5, tzinfo=dt.timezone.utc), dt.datetime(2023, 5, 3, 10, 4, 5, tzinfo=dt.timezone.utc), NOW - d(hours=2)]


def test_missing_parts_come_from_now(spark):
    late = dt.datetime(2023, 3, 31, 12, 0, tzinfo=dt.timezone.utc)
    assert parsed(spark, ["Feb 2023", "10:30 am", "Feb 3"], late) == [dt.datetime(2023, 2, 28, tzinfo=dt.timezone.utc), dt.datetime(2023, 3, 31, 10, 30, tzinfo=dt.timezone.utc), dt.datetime(2023, 2, 3, tzinfo=dt.timezone.utc)]
