"""Phrases that name days, anchored at a day of a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases and the span that each names.
SPANS = {
    "今天": "today", "今日": "today", "昨天": "yesterday", "昨日": "yesterday", "前天": "day before", "本周": "week", "这周": "week", "上周": "last week", "上一周": "last week",
    "本月": "month", "这个月": "month", "上月": "last month", "上个月": "last month",
}
LAST_DAYS, RECENT, RECENT_NUMBERED, RECENT_DAYS = r"(?:最近|近|过去)\s*(\d+)\s*天", "最近", r"最近\s*\d+\s*天", 7
SINGLE = {"today": 0, "今天": 0, "今日": 0, "yesterday": 1, "昨天": 1, "昨日": 1, "前天": 2}
SINGLE_WEEKS = {"本周": 0, "这周": 0, "上周": 7}
MOST_DAYS = 100_000  # a greater number of days names no span


def local_day(at: Column, zone: str) -> Column:
    """The day of an instant (a timestamp of a UTC session) in a zone, whatever its clock does that day."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def monday(today: Column) -> Column:
    return F.to_date(F.date_trunc("week", today))


def spans(today: Column) -> dict[str, tuple[Column, Column]]:
    week, month = monday(today), F.to_date(F.date_trunc("month", today))
    return {
        "today": (today, today), "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)), "day before": (F.date_sub(today, 2), F.date_sub(today, 2)),
        "week": (week, today), "last week": (F.date_sub(week, 7), F.date_sub(week, 1)), "month": (month, today), "last month": (F.add_months(month, -1), F.date_sub(month, 1)),
    }


def range_of(question: Column, today: Column) -> Column:
    """struct<start, end>, days: from the earliest start to the latest end of all spans that a question names; nulls if it
    names none. A null question names none."""
    low = F.lower(F.trim(question))
    named = spans(today)
    starts, ends = [], []
    for phrase, span in SPANS.items():
        hit = F.contains(low, F.lit(phrase))
        starts.append(F.when(hit, named[span][0]))
        ends.append(F.when(hit, named[span][1]))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(LAST_DAYS), F.lit(1)), lambda n: n.try_cast("int"))
    most = F.array_max(F.filter(numbers, lambda n: n.isNotNull() & (n <= MOST_DAYS)))
    recent = F.contains(low, F.lit(RECENT)) & ~low.rlike(RECENT_NUMBERED)
    starts += [F.when(most.isNotNull(), F.date_sub(today, most)), F.when(recent, F.date_sub(today, RECENT_DAYS))]
    ends += [F.when(most.isNotNull() | recent, today)]
    return F.struct(F.least(*starts).alias("start"), F.greatest(*ends).alias("end"))


def single_day(text: Column, today: Column) -> Column:
    """The day (yyyy-MM-dd) that a word names; another text stays, in lower case; null is today."""
    low, out = F.lower(F.coalesce(text, F.lit("today"))), F
    for words, day in ((SINGLE, lambda n: F.date_sub(today, n)), (SINGLE_WEEKS, lambda n: F.date_sub(monday(today), n))):
        for word, n in words.items():
            out = out.when(low == word, F.date_format(day(n), "yyyy-MM-dd"))
    return out.otherwise(low)
