"""Periods named in questions, resolved against a given day."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

_MONTHS = [m[:3] for m in "january february march april may june july august september october november december".split()]


def _month(y: int, m: int) -> tuple[date, date]:
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return date(y, m, 1), date(y, m, monthrange(y, m)[1])


def period_of(question: str, today: date) -> tuple[date, date] | None:
    """First and last day of the first period a question names, None without one."""
    q = question.lower()
    quarter = (today.month - 1) // 3
    if m := re.search(r"\blast (\d+) days?\b", q):
        return today - timedelta(days=int(m[1])), today
    if m := re.search(r"\bq([1-4])(?:\s+(\d{4}))?\b", q):
        y = int(m[2]) if m[2] else today.year
        return date(y, 3 * int(m[1]) - 2, 1), _month(y, 3 * int(m[1]))[1]
    if "last quarter" in q:
        return _month(today.year, 3 * quarter - 2)[0], _month(today.year, 3 * quarter)[1]
    if "this quarter" in q:
        return date(today.year, 3 * quarter + 1, 1), today
    if "last month" in q:
        return _month(today.year, today.month - 1)
    if "this month" in q:
        return today.replace(day=1), today
    if "last year" in q:
        return date(today.year - 1, 1, 1), date(today.year - 1, 12, 31)
    if "this year" in q or "year to date" in q:
        return date(today.year, 1, 1), today
    if "yesterday" in q:
        return today - timedelta(days=1), today - timedelta(days=1)
    if re.search(r"\btoday\b", q):
        return today, today
    # the modal verb "may" is no month unless a year or "in" stands beside it
    for m in re.finditer(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b(?:,?\s+(\d{4}))?", q):
        word = m[0].split()[0].strip(",")
        if not any(full.startswith(word) for full in "january february march april may june july august september sept october november december".split()):
            continue
        if word == "may" and not m[2] and not re.search(r"\b(?:in|for|during|of|since)\s+$", q[: m.start()]):
            continue
        y = int(m[2]) if m[2] else today.year - (_MONTHS.index(m[1]) + 1 > today.month)
        return _month(y, _MONTHS.index(m[1]) + 1)
    if m := re.search(r"\b(20\d\d)\b", q):
        return date(int(m[1]), 1, 1), date(int(m[1]), 12, 31)
    return None


def baseline_of(start: date, end: date) -> tuple[date, date]:
    """The whole month before a whole month, else as many days before."""
    if start.day == 1 and end == _month(start.year, start.month)[1]:
        return _month(start.year, start.month - 1)
    return start - (end - start) - timedelta(days=1), start - timedelta(days=1)
