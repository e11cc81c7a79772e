"""Dates of the hand-made panels."""

import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def month(i: int) -> dt.date:
    """First day of the i-th month counted from January 2000."""
    return dt.date(2000 + i // 12, i % 12 + 1, 1)
