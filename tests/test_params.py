from __future__ import annotations

import pytest

from tripflow import TripWindow


def test_defaults():
    w = TripWindow()
    assert w.hours == [11, 12, 13, 14]
    assert w.days == [11, 12, 13]
    assert w.top_k == 14


def test_hours_wrap_past_midnight_or_stop_there():
    assert TripWindow(hour_start=22).hours == [22, 23, 0, 1]
    assert TripWindow(hour_start=22, wrap=False).hours == [22, 23]


def test_days_after_the_28th_are_left_out():
    assert TripWindow(day_start=27).days == [27, 28, 29]
    assert TripWindow(day_start=30).days == [30, 31]
    assert TripWindow(day_start=27, common_days=True).days == [27, 28]


@pytest.mark.parametrize("number", [0, 23, 24, 25, 999, 123456])
def test_from_id(number):
    w = TripWindow.from_id(number)
    assert w.hour_start == number % 24
    assert w.day_start == number % 25 + 1
    assert w.top_k == number % 11 + 10


@pytest.mark.parametrize(
    "bad", [{"hour_start": 24}, {"hour_count": 0}, {"day_start": 0}, {"day_start": 29, "common_days": True}, {"top_k": 0}]
)
def test_impossible_values_are_refused(bad):
    with pytest.raises(ValueError):
        TripWindow(**bad)
