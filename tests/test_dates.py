import datetime as dt

import pytest
from pyspark.sql import functions as F

from broadsheet.functions import dates
from broadsheet.operators.timebins import assign_bins

D = dt.date


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("1900-01-02", D(1900, 1, 2)),
        (" 1900/01/02 ", D(1900, 1, 2)),
        ("1900.1.2", D(1900, 1, 2)),
        ("19000102", D(1900, 1, 2)),
        ("1900-01-02T10:00:00Z", D(1900, 1, 2)),
        ("1900/01/02T10:00", D(1900, 1, 2)),
        ("1900-01-02 10:00:00", D(1900, 1, 2)),
        ("1900-01/02", None),
        ("1900-13-02", None),
        ("1900", None),
        ("1900-05", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(rows, raw, expected):
    assert rows([(raw,)], "d string").select(dates.parse_date(F.col("d")).alias("v")).first().v == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("1900.01.02", "1900-01-02"), ("about 1900T", "about 1900"), (None, ""), ("  x ", "x")],
)
def test_format_date(rows, raw, expected):
    assert rows([(raw,)], "d string").select(dates.format_date(F.col("d")).alias("v")).first().v == expected


def test_month_end_edges_step_from_the_edge_before():
    edges = dates.bin_edges(D(1900, 1, 31), D(1900, 4, 30), "months", 1)
    assert edges == [D(1900, 1, 31), D(1900, 2, 28), D(1900, 3, 28), D(1900, 4, 28), D(1900, 5, 28)]


def test_end_on_an_edge_gets_its_own_bin(rows):
    edges = dates.bin_edges(D(1900, 1, 1), D(1900, 3, 1), "months", 1)
    assert edges[-1] == D(1900, 4, 1)
    df = rows([(D(1900, 3, 1),), (D(1899, 1, 1),)], "date date")
    got = {r.date: r.time_bin for r in assign_bins(df, edges).collect()}
    assert got == {D(1900, 3, 1): "1900-03-01", D(1899, 1, 1): None}


def test_leap_day_and_units():
    assert dates.step(D(1904, 2, 29), "year", 1) == D(1905, 2, 28)
    assert dates.step(D(1900, 12, 31), "month", 2) == D(1901, 2, 28)
    assert dates.step(D(1900, 1, 1), "week", 2) == D(1900, 1, 15)
    with pytest.raises(ValueError):
        dates.bin_edges(D(1900, 1, 1), D(1900, 2, 1), "moons", 1)
    with pytest.raises(ValueError):
        dates.bin_edges(D(1900, 1, 1), D(1900, 2, 1), "months", 0)


@pytest.mark.parametrize("text, day", [
    ("1900-01-02 garbage", None), ("12345-01-01", None), ("1900-01-02 23:59:59.5+01:00", "1900-01-02"), ("1900-01-02 24:00", None),
    ("1900-01-02 07:30", "1900-01-02"), ("1900-1-2", "1900-01-02"), ("1900-02-30", None),
])
def test_dates_are_strict(rows, text, day):
    found = rows([(text,)], "t string").select(dates.parse_date(F.col("t")).cast("string")).first()[0]
    assert found == day


def test_parse_bin():
    assert dates.parse_bin("2 weeks") == (2, "week")
    assert dates.parse_bin("monthly") == (1, "month")
    assert dates.parse_bin("x weeks") == (1, "month")


def test_frame_times_are_at_least_two():
    assert dates.frame_times(D(1900, 1, 5), D(1900, 1, 9), "month", 1) == [D(1900, 1, 5), D(1900, 2, 5)]
    assert len(dates.frame_times(D(1900, 1, 5), D(1900, 3, 5), "month", 1)) == 3


@pytest.mark.parametrize("bad", [("1900-1-x", "1900-02-01"), ("1900-02-01", "1900-01-01")])
def test_day_range_is_checked(bad):
    with pytest.raises(ValueError):
        dates.day_range(*bad)
