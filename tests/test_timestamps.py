from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickforge.operators.timestamps import NONE, date_orders, local_to_utc, normalise, parse_texts, to_instant, transitions, zone_version


def one(text, zone="UTC", order=""):
    x = parse_texts([text], [zone], [order])[0]
    return None if x == NONE else int(x)


def us(*args, micro=0):
    return int(datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-03-05T10:20:30Z", None, "", us(2024, 3, 5, 10, 20, 30)),
        ("  2024-03-05t10:20:30.123456789z\t", "Asia/Tokyo", "", us(2024, 3, 5, 10, 20, 30, micro=123456)),
        ("2024-03-05 10:20", "Asia/Tokyo", "", us(2024, 3, 5, 1, 20)),
        ("2024-03-05", "America/New_York", "", us(2024, 3, 5, 5)),
        ("2024-03-05 10:20:30,5", "UTC", "", us(2024, 3, 5, 10, 20, 30, micro=500000)),
        ("03/04/2024 1:02:03 pm", "UTC", "DMY", us(2024, 4, 3, 13, 2, 3)),
        ("03/04/2024 12:02:03 am", "UTC", "MDY", us(2024, 3, 4, 0, 2, 3)),
        ("03.04.2024", "UTC", "", None),
        ("13.04.2024", "UTC", "", us(2024, 4, 13)),
        ("04.13.2024", "UTC", "DMY", None),
        ("05.05.2024", "UTC", "", us(2024, 5, 5)),
        ("2024/2/29 09:00:01", "UTC", "", us(2024, 2, 29, 9, 0, 1)),
        ("2023-02-29", "UTC", "", None),
        ("17-Sep-2023 14:41:51", "UTC", "", us(2023, 9, 17, 14, 41, 51)),
        ("Sep 22, 2023 5:25:16 AM EDT", None, "", us(2023, 9, 22, 9, 25, 16)),
        ("Sun, 09 Feb 2025 19:44:27 +0900", None, "", us(2025, 2, 9, 10, 44, 27)),
        ("Mon, 09 Feb 2025 19:44:27 +0900", None, "", None),
        ("August 5, 2024, 8:27:09 AM", "UTC", "", us(2024, 8, 5, 8, 27, 9)),
        ("2024-11-03 01:30:00", "America/New_York", "", None),
        ("2024-03-10 02:30:00", "America/New_York", "", None),
        ("2024-11-03T01:30:00[America/New_York]", "UTC", "", None),
        ("2024-11-03 01:30:00 EST", "America/New_York", "", us(2024, 11, 3, 6, 30)),
        ("2024-11-09T11:51:40[Australia/Sydney]", None, "", us(2024, 11, 9, 0, 51, 40)),
        ("20240703T022633-0500", None, "", us(2024, 7, 3, 7, 26, 33)),
        ("20240703022633", "Asia/Kolkata", "", us(2024, 7, 2, 20, 56, 33)),
        ("20240703", "UTC", "", us(2024, 7, 3)),
        ("1759032927.682", None, "", 1759032927682000),
        ("1673894998", None, "", 1673894998000000),
        ("1731666920930", None, "", 1731666920930000),
        ("1730049686216703", None, "", 1730049686216703),
        ("9223372036854775807", None, "", 9223372036854775),
        ("2024-07-05T27:10:00+02:00", None, "", None),
        ("25:61", "UTC", "", None),
        ("pending", "UTC", "", None),
        ("", "UTC", "", None),
        (None, "UTC", "", None),
        ("2024-03-05 10:20:30", None, "", None),
        ("2024-03-05 10:20:30", "No/Where", "", None),
        ("2024-03-05 10:20:30 QQQ", "UTC", "", None),
        ("9" * 100_000, "UTC", "", None),
    ],
)
def test_texts(text, zone, order, want):
    assert one(text, zone, order) == want


@given(st.integers(0, 4_000_000_000), st.sampled_from(["UTC", "America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata"]))
@settings(max_examples=200, deadline=None)
def test_local_round_trip(second, zone):
    from zoneinfo import ZoneInfo

    local = datetime.fromtimestamp(second, ZoneInfo(zone)).replace(tzinfo=None)
    got = local_to_utc(np.array([int((local - datetime(1970, 1, 1)).total_seconds()) * 1_000_000]), zone)[0]
    other = datetime.fromtimestamp(second, ZoneInfo(zone)).fold or local.replace(fold=1, tzinfo=ZoneInfo(zone)).utcoffset() != local.replace(tzinfo=ZoneInfo(zone)).utcoffset()
    assert got == (NONE if other else second * 1_000_000)


def test_normalise_learns_orders_and_keeps_rows(spark):
    rows = [("a", "25/12/2024", 1), ("a", "03/04/2024", 2), ("b", "12/25/2024", 3), ("b", "03/04/2024", 4), (None, "03/04/2024", 5), ("c", "03/04/2024", 6), ("a", None, 7), ("a", "03/04/2024", 2)]
    df = spark.createDataFrame(rows, "source string, t string, id int").selectExpr("*", "'x' as date_order", "1 as tz_name")
    clocks = spark.createDataFrame([("a", "UTC"), ("b", "UTC"), ("c", "UTC"), (None, "UTC")], "source string, tz_name string")
    got = {(r["id"]): r["us"] for r in normalise(df, clocks, "t", "us").collect()}
    assert got == {1: us(2024, 12, 25), 2: us(2024, 4, 3), 3: us(2024, 12, 25), 4: us(2024, 3, 4), 5: None, 6: None, 7: None}
    assert normalise(df, clocks, "t", "us").count() == len(rows)
    assert normalise(df.limit(0), clocks, "t", "us").count() == 0
    assert {r["source"]: r["date_order"] for r in date_orders(df, "source", "t").collect()} == {"a": "DMY", "b": "MDY", "c": None}


def test_sources_without_clock_and_odd_bytes(spark):
    df = spark.createDataFrame([("x", "25/12/2024 10:00 +02:00", 1), ("x", "03/04/2024 10:00 +02:00", 2), ("x", "03/04/2024", 3), ("x", "2024\u00a001\u00a002", 4), ("x", "\u00a02024-01-02T00:00Z\u2003", 5), ("x", "२०२४-01-02", 6)], "source string, t string, id int")
    clocks = spark.createDataFrame([("y", "UTC")], "source string, tz_name string")
    got = {r["id"]: r["us"] for r in normalise(df, clocks, "t", "us").collect()}
    assert got == {1: us(2024, 12, 25, 8), 2: us(2024, 4, 3, 8), 3: None, 4: None, 5: us(2024, 1, 2), 6: None}


def test_other_zone_tables_are_refused(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2024-01-02",)], "t string")
    with pytest.raises(Exception, match="zone tables"):
        df.select(to_instant(F.col("t"), F.lit("UTC"), F.lit(""), "1970z")).collect()


def test_zone_tables():
    assert transitions("No/Where") is None and len(transitions("UTC")[0]) == 1 and zone_version()
