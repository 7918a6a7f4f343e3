from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from terrane.operators.timestamps import normalize_timestamps, order_instants

STORES = [("NY", "America/New_York", "mdy"), ("LON", "Europe/London", "dmy"), ("KOL", "Asia/Kolkata", "dmy"), ("TYO", "Asia/Tokyo", "ymd")]


def instants(spark, values):
    pos = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(values)], "pos_row bigint, store_id string, order_date string")
    zones = spark.createDataFrame(STORES, "store_id string, time_zone string, date_order string")
    rows = order_instants(pos, zones).collect()
    return {r.pos_row: (r.ts_status, r.ts_us) for r in rows}


def utc(*parts, tz="UTC"):
    return int(datetime(*parts, tzinfo=ZoneInfo(tz)).timestamp() * 1_000_000)


CASES = [
    ("NY", "2024-01-05T10:00:00", ("ok", utc(2024, 1, 5, 10, tz="America/New_York"))),
    (None, "2024-01-05T10:00:00", ("no_zone", None)),
    (None, " 2024-01-05T10:00:00Z ", ("ok", utc(2024, 1, 5, 10))),
    ("NY", "2024-11-03 01:30:00", ("ambiguous", None)),
    ("NY", "03 Nov 2024 01:30:00 EDT", ("ok", utc(2024, 11, 3, 5, 30))),
    ("NY", "2024-03-10 02:30:00", ("skipped", None)),
    ("KOL", "01 Jan 2024 05:30:00 IST", ("ok", utc(2024, 1, 1))),
    ("NY", "01 Jan 2024 05:30:00 IST", ("no_zone", None)),
    ("NY", "03/04/2024 1:05 PM", ("ok", utc(2024, 3, 4, 13, 5, tz="America/New_York"))),
    ("LON", "03/04/2024 13:05", ("ok", utc(2024, 4, 3, 13, 5, tz="Europe/London"))),
    ("TYO", "2024/04/03 13:05", ("ok", utc(2024, 4, 3, 13, 5, tz="Asia/Tokyo"))),
    ("TYO", "03/04/2024 13:05", ("unreadable", None)),
    ("NY", "04.03.2024 13:05:00", ("ok", utc(2024, 3, 4, 13, 5, tz="America/New_York"))),
    ("NY", "1700000000", ("ok", 1_700_000_000_000_000)),
    ("NY", "1700000000123", ("ok", 1_700_000_000_123_000)),
    ("NY", "12345", ("unreadable", None)),
    ("NY", "2024-02-30T10:00:00Z", ("unreadable", None)),
    ("NY", "2024-02-03", ("unreadable", None)),
    ("NY", "2024-02-03T24:00:00Z", ("unreadable", None)),
    ("NY", "2024-02-03T10:00:60Z", ("unreadable", None)),
    (None, "2024-06-01T09:46:12[America/Chicago]", ("ok", utc(2024, 6, 1, 9, 46, 12, tz="America/Chicago"))),
    (None, "2024-06-01T09:46:12-05:00[Europe/Nowhere]", ("ok", utc(2024, 6, 1, 14, 46, 12))),
    ("NY", "2024-01-01 00:00:00 +0545", ("ok", utc(2023, 12, 31, 18, 15))),
    ("NY", "20240103T214441Z", ("ok", utc(2024, 1, 3, 21, 44, 41))),
    ("NY", "Mon, 01 Jan 2024 10:00:00 GMT", ("ok", utc(2024, 1, 1, 10))),
    ("NY", "Tue, 01 Jan 2024 10:00:00 GMT", ("unreadable", None)),
    ("NY", "Jan 5, 2024 12:05 AM", ("ok", utc(2024, 1, 5, 0, 5, tz="America/New_York"))),
    ("NY", "2024-01-01T00:00:00.123999999Z", ("ok", utc(2024, 1, 1) + 123_999)),
    ("NY", None, ("empty", None)),
    ("NY", "   ", ("empty", None)),
    ("NY", "x" * 100_000, ("unreadable", None)),
]


def test_cases(spark):
    got = instants(spark, [(s, v) for s, v, _ in CASES])
    assert {i: w for i, (_, _, w) in enumerate(CASES)} == got


def test_wall_times_against_zoneinfo(spark):
    walls = [(m, d, h, 30) for m in (3, 4, 10, 11) for d in (1, 3, 9, 10, 27, 30, 31) for h in (0, 1, 2, 3) if not (m in (4, 11) and d == 31)]
    values = [("LON", f"2024-{m:02d}-{d:02d}T{h:02d}:{mi:02d}:00") for m, d, h, mi in walls]
    got = instants(spark, values)
    tz = ZoneInfo("Europe/London")
    for i, (m, d, h, mi) in enumerate(walls):
        early, late = (datetime(2024, m, d, h, mi, tzinfo=tz, fold=f) for f in (0, 1))
        if early.utcoffset() == late.utcoffset():
            assert got[i] == ("ok", int(early.timestamp() * 1e6))
        else:
            assert got[i][0] in ("ambiguous", "skipped") and got[i][1] is None


@pytest.mark.parametrize("rows", [[], [(1, "NY", "2024-01-05T10:00:00Z", "mine")]])
def test_clashing_columns_and_empty(spark, rows):
    pos = spark.createDataFrame(rows, "pos_row bigint, z string, order_date string, ts_us string")
    out = normalize_timestamps(pos, "order_date", "z")
    assert dict(out.dtypes)["ts_us"] == "bigint" and out.count() == len(rows)


def test_contradicting_zone_rows_give_no_zone(spark):
    pos = spark.createDataFrame([(1, "A", "2024-01-05T10:00:00")], "pos_row bigint, store_id string, order_date string")
    zones = spark.createDataFrame([("A", "UTC", "mdy"), ("A", "Asia/Tokyo", "mdy")], "store_id string, time_zone string, date_order string")
    assert [(r.ts_status, r.ts_us) for r in order_instants(pos, zones).collect()] == [("no_zone", None)]
