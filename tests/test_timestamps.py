from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from quaystone.functions.instants import read_instant, zone_segments
from quaystone.operators.timestamps import instants, to_utc


def micros(*a, zone="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "text, zone, want",
    [
        ("Fri, 10 Jan 2025 00:49:43 -0600", None, micros(2025, 1, 10, 6, 49, 43)),
        ("Mon, 06 Jan 2025 01:41:33 -0500 (EST)", "Asia/Kolkata", micros(2025, 1, 6, 6, 41, 33)),
        ("Friday, 10-Jan-25 11:04:03 GMT", None, micros(2025, 1, 10, 11, 4, 3)),
        ("2025-01-06T16:29:19.087233590+0800", None, micros(2025, 1, 6, 8, 29, 19, 87233)),
        ("2025-01-06 10:50:55.650+00", None, micros(2025, 1, 6, 10, 50, 55, 650000)),
        ("2025-01-06T13:19:23-06:00[America/Chicago]", None, micros(2025, 1, 6, 19, 19, 23)),
        ("20250121T074917Z", None, micros(2025, 1, 21, 7, 49, 17)),
        ("1736271605", "Asia/Tokyo", 1736271605_000000),
        ("1736256627655", None, 1736256627655_000),
        ("1/12/2025 3:06:33 AM", "Europe/Berlin", micros(2025, 1, 12, 2, 6, 33)),
        ("1/11/2025 12:52 AM CET", None, micros(2025, 1, 10, 23, 52)),
        ("11.01.2025 00:34:00", "Europe/Berlin", micros(2025, 1, 10, 23, 34)),
        ("05.01.2025 23:29 Uhr", "Europe/Berlin", micros(2025, 1, 5, 22, 29)),
        ("11. März 2025, 00:47", "Europe/Berlin", micros(2025, 3, 10, 23, 47)),
        ("23 de enero de 2025 15:11", "UTC", micros(2025, 1, 23, 15, 11)),
        ("13 août 2025 à 13h17", "Europe/London", micros(2025, 8, 13, 12, 17)),
        ("January 12, 2025 5:06 p.m.", "America/New_York", micros(2025, 1, 12, 22, 6)),
        ("2025-11-02 01:30:00", "America/New_York", micros(2025, 11, 2, 5, 30)),  # twice: the first
        ("2025-03-09 02:30:00", "America/New_York", micros(2025, 3, 9, 7, 30)),  # skipped: offset before
        ("2025-01-06 02:53:02", None, None),
        ("2025-01-06 02:53:02", "Nowhere/Land", None),
        ("Thu, 31 Jun 2026 10:00:00 +0000", None, None),
        ("2026-13-04T09:00:00Z", None, None),
        ("yesterday 14:05", "UTC", None),
        ("2025-12-19", "UTC", None),
        ("0000-00-00 00:00:00", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("1850-06-01 12:00:00", "UTC", micros(1850, 6, 1, 12)),
        ("2300-06-01 12:00:00", "Asia/Kolkata", micros(2300, 6, 1, 6, 30)),
    ],
)
def test_forms(spark, text, zone, want):
    df = spark.createDataFrame([(text, zone, 1, 2)], "t string, z string, utc_micros int, _zone int")
    assert to_utc(df, "t", "z", True).first().utc_micros == want


def test_segments_agree_with_the_tz_database():
    for zone in ("America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata", "Africa/Casablanca"):
        tz, segments = ZoneInfo(zone), zone_segments(zone, 2023, 2026)
        for s in range(int(datetime(2023, 6, 1, tzinfo=timezone.utc).timestamp()), int(datetime(2026, 6, 1, tzinfo=timezone.utc).timestamp()), 7_200 + 600):
            naive = datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None)
            n, shift = next((n, o) for lo, hi, n, o in segments if lo <= s * 1_000_000 < hi)
            real = {int(naive.replace(tzinfo=tz, fold=f).utcoffset().total_seconds()) for f in (0, 1)}
            matches = {o for o in real if datetime.fromtimestamp(s - o, tz).replace(tzinfo=None) == naive}
            assert len(matches) == n and (shift in matches or n == 0) and shift == int(naive.replace(tzinfo=tz, fold=0).utcoffset().total_seconds())


def test_text_around_and_look_alikes():
    assert read_instant("e-signed on Tuesday, 22-Sep-26 11:34:58 GMT for the goodwill", False)[1] == 0
    assert read_instant("(Thu, 10 Apr 2025 16:20:26 -0400 (EDT)) approved", False)[1] == -14400
    for text in ("Ticket 762-994-5069-2 covers version 4.7.10.", "year ended 2025-12-19, discount 177.3k", "ratio 10:30 of 2025", "call 1736271605"):
        assert read_instant(text, False) is None
    assert read_instant("x" * 200_000 + " 2025-01-06 02:53:02", False)[0] == micros(2025, 1, 6, 2, 53, 2)


def test_tables_with_nulls_and_none(spark):
    m, s = "delivery_id long, date_raw string, mailbox_tz string", "span_id long, snippet string, doc_tz string"
    assert instants(spark.createDataFrame([], m), spark.createDataFrame([], s)).count() == 0
    got = instants(spark.createDataFrame([(1, None, None), (2, "1736271605", None)], m), spark.createDataFrame([(1, "at 2025-01-06 02:53:02", "UTC"), (2, None, None)], s))
    assert {(r.src_table, r.row_id) for r in got.collect()} == {("messages", 2), ("spans", 1)}


def test_a_zone_in_brackets_counts_whatever_the_records_name(spark):
    rows = [("2025-03-01T10:00[Europe/Zurich]", None), ("2025-07-01T10:00:00[America/Sao_Paulo]", "Europe/Berlin"), ("2025-03-01T10:00[Nowhere/Land]", "UTC")]
    got = [r.utc_micros for r in to_utc(spark.createDataFrame(rows, "t string, z string"), "t", "z", True).collect()]
    assert got == [micros(2025, 3, 1, 9), micros(2025, 7, 1, 13), None]
    within = to_utc(spark.createDataFrame([("signed 2025-03-01T10:00[Europe/Zurich] by hand", None)], "t string, z string"), "t", "z", False)
    assert within.first().utc_micros == micros(2025, 3, 1, 9)


@pytest.mark.parametrize(
    "text, want",
    [
        ("5 March 2025, 9am", ("2025-03-05 09:00", None, None)),
        ("March 5, 2025 at 9 pm EST", ("2025-03-05 21:00", -18000, None)),
        ("05.03.2025 14.30 Uhr", ("2025-03-05 14:30", None, None)),
        ("3 mai 2025 à 10h", ("2025-05-03 10:00", None, None)),
        ("2025-03-01 10:00 AKST", ("2025-03-01 10:00", -32400, None)),
        ("2025-03-01T10:00 [Europe/Zurich]", ("2025-03-01 10:00", None, "Europe/Zurich")),
        ("2025-03-01 10:00 Europe/Zurich", ("2025-03-01 10:00", None, "Europe/Zurich")),
        ("2025-03-01 10:00 QQST", None),
        ("3 May 2025", None),
    ],
)
def test_rarer_forms(text, want):
    from datetime import datetime, timezone

    from quaystone.functions.instants import read_instant

    got = read_instant(text, True)
    if want is None:
        assert got is None
    else:
        assert (datetime.fromtimestamp(got[0] / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M"), *got[1:]) == want
