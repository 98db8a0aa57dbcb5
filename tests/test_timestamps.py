from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from pressmill.operators import timestamps as ts

V = ts.zone_version()


def one(stamp, fmt=None, usual=None, home="Europe/Berlin", received=None):
    got = ts.convert([stamp], [fmt], [usual], [home], [received], V)[0]
    return None if np.isnan(got) else int(got)


def ms(*a, zone="UTC", extra=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp() * 1000) + extra


@pytest.mark.parametrize(
    ("stamp", "fmt", "home", "expected"),
    [
        ("04.03.2023 03:46", "dd.mm.yyyy hh:mm", "Europe/Berlin", ms(2023, 3, 4, 2, 46)),
        ("03/04/2023 03:46", "dd/mm/yyyy hh:mm", "Europe/London", ms(2023, 4, 3, 2, 46)),
        ("03/04/2023 03:46", "mm/dd/yyyy hh:mm", "America/New_York", ms(2023, 3, 4, 8, 46)),
        ("03/26/2023 02:19", "dd/mm/yyyy hh:mm", "America/New_York", ms(2023, 3, 26, 6, 19)),
        ("2024-05-08", "yyyy-mm-dd", "Asia/Tokyo", ms(2024, 5, 7, 15)),
        ("2023-10-29 02:30", "yyyy-mm-dd hh:mm", "Europe/Berlin", ms(2023, 10, 29, 0, 30)),  # twice: the earlier
        ("2024-03-31 02:30", "yyyy-mm-dd hh:mm", "Europe/Berlin", ms(2024, 3, 31, 1, 30)),  # never: moved forward
        ("2024-03-11 24:00", None, "UTC", ms(2024, 3, 12)),
        ("2023-10-29T02:15:15Z", None, None, ms(2023, 10, 29, 2, 15, 15)),
        ("2023-06-08T05:08:07.657836382Z", None, None, ms(2023, 6, 8, 5, 8, 7, extra=657)),
        ("20230820T213802Z", "dd-mm-yyyy hh:mm", None, ms(2023, 8, 20, 21, 38, 2)),
        ("2024-038T08:35:37Z", None, None, ms(2024, 2, 7, 8, 35, 37)),
        ("2023-W34-1T21:20:35+05:30", None, None, ms(2023, 8, 21, 15, 50, 35)),
        ("14 JAN 2024 07:29:54+01:00", None, None, ms(2024, 1, 14, 6, 29, 54)),
        ("1712614249", None, None, 1712614249000),
        ("1696450165059", None, None, 1696450165059),
        ("1685426566294779", None, None, 1685426566294),
        ("2024-04-24T01:43+02:00[Europe/Berlin]", None, None, ms(2024, 4, 23, 23, 43)),
        ("Wed, 07 Feb 2024 13:10:57 +0100", None, None, ms(2024, 2, 7, 12, 10, 57)),
        ("18 juillet 2023 à 07h34", None, "Europe/Paris", ms(2023, 7, 18, 5, 34)),
        ("2023年3月31日 20時02分", None, "Asia/Tokyo", ms(2023, 3, 31, 11, 2)),
        ("Mi., 29. Nov. 2023, 05:06 Uhr +01:00", None, None, ms(2023, 11, 29, 4, 6)),
        ("October 22, 2023 9:55 PM EST", None, None, ms(2023, 10, 23, 2, 55)),
        ("March 31, 2024 12:54 AM +01:00", None, None, ms(2024, 3, 30, 23, 54)),
        ("24.03.2024 19:11 UTC+1", None, None, ms(2024, 3, 24, 18, 11)),
        ("13.08.2023 05:49 GMT+02:00", None, None, ms(2023, 8, 13, 3, 49)),
        ("06.04.2023 03:54 MESZ", None, None, ms(2023, 4, 6, 1, 54)),
        ("17.07.2023 / 09:33 CET/CEST", None, None, ms(2023, 7, 17, 7, 33)),
        ("15.04.2023 / 16:12 Ortszeit Berlin", None, None, ms(2023, 4, 15, 14, 12)),
        (" 09/07/2023  22:42 +0200", "mm/dd/yyyy hh:mm", None, ms(2023, 9, 7, 20, 42)),
        ("2024-05-12 08:49", None, None, None),  # no zone
        ("2023-13-05 08:00", None, "UTC", None),
        ("31.02.2024 10:15", None, "UTC", None),
        ("30-02-2024 25:61", None, "UTC", None),
        ("0000-00-00 00:00:00", None, "UTC", None),
        ("2023-09", None, "UTC", None),
        ("2024", None, "UTC", None),
        ("gestern, 14:05", None, "UTC", None),
        ("18:11 Uhr", None, "UTC", None),
        ("n/a", None, "UTC", None),
        ("", None, "UTC", None),
        (None, None, "UTC", None),
        ("2024-02-29", None, "No/Where", None),
    ],
)
def test_notations(stamp, fmt, home, expected):
    assert one(stamp, fmt, None, home) == expected


def test_a_year_that_is_missing():
    received = int(datetime(2024, 1, 1, 12, tzinfo=timezone.utc).timestamp() * 1e6)
    assert one("31.12. 12:00", "dd.mm. hh:mm", received=received) == ms(2023, 12, 31, 11)
    assert one("01.01. 14:00", "dd.mm. hh:mm", received=received) == ms(2023, 1, 1, 13)
    assert one("01.01. 13:00", "dd.mm. hh:mm", received=received) == ms(2024, 1, 1, 12)
    assert one("29.02. 10:00", "dd.mm. hh:mm", received=received) == ms(2020, 2, 29, 9)
    assert one("31.12. 12:00", "dd.mm. hh:mm") is None


def test_zone_tables_agree_with_the_zone_database():
    rng = np.random.default_rng(0)
    for zone in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"):
        local = rng.integers(0, 1_900_000_000, 400)
        for x, u in zip(local, ts.to_utc(local, zone, V)):
            wall = datetime.fromtimestamp(int(x), timezone.utc).replace(tzinfo=ZoneInfo(zone))
            assert int(wall.timestamp()) == u


def test_frame(spark):
    raw = spark.createDataFrame(
        [(1, "a", "04.03.2023 03:46", None, None, 1), (1, "a", "04.03.2023 03:46", None, None, 1), (2, None, "2023-10-29T02:15:15Z", None, None, 1), (3, "b", "04.03.2023 03:46", None, None, 1), (4, "z", None, None, None, 1)],
        "raw_id bigint, art_source string, art_datetime string, manformat string, received_at timestamp, home int",
    )
    src = spark.createDataFrame([("a", "Europe/Berlin", "dd.mm.yyyy hh:mm"), ("b", None, None), (None, "UTC", None)], "art_source string, home_zone string, default_manformat string")
    got = sorted((r["raw_id"], r["utc_ms"]) for r in ts.normalise_timestamps(raw, src).where("utc_ms IS NOT NULL").collect())
    assert got == [(1, ms(2023, 3, 4, 2, 46))] * 2 + [(2, ms(2023, 10, 29, 2, 15, 15))]
    assert ts.normalise_timestamps(raw, src).count() == 5
    assert ts.normalise_timestamps(raw.limit(0), src).count() == 0
