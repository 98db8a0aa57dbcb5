"""Timestamps of many notations and zones as one instant in UTC.

Each stamp is reduced to a shape mask of its length: digits become 9, words
the sign of their class (month, weekday, zone, ...). A distinct mask is matched
to the grammar once, which gives the places of the fields; all stamps of that
mask are then cut and converted as columns. Local times go through zone
transition tables, which carry the version of the zone database they are from.
"""

from __future__ import annotations

import re
import unicodedata as ud
import zoneinfo
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.plans.arrow import map_batches

#: Names of months in the languages of the feeds (fixed values), January first.
MONTHS = """january januar jänner janvier enero gennaio januari jan
february februar février fevrier febrero febbraio februari feb febr fév févr
march märz maerz mars marzo maart mar mrz mär mrt
april avril abril aprile apr avr abr
may mai mayo maggio mei
june juni juin junio giugno jun giu
july juli juillet julio luglio jul juil lug
august août aout agosto augustus aug ago
september septembre septiembre settembre sep sept set
october oktober octobre octubre ottobre oct okt ott
november novembre noviembre nov
december dezember décembre decembre diciembre dicembre dec dez déc dic""".split("\n")
WEEKDAYS = """monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun
montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so
lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim
lunes martes miércoles jueves viernes sábado domingo lunedì martedì mercoledì giovedì venerdì sabato domenica
maandag dinsdag woensdag donderdag vrijdag zaterdag zondag"""
FILLERS = "uhr um at à a las alle om the of de del den le il el ortszeit zeit time local h le"
#: Minutes from UTC of zone names as they are written (fixed values).
OFFSETS = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "sast": 120,
}
#: Where a name has another meaning in a home zone.
HOME_OFFSETS = {("cst", "Asia/Shanghai"): 480, ("ist", "Europe/Dublin"): 60, ("ist", "Asia/Jerusalem"): 120}
#: The zone whose local time the first of several joined names means.
JOINED = {"cet": "Europe/Berlin", "cest": "Europe/Berlin", "mez": "Europe/Berlin", "mesz": "Europe/Berlin", "gmt": "Europe/London", "bst": "Europe/London", "est": "America/New_York", "edt": "America/New_York", "cst": "America/Chicago", "cdt": "America/Chicago", "mst": "America/Denver", "mdt": "America/Denver", "pst": "America/Los_Angeles", "pdt": "America/Los_Angeles", "aest": "Australia/Sydney", "aedt": "Australia/Sydney", "wet": "Europe/Lisbon", "west": "Europe/Lisbon", "eet": "Europe/Athens", "eest": "Europe/Athens"}

_WORD_CLASS: dict[str, str] = {}
for _w in FILLERS.split():
    _WORD_CLASS[_w] = "f"
for _w in WEEKDAYS.split():
    _WORD_CLASS[_w] = "W"
_MONTH_OF = {w: k for k, line in enumerate(MONTHS, 1) for w in line.split()}
_WORD_CLASS |= dict.fromkeys(OFFSETS, "Z") | dict.fromkeys(_MONTH_OF, "M") | dict.fromkeys(("am", "pm", "nachm", "vorm"), "P")
_WORD_CLASS |= {"年": "Y", "月": "N", "日": "D", "号": "D", "時": "H", "时": "H", "点": "H", "點": "H", "分": "I", "秒": "S", "t": "T", "w": "w"}

_PIECES = re.compile(r"[A-Za-z]+(?:/[A-Za-z]+(?:_[A-Za-z]+)*)+|[年月日号時时点點分秒]|[^\W\d_]+|\d")
_DATE = (
    r"(?P<y>9{4})(?P<m>99)(?P<d>99)(?!9{1,3}(?!9)\W)",
    r"(?P<y>9{4})-?w(?P<week>99)-?(?P<wd>9)",
    r"(?P<y>9{4})-(?P<doy>999)(?!9)",
    r"(?P<y>9{4})[-/.](?P<m>9{1,2})[-/.](?P<d>9{1,2})(?!9)",
    r"(?P<y>9{4}) ?Y ?(?P<m>9{1,2}) ?N ?(?P<d>9{1,2}) ?D",
    r"(?P<a>9{1,2})(?P<sep>[./\- ])(?P<b>9{1,2})(?P=sep)(?P<y>9{4}|99)(?![9:])",
    r"(?:W+[.,]* ?)?(?:f+ )?(?P<d>9{1,2})(?:\.|th|st|nd|rd)? ?(?:f+ )?(?P<mon>M+)\.?,? (?:f+ )?(?P<y>9{4})",
    r"(?:W+[.,]* ?)?(?P<mon>M+)\.? (?P<d>9{1,2}),? (?P<y>9{4})",
    r"(?P<a>9{1,2})\.(?P<b>9{1,2})\.(?!9)",
    r"(?:W+[.,]* ?)?(?P<d>9{1,2})\.? (?P<mon>M+)\.?(?! ?9{4})",
)
_TIME = (
    r"(?:[ ,/]*(?:T|f+)?[ ,]*(?P<h>9{1,2})[:fH.](?P<mi>99)(?:[:.](?P<s>99)(?:[.,](?P<f>9+))?)?I?(?: ?(?P<ap>P+)\.?)?(?: ?f+)?)",
    r"(?:T?(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,](?P<f>9+))?)",
    r"",
)
_ZONE = (
    r"(?: ?(?P<sign>[+\-−])(?P<oh>99):?(?P<om>99)(?: ?\[(?P<iana>X+)\]| ?\((?:Z+|X+)\))?)",
    r"(?: ?(?P<utc>Z+)(?P<sign>[+\-−])(?P<oh>9{1,2})(?::?(?P<om>99))?)",
    r"(?: ?(?P<join>J+))",
    r"(?: ?\[?(?P<iana>X+)\]?)",
    r"(?: f+ (?P<city>C+))",
    r"(?: ?\(?(?P<abbr>Z+)\)?)",
    r"",
)
_EPOCH = re.compile(r"(?P<n>9{10}|9{13}|9{16}|9{19})(?:\.9+)?\Z")


@lru_cache(maxsize=1)
def _cities() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in sorted(zoneinfo.available_timezones()):
        if "/" in name and not name.startswith(("Etc/", "posix/", "right/", "SystemV/", "US/", "Canada/", "Mexico/", "Brazil/", "Chile/")):
            out.setdefault(name.rpartition("/")[2].lower().replace("_", " "), name)
    return out


@lru_cache(maxsize=50_000)
def _word(word: str) -> str:
    low = word.lower()
    if "/" in word:
        parts = low.split("/")
        return ("J" if all(p in OFFSETS for p in parts) else "X") * len(word)
    kind = _WORD_CLASS.get(low)
    if kind is None:
        kind = "C" if low in _cities() else "x"
    return kind * len(word)


def clean(stamp: str) -> str:
    """Blanks of any kind as one blank, compatibility forms as plain ones."""
    s = ud.normalize("NFKC", stamp)
    s = "".join(c for c in s if ud.category(c) != "Cf")
    return " ".join(s.split())


def shape(stamp: str) -> str:
    """The mask of a cleaned stamp, of the same length."""
    return _PIECES.sub(lambda m: "9" if m.group().isdigit() else _word(m.group()), stamp)


@lru_cache(maxsize=20_000)
def parser(mask: str) -> dict[str, tuple[int, int]] | None:
    """The places of the fields in stamps of this mask; None where the mask names no day."""
    m = _EPOCH.match(mask)
    if m:
        return {"epoch": m.span("n")}
    for date in _DATE:
        for time in _TIME:
            for zone in _ZONE:
                m = re.match(rf"{date}{time}{zone}[ .]*\Z", mask)
                if m and not (re.search(r"\(\?P<h>", time) is None and zone and "y" not in m.groupdict()):
                    return {k: m.span(k) for k, v in m.groupdict().items() if v}
    return None


def zone_version() -> str:
    """The version of the zone database in use."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            try:
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    return f.readline().strip("# \n").removeprefix("version ")
            except OSError:
                continue
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(name: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Local boundaries in seconds and the offsets between them; times that occur twice or never take the offset before the change."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    utc = timezone.utc
    offset = lambda t: int(datetime.fromtimestamp(t, utc).astimezone(zone).utcoffset().total_seconds())
    start, stop, step = int(datetime(1900, 1, 2, tzinfo=utc).timestamp()), int(datetime(2100, 1, 1, tzinfo=utc).timestamp()), 7 * 86400
    bounds, offsets, now = [], [offset(start)], start
    while now < stop:
        nxt = now + step
        if (new := offset(nxt)) != offsets[-1]:
            lo, hi = now, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if offset(mid) != offsets[-1] else (mid, hi)
            new = offset(hi)
            bounds.append(hi + max(offsets[-1], new))
            offsets.append(new)
            now = hi
            continue
        now = nxt
    return np.array(bounds, np.int64), np.array(offsets, np.int64)


def to_utc(local: np.ndarray, zone: str, version: str) -> np.ndarray | None:
    table = zone_table(zone, version)
    return None if table is None else local - table[1][np.searchsorted(table[0], local, "right")]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of valid dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _leap(y: np.ndarray) -> np.ndarray:
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


_LENGTH = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _valid(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    length = _LENGTH[np.clip(m, 0, 12)] + ((m == 2) & _leap(y))
    return ok & (d <= length)


def _month_first(manformat: str | None, default: str | None, sep: str) -> bool:
    """Whether the notation, or else the source's usual one, puts the month before the day."""
    for f in (manformat, default):
        f = (f or "").lower()
        d, m = f.find("dd"), f.find("mm")
        if d >= 0 and m >= 0 and not f.startswith("yyyy") and (sep in f or not any(s in f for s in "./-")):
            return m < d
    return False


def convert(stamps: list, formats: list, defaults: list, homes: list, received: list, version: str) -> np.ndarray:
    """Milliseconds since 1970 in UTC of each stamp, as floats, not-a-number where there is none.

    ``received`` is in microseconds, or None.
    """
    out = np.full(len(stamps), np.nan)
    cleaned = [clean(s) if s else "" for s in stamps]
    groups: dict[str, list[int]] = {}
    for i, s in enumerate(cleaned):
        if s:
            groups.setdefault(shape(s), []).append(i)
    for mask, rows in groups.items():
        place = parser(mask)
        if place is None:
            continue
        cut = lambda k, rows=rows, place=place: [cleaned[i][slice(*place[k])] for i in rows]
        number = lambda k, cut=cut: np.array(cut(k), dtype=np.int64)
        n = len(rows)
        at = np.array(rows)
        if "epoch" in place:
            e, digits = number("epoch"), place["epoch"][1] - place["epoch"][0]
            out[at] = {10: lambda: e * 1000, 13: lambda: e, 16: lambda: e // 1000, 19: lambda: e // 1_000_000}[digits]()
            continue
        zero = np.zeros(n, np.int64)
        hour, minute, second = (number(k) if k in place else zero for k in ("h", "mi", "s"))
        if "ap" in place:
            pm = np.array([x.lower().startswith(("p", "n")) for x in cut("ap")])
            hour_ok = (hour >= 1) & (hour <= 12)
            hour = hour % 12 + 12 * pm
        else:
            hour_ok = (hour < 24) | ((hour == 24) & (minute == 0) & (second == 0))
        ok = hour_ok & (minute < 60) & (second <= 60)
        milli = np.array([int((x + "00")[:3]) for x in cut("f")], np.int64) if "f" in place else zero
        clock = hour * 3600 + minute * 60 + second
        year = number("y") if "y" in place else None
        if year is not None and place["y"][1] - place["y"][0] == 2:
            year = year + 2000
        if "week" in place:
            week, wd = number("week"), number("wd")
            jan4 = _days(year, zero + 1, zero + 4)
            monday = jan4 - (jan4 + 3) % 7
            weeks = 52 + np.isin((_days(year, zero + 12, zero + 31) + 3) % 7, 3) + (np.isin((_days(year, zero + 1, zero + 1) + 3) % 7, 3) & ~np.isin((_days(year, zero + 12, zero + 31) + 3) % 7, 3))
            ok &= (week >= 1) & (week <= weeks) & (wd >= 1) & (wd <= 7) & (year >= 1)
            day = monday + (week - 1) * 7 + wd - 1
        elif "doy" in place:
            doy = number("doy")
            ok &= (doy >= 1) & (doy <= 365 + _leap(year)) & (year >= 1)
            day = _days(year, zero + 1, zero + 1) + doy - 1
        else:
            if "a" in place:
                a, b = number("a"), number("b")
                sep = mask[place["a"][1]]
                first = np.array([_month_first(formats[i], defaults[i], sep) for i in rows])
                if sep == "/":
                    first = np.where(first & (a > 12) & (b <= 12), False, np.where(~first & (b > 12) & (a <= 12), True, first))
                month, dom = np.where(first, a, b), np.where(first, b, a)
            else:
                month = np.array([_MONTH_OF[x.lower()] for x in cut("mon")]) if "mon" in place else number("m")
                dom = number("d")
            if year is None:
                day = None
            else:
                good = _valid(year, month, dom)
                ok &= good
                day = _days(np.where(good, year, 2000), np.where(good, month, 1), np.where(good, dom, 1))

        def instants(day: np.ndarray, keep: np.ndarray, rows=rows, place=place, cut=cut, number=number, clock=clock) -> tuple[np.ndarray, np.ndarray]:
            """Seconds in UTC and which are known."""
            local = np.asarray(day, np.int64) * 86400 + clock
            if "sign" in place:
                minutes = number("oh") * 60 + (number("om") if "om" in place else 0)
                minutes = minutes * np.array([1 if x == "+" else -1 for x in cut("sign")])
                return local - minutes * 60, keep & (np.abs(minutes) <= 18 * 60)
            if "abbr" in place:
                minutes = np.array([HOME_OFFSETS.get((x.lower(), homes[i]), OFFSETS[x.lower()]) for x, i in zip(cut("abbr"), rows)])
                return local - minutes * 60, keep
            if "join" in place:
                zones = [JOINED.get(x.lower().split("/")[0]) for x in cut("join")]
            elif "iana" in place:
                zones = cut("iana")
            elif "city" in place:
                zones = [_cities().get(x.lower()) for x in cut("city")]
            else:
                zones = [homes[i] for i in rows]
            utc, known = local.copy(), keep.copy()
            for z in set(zones):
                these = np.array([x == z for x in zones])
                there = to_utc(local[these], z, version) if z else None
                if there is None:
                    known[these] = False
                else:
                    utc[these] = there
            return utc, known

        if day is not None:
            utc, known = instants(day, ok)
        else:
            until = np.array([received[i] if received[i] is not None else -1 for i in rows], np.int64)
            last = np.array([datetime.fromtimestamp(t / 1e6 + 86400, timezone.utc).year if t >= 0 else 0 for t in until])
            utc, known = np.zeros(n, np.int64), np.zeros(n, bool)
            for back in range(9):
                y = last - back
                good = ok & ~known & (until >= 0) & _valid(y, month, dom)
                if not good.any():
                    continue
                u, k = instants(_days(np.where(good, y, 2000), np.where(good, month, 1), np.where(good, dom, 1)), good)
                k &= u * 1_000_000 + milli * 1000 <= until
                utc, known = np.where(k, u, utc), known | k
        out[at] = np.where(known, utc * 1000.0 + milli, np.nan)
    return out


def normalise_timestamps(raw: DataFrame, sources: DataFrame, id_col: str = "raw_id", stamp_col: str = "art_datetime", format_col: str = "manformat", source_col: str = "art_source", received_col: str = "received_at") -> DataFrame:
    """(raw_id, utc_ms, zone_version) of every row; ``utc_ms`` is null for stamps that name no instant.

    A row whose source is unknown or null has no home zone. A stamp without a
    year needs a ``received_at``. Null, empty and blank stamps, impossible days and
    times give null; rows that occur twice come out twice; other columns are left out.
    """
    version = zone_version()
    home = sources.where(F.col("art_source").isNotNull()).groupBy(F.col("art_source").alias("src")).agg(F.min("home_zone").alias("home"), F.min("default_manformat").alias("usual"))
    rows = raw.select(F.col(id_col).alias("raw_id"), F.col(stamp_col).alias("stamp"), F.col(format_col).alias("fmt"), F.col(source_col).alias("src"), F.unix_micros(received_col).alias("received"))
    joined = rows.join(home, "src", "left").select("raw_id", "stamp", "fmt", "usual", "home", "received")
    kind = joined.schema["raw_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ms = convert(*(batch.column(i).to_pylist() for i in range(1, 6)), version)
            missing = np.isnan(ms)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(missing, 0, ms).astype(np.int64), mask=missing), pa.array([version] * batch.num_rows)], ["raw_id", "utc_ms", "zone_version"])

        return step

    return map_batches(joined, make, f"raw_id {kind}, utc_ms bigint, zone_version string")
