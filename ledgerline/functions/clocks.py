"""Clock and service-day arithmetic on zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86400
# The service day starts at 04:00; demand slots run 06:00-23:00 by ten minutes.
SERVICE_DAY_START_S = 4 * 3600
SLOT_OPEN_MIN, SLOT_CLOSE_MIN, SLOT_MIN = 6 * 60, 23 * 60, 10
SLOTS_PER_DAY = (SLOT_CLOSE_MIN - SLOT_OPEN_MIN) // SLOT_MIN
# Slot edges of the six uneven periods 06-10-13-16-19-21-23 o'clock.
PERIOD_EDGES = [0, 24, 42, 60, 78, 90, 102]


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone."""
    return (F.unix_date(ts.cast("date")) * F.lit(86_400_000_000)
            + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
            + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint"))


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970."""
    return (F.unix_date(ts.cast("date")).cast("bigint") * DAY_S
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def service_date(ts: Column) -> Column:
    """Day to which an event belongs when days begin at 04:00."""
    return (ts - F.expr(f"INTERVAL '{SERVICE_DAY_START_S}' SECOND")).cast("date")


def service_second(ts: Column) -> Column:
    """Seconds since the start of the event's service day."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.pmod(clock - SERVICE_DAY_START_S + DAY_S, F.lit(DAY_S)).cast("bigint")


def clock_to_minutes(hhmmss: Column) -> Column:
    """Minutes of an HHMMSS integer, null unless it is a whole valid minute."""
    h, m, s = hhmmss / 10000, (hhmmss / 100) % 100, hhmmss % 100
    h, m = F.floor(h), F.floor(m)
    ok = (h >= 0) & (h < 24) & (m < 60) & (s == 0) & (hhmmss >= 0)
    return F.when(ok, (h * 60 + m).cast("int"))


def clock_to_slot(hhmmss: Column) -> Column:
    """Ten-minute slot 0..101 of an HHMMSS integer, null when off the grid or outside hours."""
    mins = clock_to_minutes(hhmmss)
    ok = (mins >= SLOT_OPEN_MIN) & (mins < SLOT_CLOSE_MIN) & (mins % SLOT_MIN == 0)
    return F.when(ok, F.floor((mins - SLOT_OPEN_MIN) / SLOT_MIN).cast("int"))


def minutes_to_clock(mins: Column) -> Column:
    return (F.floor(mins / 60) * 10000 + (mins % 60) * 100).cast("int")


def slot_start(slot: Column) -> Column:
    return minutes_to_clock(slot * SLOT_MIN + SLOT_OPEN_MIN)


def slot_end(slot: Column) -> Column:
    return minutes_to_clock((slot + 1) * SLOT_MIN + SLOT_OPEN_MIN)


def slot_period(slot: Column) -> Column:
    """Period 0..5 of a slot."""
    out = F.when(slot < PERIOD_EDGES[1], F.lit(0))
    for i in range(1, len(PERIOD_EDGES) - 1):
        out = out.when(slot < PERIOD_EDGES[i + 1], F.lit(i))
    return out


def gtfs_seconds(c: Column) -> Column:
    """Seconds of ``H:MM:SS`` with hours past 24 allowed; null when malformed."""
    p = F.split(F.trim(c), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, part(1) * 3600 + part(2) * 60 + part(3))


def compact_timestamp(c: Column) -> Column:
    """Timestamp of the first 14 digits ``yyyyMMddHHmmss``; null when fewer or invalid."""
    d = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9]", "")
    iso = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2), F.lit(" "),
                   F.substring(d, 9, 2), F.lit(":"), F.substring(d, 11, 2), F.lit(":"), F.substring(d, 13, 2))
    return F.when(F.length(d) >= 14, iso.try_cast("timestamp_ntz"))


def normal_date(c: Column) -> Column:
    """Date of ``YYYYMMDD`` or ISO text, a trailing ``.0`` dropped; null when neither."""
    s = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    compact = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(compact.rlike(r"^\d{4}-\d{2}-\d{2}$"), compact.try_cast("date"))
