"""Timestamps: durations, parsing of untrusted text, hours in a named zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text form of times in the trip files; ours keep all six digits.
ISO_MILLIS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS"
ISO_MICROS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PLAIN_MICROS_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"

_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?$"
_STAMP = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?)(?:Z|([+-])(\d{2}):?(\d{2}))?$"


def whole_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, as a long; fractions of a second are cut off each."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes from start to end as a double (a decimal literal would give a decimal)."""
    return whole_seconds(start, end) / F.lit(60.0)


def parse_timestamp(text: Column, pattern: str = ISO_MILLIS_PATTERN) -> Column:
    """Text in exactly this pattern to wall-clock time; null where it does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def normalise_iso(text: Column, zone: str = "UTC", wall_clock: bool = False) -> Column:
    """Wall-clock time from the whole of an ISO-like text; null where the text is anything else.

    Date and time are parted by ``T`` or a blank; a fraction is kept to the microsecond. A text
    with an offset (or ``Z``) names an instant, which is shown in ``zone``; with ``wall_clock`` the
    offset is ignored instead. A text without one is wall-clock time already. The session zone
    is never used, so no daylight-saving gap can move a value. Texts without an offset, as in most
    files, are cast as they are; only others are taken apart.
    """

    def part(group: int) -> Column:
        return F.regexp_extract(text, _STAMP, group)

    stamp = F.concat_ws(" ", part(1), part(2)).try_cast("timestamp_ntz")
    if not wall_clock:
        minutes = part(4).try_cast("int") * 60 + part(5).try_cast("int")
        east = F.when(part(3) == "-", -minutes).otherwise(minutes)
        offset = F.make_dt_interval(mins=F.coalesce(east, F.lit(0)))
        shown = F.convert_timezone(F.lit("UTC"), F.lit(zone), stamp - offset)
        named = (part(3) != "") | text.endswith("Z")
        stamp = F.when(named, shown).otherwise(stamp)
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp_ntz")).when(text.rlike(_STAMP), stamp)


def hour_in_zone(utc_wall_clock: Column, zone: str) -> Column:
    """Hour of day in a named zone of a UTC wall-clock time; the session zone is not touched."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_wall_clock))
