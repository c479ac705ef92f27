"""Epoch milliseconds <-> timestamps, independent of the session time zone.

The change envelope carries ``ts_ms`` (connector time, epoch ms). The staged
``event_time`` is that instant at millisecond precision as a zone-less
timestamp. ``zone="UTC"`` (default) gives the UTC wall clock whatever the
session zone is; ``zone="session"`` reproduces a cast through the session's
local time (``TO_TIMESTAMP_LTZ(ms, 3)`` then ``CAST AS TIMESTAMP(3)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def event_time_from_ms(ms: Column | str, zone: str = "UTC") -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    if zone == "session":
        return F.timestamp_millis(ms).cast("timestamp_ntz")
    # TIMESTAMP_NTZ + day-time interval: no time zone is consulted
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    secs = (F.pmod(ms, F.lit(86_400_000)).cast("decimal(18,6)") / F.lit(1000)).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(days, F.lit(0), F.lit(0), secs)


def epoch_millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a zone-less timestamp (truncated to ms), from its
    date and time-of-day parts (no session time zone is involved)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    ts = ts.cast("timestamp_ntz")
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    sec = F.extract(F.lit("SECOND"), ts)  # decimal seconds with microseconds
    return (days * F.lit(86_400_000) + F.hour(ts).cast("long") * F.lit(3_600_000)
            + F.minute(ts).cast("long") * F.lit(60_000) + F.floor(sec * F.lit(1000)).cast("long"))


def run_time(at: Column | None = None) -> Column:
    """The time of a run as a zone-less UTC timestamp, the same in all rows of a query:
    ``at`` where a run is given its time, else the clock."""
    if at is not None:
        return at.cast("timestamp_ntz")
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def elapsed_ms(start: Column | str, end: Column | None = None) -> Column:
    """Milliseconds from ``start`` to ``end`` (default: now), both zone-less UTC timestamps."""
    return epoch_millis(run_time(end)) - epoch_millis(start)
