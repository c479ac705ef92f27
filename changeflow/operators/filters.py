"""Op filters, image projection, change metadata and incremental predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.functions.time import event_time_from_ms
from changeflow.schemas import OPS_NO_DELETE


def filter_ops(df: DataFrame, ops=OPS_NO_DELETE, col: str = "op") -> DataFrame:
    """Keep events whose op is in ``ops`` (``('c','r','u')`` drops deletes)."""
    return df.filter(F.col(col).isin(*ops))


def image(df: DataFrame, how: str = "after", keep=None) -> DataFrame:
    """Project the row image of each event to ``id, data, created_at, updated_at``.

    ``how="after"``: the after-image. ``how="coalesce"``: field by field the
    after value, else the before value, so a delete carries its before-image
    and a non-null after field always wins. ``how="before"``: the before-image.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in ("before", "after")]
    fields = ("id", "data", "created_at", "updated_at")
    if how == "after":
        cols = [F.col(f"after.{f}").alias(f) for f in fields]
    elif how == "before":
        cols = [F.col(f"before.{f}").alias(f) for f in fields]
    elif how == "coalesce":
        cols = [F.coalesce(F.col(f"after.{f}"), F.col(f"before.{f}")).alias(f) for f in fields]
    else:
        raise ValueError("how must be 'after', 'before' or 'coalesce'")
    return df.select(*keep, *cols)


def with_change_meta(df: DataFrame, zone: str = "UTC", ts_col: str = "ts_ms") -> DataFrame:
    """Add ``event_time``: the connector time at ms precision, zone-less."""
    return df.withColumn("event_time", event_time_from_ms(ts_col, zone))


def drop_deletes(df: DataFrame, col: str = "op") -> DataFrame:
    """``op != 'd'`` (a NULL op is dropped too, as in SQL)."""
    return df.filter(F.col(col) != F.lit("d"))


def since_watermark(stg: DataFrame, lo, hi=None, col: str = "seq") -> DataFrame:
    """Rows past the watermark ``lo`` and not past ``hi`` (one upper bound per
    batch: the same bound is used to read and to advance)."""
    cond = F.col(col) > F.lit(lo) if not hasattr(lo, "_jc") else F.col(col) > lo
    if hi is not None:
        cond = cond & (F.col(col) <= (hi if hasattr(hi, "_jc") else F.lit(hi)))
    return stg.filter(cond)


def since_positions(events: DataFrame, positions: dict, until: dict | None = None, by: str = "partition",
                    col: str = "seq") -> DataFrame:
    """Rows at or past a position vector, partition -> next offset, and before ``until``.

    A log's offsets grow within a partition only, so one number can't tell what is new. A
    partition that ``positions`` doesn't name is new as a whole; one that ``until`` doesn't
    name has no rows yet. The bounds are literals per partition, which a scan can use.
    """
    def at(vector: dict, past: bool):
        cond = ~F.col(by).isin([int(p) for p in vector]) if past else F.lit(False)
        for p, n in sorted(vector.items()):
            cond = cond | ((F.col(by) == int(p)) & (F.col(col) >= n if past else F.col(col) < n))
        return cond
    out = events.filter(at(positions, True)) if positions else events
    return out if until is None else out.filter(at(until, False))


def next_positions(events: DataFrame, positions: dict, by: str = "partition", col: str = "seq") -> dict:
    """The vector after ``events`` (one row per partition comes to the driver)."""
    ends = {str(p): n for p, n in events.groupBy(by).agg((F.max(col) + 1).alias("n")).collect() if p is not None}
    return {**positions, **{p: max(n, positions.get(p, 0)) for p, n in ends.items()}}


def max_time(target: DataFrame, col: str = "source_event_time",
             default: str = "1970-01-01 00:00:00") -> DataFrame:
    """One-row frame: ``COALESCE(MAX(col), default)`` over the whole target."""
    return target.agg(F.coalesce(F.max(col), F.lit(default).cast("timestamp_ntz")).alias("_hwm"))


def incremental_filter(stg: DataFrame, target: DataFrame, time_col: str = "event_time",
                       target_time_col: str = "source_event_time",
                       default: str = "1970-01-01 00:00:00", eager: bool = True) -> DataFrame:
    """Events at or after the newest time already in the target (inclusive).

    ``eager=True`` (default) computes the bound first (one aggregate over the
    target, one value to the driver) and filters with a literal, so the
    predicate is pushed into the staging scan (parquet min/max skipping).
    ``eager=False`` keeps it as an uncorrelated scalar subquery in one plan.
    """
    bound = max_time(target, target_time_col, default)
    if eager:
        # carried as text: a zone-less timestamp stays zone-less on the way back
        hwm = bound.select(F.col("_hwm").cast("string").alias("_hwm")).first()["_hwm"]
        return stg.filter(F.col(time_col) >= F.lit(hwm).cast("timestamp_ntz"))
    return stg.filter(F.col(time_col) >= bound.scalar())
