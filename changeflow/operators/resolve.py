"""Latest state per key, change history, and the delete rule of the post-hook.

Latest-per-key has two plans with the same result:

* ``method="window"``: ``row_number() OVER (PARTITION BY key ORDER BY
  event_time DESC, seq DESC, pos DESC, pos2 DESC) = 1``. Catalyst turns the
  ``= 1`` filter into a WindowGroupLimit that keeps one row per key inside each
  map partition before the shuffle, so a hot key ships at most one row per
  input partition.
* ``method="max_by"``: ``max_by(struct(row), struct(order))`` grouped by
  key, with partial aggregation before the shuffle (same bound).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.time import epoch_millis
from changeflow.schemas import ORDER_COLUMNS

ARRIVAL_ORDER = ("seq", "pos", "pos2")


def order_columns(df: DataFrame, order=ORDER_COLUMNS) -> list[str]:
    return [c for c in order if c in df.columns]


def latest_per_key(df: DataFrame, keys, order=ORDER_COLUMNS, method: str = "window") -> DataFrame:
    keys = list(keys)
    order = order_columns(df, order)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    if method == "max_by":
        rest = [c for c in df.columns if c not in keys]
        picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
        return df.groupBy(*keys).agg(picked).select(*keys, "_r.*").select(*df.columns)
    raise ValueError("method must be 'window' or 'max_by'")


def current_state(stg: DataFrame, keys, order=ORDER_COLUMNS, method: str = "window") -> DataFrame:
    """Latest event per key, dropped when that event is a delete."""
    latest = latest_per_key(stg, keys, order, method)
    return latest.filter(F.col("op") != F.lit("d"))


def history(stg: DataFrame, keys, order=ORDER_COLUMNS, time_col: str = "event_time",
            method: str = "slices", slice_ms: int = 86_400_000) -> DataFrame:
    """Every event of a key in order, numbered (``version``), with the time the
    next event of the same key took over (``valid_to``, NULL for the current).

    ``method="slices"`` (default, skew-safe) deals the events of a key out by fixed
    slices of their time, which come first in the order: rows are numbered inside
    their slice, and a small aggregate per ``(key, slice)`` gives each slice its
    offset and the first time of the key's next one. The slice is an expression of
    the row alone, and keys are joined null-safely. No task sorts more than one
    slice of a key. ``method="window"``: ``row_number`` / ``lead`` over
    ``PARTITION BY key``; one task sorts all events of a key.
    """
    keys = list(keys)
    order = order_columns(stg, order)
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
        return (stg.withColumn("version", F.row_number().over(w))
                   .withColumn("valid_to", F.lead(time_col).over(w)))
    if method != "slices":
        raise ValueError("method must be 'slices' or 'window'")
    if not order or order[0] != time_col:
        raise ValueError("method='slices' needs the time column first in the order")
    s = stg.withColumn("_slice", F.floor(epoch_millis(time_col) / F.lit(slice_ms)))
    inside = Window.partitionBy("_slice", *keys).orderBy(*[F.col(c).asc() for c in order])
    s = (s.withColumn("_rn", F.row_number().over(inside))
          .withColumn("_lead", F.lead(time_col).over(inside))
          .withColumn("_last", F.lead(F.lit(True)).over(inside).isNull()))
    pieces = stg.withColumn("_slice", F.floor(epoch_millis(time_col) / F.lit(slice_ms)))
    pieces = pieces.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_t0"))
    along = Window.partitionBy(*keys).orderBy(F.col("_slice").asc())
    before = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("_slice").alias("_p__slice"), *[F.col(k).alias(f"_p_{k}") for k in keys],
                           F.coalesce(before, F.lit(0)).alias("_off"), F.lead("_t0").over(along).alias("_next_t"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}"))
                                       for c in ["_slice", *keys]])
    return (s.join(pieces, same)
             .withColumn("version", (F.col("_off") + F.col("_rn")).cast("int"))
             .withColumn("valid_to", F.when(F.col("_last"), F.col("_next_t")).otherwise(F.col("_lead")))
             .select(*stg.columns, "version", "valid_to"))


def max_arrival(stg: DataFrame, keys, order=ARRIVAL_ORDER) -> DataFrame:
    """``MAX(arrival order) GROUP BY key`` as one struct column ``_max``."""
    order = order_columns(stg, order)
    return stg.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_max"))


def dead_keys(stg: DataFrame, keys, order=ARRIVAL_ORDER, method: str = "agg") -> DataFrame:
    """Keys whose last-arrived staging row is a delete.

    The rule of the delete post-hook: arrival order only, no event time. A key
    with a NULL part never matches, as with SQL ``IN``.

    ``method="agg"``: one aggregate, ``max_by(op, arrival)`` per key, with
    partial aggregation before the shuffle (a hot key costs one row per map
    partition). ``method="join"``: the literal form, staging joined with its
    per-key ``MAX(arrival)`` (AQE splits a skewed join partition).
    """
    keys = list(keys)
    order = order_columns(stg, order)
    if method == "agg":
        last = stg.groupBy(*keys).agg(F.max_by("op", F.struct(*order)).alias("_op"))
        nn = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        return last.filter((F.col("_op") == F.lit("d")) & nn).select(*keys)
    m = max_arrival(stg, keys, order)
    s = stg.select(*keys, "op", F.struct(*order).alias("_o"))
    cond = [s[k] == m[k] for k in keys] + [s["_o"] == m["_max"]]
    return (s.join(m, cond, "inner").filter(s["op"] == F.lit("d"))
             .select(*[s[k] for k in keys]))


def dead_keys_correlated(stg: DataFrame, keys, order=ARRIVAL_ORDER) -> DataFrame:
    """Same rule written as a correlated scalar subquery
    (``s.seq = (SELECT MAX(seq) FROM stg s2 WHERE s2.key = s.key)``);
    Catalyst decorrelates it into an aggregate and a join."""
    keys = list(keys)
    order = order_columns(stg, order)
    s = stg.alias("s")
    s2 = stg.alias("s2")
    corr = None
    for k in keys:
        c = F.col(f"s2.{k}") == F.col(f"s.{k}").outer()
        corr = c if corr is None else corr & c
    sub = s2.where(corr).select(F.max(F.struct(*[F.col(f"s2.{c}") for c in order]))).scalar()
    return (s.where((F.col("s.op") == F.lit("d")) &
                    (F.struct(*[F.col(f"s.{c}") for c in order]) == sub))
             .select(*[F.col(f"s.{k}").alias(k) for k in keys]))
