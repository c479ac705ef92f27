"""Keyed merges as pure DataFrame functions: ``(target, changes) -> new target``.

All merges are "anti join + union": the target minus the keys being replaced
or removed, plus the new rows. Catalyst plans the anti join as a broadcast
hash join when AQE measures the change side under the broadcast threshold at
run time, and as a shuffle join on the key otherwise; no broadcast is forced.
Key equality is SQL equality: a NULL key part never matches (pipelines
route such rows to rejects before merging).

Strategies:

* ``merge_upsert``           - last arrival wins, deletes not applied.
* ``merge_delete_insert``    - replace the rows of the keys in the new rows.
* ``apply_deletes``          - remove keys (post-hook).
* ``run_model``              - full-rescan / incremental model: latest by event
                               time, delete+insert, then the post-hook.
* ``merge_batch``            - one staging slice: remove every touched key,
                               insert the latest non-deleted row of each.
* ``rebuild``                - current state from the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from changeflow.operators.filters import drop_deletes, incremental_filter
from changeflow.operators.resolve import ARRIVAL_ORDER, current_state, dead_keys, latest_per_key
from changeflow.schemas import ORDER_COLUMNS


def _cols(target: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*target.columns)


def merge_upsert(target: DataFrame, changes: DataFrame, keys, order=ARRIVAL_ORDER,
                 method: str = "window", exact: bool = False) -> DataFrame:
    """Upsert: per key the last-arrived change replaces the stored row.
    Deletes are not applied (filter them out of ``changes`` first).

    ``exact=True`` ranks by event time instead (``ORDER_COLUMNS``) and includes
    the stored row of each touched key, so a late, older event does not
    replace newer state; the target must carry the order columns.
    """
    keys = list(keys)
    if exact:
        order = [c for c in ORDER_COLUMNS if c in target.columns]
        if not order:
            raise ValueError("exact=True needs a target that stores the order columns "
                             f"{list(ORDER_COLUMNS)} (e.g. TableSet(keep_order=True))")
        stored = target.join(changes.select(*keys).distinct(), keys, "left_semi")
        changes = changes.select(*target.columns).unionByName(stored)
    latest = latest_per_key(changes, keys, order, method)
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(_cols(target, latest))


def merge_delete_insert(target: DataFrame, new_rows: DataFrame, keys) -> DataFrame:
    """delete+insert: drop target rows whose key is in ``new_rows``, add ``new_rows``."""
    keys = list(keys)
    return target.join(new_rows.select(*keys), keys, "left_anti").unionByName(_cols(target, new_rows))


def apply_deletes(target: DataFrame, dead: DataFrame, keys) -> DataFrame:
    """Remove the given keys from the target."""
    keys = list(keys)
    return target.join(dead.select(*keys), keys, "left_anti")


def model_rows(stg: DataFrame, keys, columns, order=ORDER_COLUMNS, method: str = "window") -> DataFrame:
    """Latest event per key by event time (arrival order breaks ties), non-deletes."""
    return current_state(stg, keys, order, method).select(*columns)


def run_model(target: DataFrame, stg: DataFrame, keys, columns, *, incremental: bool = False,
              time_col: str = "event_time", target_time_col: str = "source_event_time",
              order=ORDER_COLUMNS, method: str = "window", post_hook: bool = True) -> DataFrame:
    """One model run.

    ``incremental=True`` reads only staging rows with ``time_col >= MAX(target
    time)`` (inclusive, over the whole target, epoch when empty). The post-hook
    then removes keys whose last-arrived staging row is a delete, over all of
    staging (arrival order only).
    """
    keys = list(keys)
    src = incremental_filter(stg, target, time_col, target_time_col) if incremental else stg
    out = merge_delete_insert(target, model_rows(src, keys, columns, order, method), keys)
    if post_hook:
        out = apply_deletes(out, dead_keys(stg, keys), keys)
    return out


def merge_batch(target: DataFrame, batch: DataFrame, keys, columns=None, order=ORDER_COLUMNS,
                method: str = "window", exact: bool = False, observed: Observation | None = None) -> DataFrame:
    """Merge one staging slice.

    Every key touched by the slice is removed from the target, then the
    latest row of the slice per key is inserted unless it is a delete.
    ``exact=True`` also ranks the stored row of a touched key (the target then
    carries ``event_time`` and the arrival columns), so an older event arriving
    later does not overwrite newer state. A target that carries ``op`` too keeps a
    deleted key as a tombstone (``op = 'd'``), so that an event older than the delete
    can't revive it; :func:`drop_deletes` gives the visible rows. Without ``op``
    every stored row counts as live and deletes aren't remembered. ``observed`` (not exact)
    takes ``rows_merged`` and ``keys_touched`` of :func:`batch_metrics` from what is merged.
    """
    keys = list(keys)
    columns = list(columns or target.columns)
    if exact:
        order_cols = [c for c in order if c in target.columns]
        if not order_cols:
            raise ValueError("exact=True needs a target that stores the order columns "
                             f"{list(order)} (e.g. TableSet(keep_order=True))")
        cand_cols = list(dict.fromkeys([*columns, "op", *order_cols]))
        tombstones = "op" in target.columns
        stored = target.join(batch.select(*keys).distinct(), keys, "left_semi")
        if not tombstones:
            stored = stored.withColumn("op", F.lit("u"))
        cand = batch.select(*cand_cols).unionByName(stored.select(*cand_cols))
        latest = latest_per_key(cand, keys, order_cols, method)
        if not tombstones:
            latest = drop_deletes(latest)
    else:
        latest = latest_per_key(batch, keys, order, method)
        if observed:
            latest = latest.observe(observed, F.count_if(F.col("op") != "d").alias("rows_merged"), F.count(F.lit(1)).alias("keys_touched"))
        latest = drop_deletes(latest)
    touched = batch.select(*keys).distinct()
    return (target.join(touched, keys, "left_anti")
            .unionByName(latest.select(*target.columns)))


def rebuild(stg: DataFrame, keys, columns, order=ORDER_COLUMNS, method: str = "window") -> DataFrame:
    """Outputs from scratch: current state over the whole staging history."""
    return model_rows(stg, keys, columns, order, method)


def advance_watermark(batch: DataFrame, last, col: str = "seq") -> DataFrame:
    """One row: ``COALESCE(MAX(col), last)``; an empty slice keeps ``last``."""
    return batch.agg(F.coalesce(F.max(col), F.lit(last).cast("long")).alias("watermark"))


def advance_watermarks(batch: DataFrame, watermarks: DataFrame, by: str = "entity",
                       col: str = "seq") -> DataFrame:
    """Per-entity watermarks ``(by, watermark)`` advanced over ``batch``:
    ``COALESCE(MAX(col) of rows past the old watermark, old watermark)``.

    The watermark table has one row per entity (a fixed, small set), so
    Spark may broadcast it by its size; the max is a partial aggregate.
    """
    wm = watermarks.select(by, F.col("watermark").alias("_last"))
    newer = (batch.join(wm, by).filter(F.col(col) > F.col("_last"))
             .groupBy(by).agg(F.max(col).alias("_m")))
    return wm.join(newer, by, "left").select(by, F.coalesce("_m", "_last").alias("watermark"))


def batch_metrics(batch: DataFrame, keys, last, order=ORDER_COLUMNS, col: str = "seq",
                  by=()) -> DataFrame:
    """Per slice (or per ``by`` group): rows :func:`merge_batch` inserts (latest
    non-deleted per key), keys touched, and the advanced watermark.
    Two aggregates, both combined map-side; nothing is joined."""
    keys, by = list(keys), list(by)
    order = [c for c in order if c in batch.columns]
    per_key = batch.groupBy(*by, *keys).agg(F.max_by("op", F.struct(*order)).alias("_op"),
                                            F.max(col).alias("_mx"))
    return per_key.groupBy(*by).agg(
        F.count_if(F.col("_op") != F.lit("d")).alias("rows_merged"),
        F.count(F.lit(1)).alias("keys_touched"),
        F.coalesce(F.max("_mx"), F.lit(last).cast("long")).alias("watermark"))
