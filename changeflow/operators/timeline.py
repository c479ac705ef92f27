"""History kept as a table: one row per event with the time span in which it held.

A new event ends the span of the one before it and begins its own, wherever in time it
falls, so a batch changes the rows of its own events and of their predecessors only. The
spans of the touched keys are drawn anew from their stored rows and the new events; what
comes out differently is written (merged on read, by key and arrival). Batches may come in
any order: the table always equals :func:`changeflow.operators.resolve.history` over all of them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.schemas import EntitySpec, Leaf

SPAN = (("op", "string"), ("valid_from", "timestamp_ntz"), ("valid_to", "timestamp_ntz"))
ARRIVAL = (("seq", "bigint"), ("pos", "int"), ("pos2", "int"))


@lru_cache(maxsize=None)
def timeline_spec(spec: EntitySpec) -> EntitySpec:
    """The table of an entity's spans, ``<name>_timeline``, keyed by key and arrival; the op of
    an event is ``event_op`` there."""
    time = [Leaf(spec.time_column, (), "timestamp_ntz")] if spec.time_column else []
    extra = [Leaf("event_op" if c == "op" else c, (), t) for c, t in (*SPAN, *ARRIVAL)]
    return EntitySpec(f"{spec.name}_timeline", (*spec.keys, *(c for c, _ in ARRIVAL)), (*spec.leaves, *time, *extra),
                      id_column=spec.id_column)


def timeline_changes(stored: DataFrame, events: DataFrame, spec: EntitySpec) -> DataFrame:
    """Rows of the timeline that ``events`` (staging rows) add or change, with op ``u``."""
    cols, keys = timeline_spec(spec).columns, list(spec.keys)
    pos = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c, _ in ARRIVAL[1:]]      # a part of the key
    new = events.select(*spec.columns, F.col("op").alias("event_op"), F.col("event_time").alias("valid_from"),
                        F.lit(None).cast("timestamp_ntz").alias("valid_to"), "seq", *pos, F.lit(True).alias("_new"))
    known = stored.select(*cols).withColumn("_new", F.lit(False)).join(events.select(*keys).distinct(), keys, "left_semi")
    arrival = [F.col(c) for c, _ in ARRIVAL]
    # an event that is staged again is the stored one
    once = Window.partitionBy(*keys, *arrival).orderBy("_new")
    all_rows = (known.unionByName(new.select(*known.columns)).withColumn("_n", F.row_number().over(once)).filter("_n = 1"))
    along = Window.partitionBy(*keys).orderBy("valid_from", *arrival)
    drawn = all_rows.withColumn("_to", F.lead("valid_from").over(along))
    changed = drawn.filter(F.col("_new") | ~F.col("_to").eqNullSafe(F.col("valid_to")))
    return changed.withColumn("valid_to", F.col("_to")).select(*cols, F.lit("u").alias("op"))


def add_to_timeline(tables, spec: EntitySpec, events: DataFrame, progress: dict | None = None, applied=None) -> dict:
    """Merge a batch of events into the timeline in ``tables`` (ChangeTables with
    :func:`timeline_spec`); only what can hold touched keys is read."""
    line, m = timeline_spec(spec), tables.manifest()
    rows = timeline_changes(tables.read_keys(line.name, events, m), events, spec)
    out = tables.append({line.name: rows}, progress=progress, order=None, applied=applied)
    tables.fold()
    return out


def as_of(timeline: DataFrame, at: Column) -> DataFrame:
    """The rows that held at a time (a literal, or a column beside the timeline's own), the
    deleted ones left out. The span is a filter: nothing is ranked or shuffled."""
    held = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return timeline.filter(held & (F.col("event_op") != "d"))


def join_as_of(requests: DataFrame, timeline: DataFrame, keys, at: str) -> DataFrame:
    """Each request (its keys and a time) with the row that held then, if one did: an
    equality join on the keys, with the span as a condition."""
    named = timeline.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in timeline.columns])
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    held = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at))) & (F.col("event_op") != "d")
    return requests.join(named, [*same, held], "left").drop(*[f"_k_{k}" for k in keys])
