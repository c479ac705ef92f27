"""Change events derived from tables instead of a replication slot.

``snapshot_events``: every row of a table as an ``r`` (snapshot read) event,
the way capture starts on a table that already has rows.
``diff_snapshots``: ``c`` / ``u`` / ``d`` events between two snapshots of a
keyed table, with full before- and after-images (unchanged rows produce nothing).
Each snapshot is summed up by ranges of the key's hash first; only rows of ranges whose
sums differ meet in the full outer join, so its size goes by the changes. ``seq`` gives
the events their place in the log: one number does for a whole diff, as it has each
key once. Rows without an id can't be followed; ``without_id`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.schemas import IMAGE


def _image(prefix: str, id_col: str, data_col: str, created: str | None, updated: str | None,
           present: Column) -> Column:
    def ts(c):
        return F.col(f"{prefix}{c}").cast("string") if c else F.lit(None).cast("string")

    img = F.struct(F.col(f"{prefix}{id_col}").cast("long").alias("id"),
                   F.col(f"{prefix}{data_col}").cast("string").alias("data"),
                   ts(created).alias("created_at"), ts(updated).alias("updated_at"))
    return F.when(present, img)


def snapshot_events(table: DataFrame, ts_ms: Column | int, id_col: str = "id", data_col: str = "data",
                    created_col: str | None = None, updated_col: str | None = None,
                    seq: Column | None = None) -> DataFrame:
    ts = ts_ms if isinstance(ts_ms, Column) else F.lit(ts_ms).cast("long")
    after = _image("", id_col, data_col, created_col, updated_col, F.lit(True))
    cols = [F.lit(None).cast(IMAGE).alias("before"), after.alias("after"), F.lit("r").alias("op"),
            ts.cast("long").alias("ts_ms")]
    if seq is not None:
        cols.append(seq.cast("long").alias("seq"))
    return table.select(*cols)


def without_id(table: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that no event can name, for the rejects."""
    return table.filter(F.col(id_col).isNull()).withColumn("reason", F.lit("null_id"))


def _range(id_col: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(ranges))


def range_sums(table: DataFrame, id_col: str, cols, ranges: int) -> DataFrame:
    """(range, n, h1, h2): count and 128 bits of the rows of each range of the key's hash,
    whatever their order; one small row per range and task is shuffled."""
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), *cols, *[F.col(c).isNull() for c in cols])).alias(f"h{i}") for i in (1, 2)]
    return table.groupBy(_range(id_col, ranges).alias("range")).agg(F.count(F.lit(1)).alias("n"), *hashes)


def changed_ranges(old: DataFrame, new: DataFrame, id_col: str, cols, ranges: int) -> DataFrame:
    """The ranges in which two snapshots differ."""
    sums = [range_sums(t, id_col, cols, ranges).select(F.col("range"), F.struct("n", "h1", "h2").alias(name))
            for t, name in ((old, "o"), (new, "n"))]
    return sums[0].join(sums[1], "range", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n"))).select("range")


def diff_snapshots(old: DataFrame, new: DataFrame, ts_ms: Column | int, id_col: str = "id",
                   data_col: str = "data", created_col: str | None = None,
                   updated_col: str | None = None, seq: Column | int | None = None, ranges: int = 65_536) -> DataFrame:
    """Envelopes turning ``old`` into ``new``; key = ``id_col`` (unique per snapshot).

    ``ranges``: into how many ranges of the key's hash the snapshots are dealt; an unchanged
    row takes part in the join only if its range has a change. 0 joins everything.
    """
    cols = [c for c in (id_col, data_col, created_col, updated_col) if c]
    old, new = (t.filter(F.col(id_col).isNotNull()) for t in (old, new))
    if ranges:
        found = changed_ranges(old, new, id_col, cols, ranges)
        old, new = (t.withColumn("range", _range(id_col, ranges)).join(found, "range", "left_semi") for t in (old, new))
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    j = o.join(n, F.col(f"o_{id_col}") == F.col(f"n_{id_col}"), "full_outer")
    has_o, has_n = F.col(f"o_{id_col}").isNotNull(), F.col(f"n_{id_col}").isNotNull()
    same = F.lit(True)
    for c in cols[1:]:
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    op = (F.when(~has_o, F.lit("c")).when(~has_n, F.lit("d"))
          .when(~same, F.lit("u")))
    ts = ts_ms if isinstance(ts_ms, Column) else F.lit(ts_ms)
    events = (j.select(_image("o_", id_col, data_col, created_col, updated_col, has_o).alias("before"),
                       _image("n_", id_col, data_col, created_col, updated_col, has_n).alias("after"),
                       op.alias("op"), ts.cast("long").alias("ts_ms"))
              .filter(F.col("op").isNotNull()))
    if seq is None:
        return events
    return events.withColumn("seq", (seq if isinstance(seq, Column) else F.lit(seq)).cast("long"))
