"""Data-quality checks as DataFrames (one row per finding or per table).

Each check is an aggregate or a join planned by Catalyst; nothing is
collected. A check passes when its frame is empty (violations) or its flag
column is true (counts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, keys) -> DataFrame:
    """Keys present more than once (``unique`` test / primary-key conflict). A key with a
    NULL part equals no other and is left to :func:`null_violations`."""
    keys = list(keys)
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def null_violations(df: DataFrame, cols) -> DataFrame:
    """One row per column: how many rows hold NULL (``not_null`` test)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, n_null)")


def key_conflicts(tables: dict) -> DataFrame:
    """Primary-key conflicts over several tables: ``{name: (df, keys)}`` ->
    ``table_name, key_text, n_rows``."""
    parts = []
    for name, (df, keys) in tables.items():
        v = unique_violations(df, keys)
        parts.append(v.select(F.lit(name).alias("table_name"),
                              F.to_json(F.struct(*keys)).alias("key_text"), "n_rows"))
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict, minimum: int = 1) -> DataFrame:
    """``table_name, n_rows, ok`` with ``ok = n_rows >= minimum``."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("ok", F.col("n_rows") >= F.lit(minimum))


def children_per_parent(parent: DataFrame, child: DataFrame, key: str = "policy_id") -> DataFrame:
    """Children counted per parent (0 for a parent without children).

    Children are counted per key first (partial aggregation), then joined, so
    a parent with many children never ships its children through the join.
    """
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"))
    return (parent.select(key).join(counts, key, "left")
            .select(key, F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")))


def orphans(child: DataFrame, parent: DataFrame, key: str = "policy_id") -> DataFrame:
    """Child rows whose parent key is absent."""
    return child.join(parent.select(key), key, "left_anti")


def envelope_shape(events: DataFrame) -> DataFrame:
    """Counts of events by shape: an after-image must exist unless op = 'd'."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("after").isNull() & (F.col("op") != F.lit("d"))).alias("n_missing_after"),
        F.count_if(F.col("before").isNull() & (F.col("op") == F.lit("d"))).alias("n_missing_before"),
    )


def distinct_ops(df: DataFrame, col: str = "op") -> DataFrame:
    return df.select(F.col(col).alias("op")).distinct().orderBy("op")


def count_by_op(df: DataFrame, col: str = "op") -> DataFrame:
    return df.groupBy(F.col(col).alias("op")).agg(F.count(F.lit(1)).alias("n_rows"))


def exact_quantiles(df: DataFrame, value_col: str, by=(), probs=(0.5, 0.9, 0.99),
                    names=None, partitions: int | None = None) -> DataFrame:
    """Exact nearest-rank quantiles per group, without gathering a group's
    values in one task.

    Quantile ``p`` of ``n`` values is the value at 0-based rank
    ``max(ceil(n * p) - 1, 0)`` in ascending order (an observed value). Plan:
    value histogram per group (map-side counts), fixed pieces of the value range
    so a hot group's values are spread in order, running counts inside each piece plus per-piece offsets, then one aggregate picks
    the value whose rank span holds each target rank.
    """
    by = list(by)
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    n_parts = min(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64)
    hist = df.filter(F.col(value_col).isNotNull()).groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_c"))
    # pieces of the value range, by bounds found once and then fixed
    bounds = sorted(set(hist.approxQuantile(value_col, [k / n_parts for k in range(1, n_parts)], 0.01))) if n_parts > 1 else []
    piece = F.lit(0)
    for bound in bounds:
        piece = piece + (F.col(value_col) > F.lit(bound)).cast("int")
    h = hist.withColumn("_pid", piece)
    wl = Window.partitionBy("_pid", *by).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("_local", F.coalesce(F.sum("_c").over(wl), F.lit(0)))
    pieces = hist.withColumn("_pid", piece).groupBy("_pid", *by).agg(F.sum("_c").alias("_pn"))
    wk = Window.partitionBy(*by).orderBy("_pid")
    pieces = pieces.select(
        F.col("_pid").alias("_p__pid"), *[F.col(c).alias(f"_p_{c}") for c in by],
        F.coalesce(F.sum("_pn").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_pn").over(Window.partitionBy(*by)).alias("_n"))
    same = F.lit(True)
    for c in ["_pid", *by]:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    h = h.join(pieces, same).withColumn("_start", F.col("_off") + F.col("_local"))
    picks = []
    for p, name in zip(probs, names):
        r = F.greatest(F.ceil(F.col("_n").cast("double") * F.lit(float(p))) - F.lit(1), F.lit(0))
        hit = (F.col("_start") <= r) & (r < F.col("_start") + F.col("_c"))
        picks.append(F.max(F.when(hit, F.col(value_col))).alias(name))
    return h.groupBy(*by).agg(*picks, F.max(value_col).alias("max_value"), F.max("_n").alias("n_rows"))


def lag_stats(df: DataFrame, lag_col: str, by=()) -> DataFrame:
    """Exact lag quantiles (ms) per group: p50, p90, p99 (nearest rank), max,
    count. Skew-safe: see :func:`exact_quantiles`."""
    q = exact_quantiles(df, lag_col, by, (0.5, 0.9, 0.99), ["p50_ms", "p90_ms", "p99_ms"])
    return q.select(*by, *[F.col(c).cast("long").alias(c) for c in ("p50_ms", "p90_ms", "p99_ms")],
                    F.col("max_value").cast("long").alias("max_ms"), F.col("n_rows").cast("long").alias("n_rows"))
