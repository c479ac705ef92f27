"""Which paths documents have, and which of them no entity names.

A document is parsed once, to a VARIANT, and taken apart level by level in one pass, in which
a scalar stays as it is; all are counted by path and type at its end, so only these
counts are shuffled. Array elements share one path
(``[*]``). Run on a batch of staged documents it tells what a new producer has begun to send
before anyone reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.schemas import ENTITIES

#: fixed values: the kinds of JSON scalars by the names of VARIANT types
KINDS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(v: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    kind = reduce(lambda e, k: e.when(name == k[0], F.lit(k[1])), KINDS.items(),
                  F.when(name.isin("OBJECT", "ARRAY"), F.lower(name)))
    return kind.otherwise(F.lit("number"))


def document_paths(docs: DataFrame, data_col: str = "data", depth: int = 8) -> DataFrame:
    """(path, kind, n): how many values of each kind of scalar documents have at a path. What
    lies deeper than ``depth`` levels is counted there as ``object`` or ``array``."""
    tvf = docs.sparkSession.tvf
    level = docs.select(F.lit("$").alias("path"), F.lit(0).alias("level"), F.try_parse_json(data_col).alias("v"))
    for _ in range(depth):
        # what has nothing inside comes out once, without a position
        inside = level.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
        step = F.when(F.col("pos").isNull(), F.lit("")).when(F.col("key").isNull(), F.lit("[*]")).otherwise(F.concat(F.lit("."), "key"))
        level = inside.select(F.concat("path", step).alias("path"), (F.col("level") + F.col("pos").isNotNull().cast("int")).alias("level"),
                              F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"))
    # an object or array that came out above the last level is empty
    found = level.withColumn("kind", _kind(F.col("v"))).filter(F.col("v").isNotNull() & (
        (F.col("level") == depth) | ~F.col("kind").isin("object", "array")))
    return found.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def named_paths(specs=None) -> list[str]:
    """The paths that entities read."""
    out = set()
    for s in specs or ENTITIES.values():
        for leaf in s.leaves:
            levels = s.arrays if leaf.level == -1 else s.arrays[:leaf.level + 1]
            out.add("$" + "".join(f".{a}[*]" for a in levels) + "".join(f".{p}" for p in leaf.path))
    return sorted(out)


def unnamed_paths(docs: DataFrame, specs=None, data_col: str = "data", depth: int = 8) -> DataFrame:
    """:func:`document_paths` without those that an entity reads."""
    return document_paths(docs, data_col, depth).filter(~F.col("path").isin(named_paths(specs)))
