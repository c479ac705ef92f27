"""JDBC source / sink for the same tables (staging, outputs, watermarks).

Thin on purpose: Spark's JDBC data source does the work. Writes append in
parallel, one connection per partition (``numPartitions`` bounds the
connections); reads can be split on a numeric column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None,
               num_partitions: int | None = None, batch_size: int = 10_000) -> None:
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch_size)
    if num_partitions:
        w = w.option("numPartitions", num_partitions)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()
