"""What the operators of this subpackage share: the shared scratch folder, and
shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from changeflow.session import SHUFFLE_CLEANUP, checkpoint_dir, shuffles_deleted  # noqa: F401
from changeflow.sinks.tables import HadoopFS


MOST_BUCKETS = 100_000      # Spark's own bound for a table


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application (``addPyFile``)."""
    sc = spark.sparkContext
    if getattr(sc, "_changeflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="changeflow-py-"), "changeflow_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.join("changeflow", os.path.relpath(p, root)))
    sc.addPyFile(out)
    sc._changeflow_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/changeflow-llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage
    is cut, and a lost executor costs no recomputation of what is before it."""
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a later saved table makes superfluous: ``drop`` deletes exactly the
    folder that this object made, once nothing that is still to run reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)
        self.tables: list[str] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.root}/{name}-{uuid.uuid4().hex}")

    def bucketed(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """As ``saved``, but bucketed by ``keys``, as many buckets as the session has shuffle
        partitions: a join or aggregate by ``keys`` doesn't shuffle the table again."""
        table = f"{name}_{uuid.uuid4().hex}"
        buckets = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
        with shuffles_deleted(self.spark):
            df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{table}").bucketBy(
                buckets, *keys).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        HadoopFS(self.spark, self.root).delete(self.root)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
