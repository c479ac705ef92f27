"""Session helpers: the configuration the library expects, and the shared
checkpoint folder (read from the session, set only where it is unset)."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # dynamic partition overwrite keeps a replayed staging batch idempotent
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(app: str = "changeflow", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and must be there. Only
    in a local session without it (tests) a folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not fallback and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = fallback or tempfile.mkdtemp(prefix="changeflow-ckpt-")
        os.makedirs(d, exist_ok=True) if "://" not in d else None
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleanup = threading.Lock()


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: the table is read back from
    its own files, and else they stay until the driver happens to collect its garbage. Threads
    may write side by side; the last one restores the session's setting."""
    with _cleanup:
        inside, before = getattr(spark, "_changeflow_cleanup", (0, None))
        if not inside:
            before = spark.conf.get(SHUFFLE_CLEANUP)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        spark._changeflow_cleanup = inside + 1, before
    try:
        yield
    finally:
        with _cleanup:
            inside, before = spark._changeflow_cleanup
            if inside == 1:
                spark.conf.set(SHUFFLE_CLEANUP, before)
            spark._changeflow_cleanup = inside - 1, before


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_changeflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="changeflow-py-"), "changeflow_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for p in (os.path.join(d, n) for n in names if n.endswith(".py")):
                z.write(p, os.path.join("changeflow", os.path.relpath(p, root)))
    sc.addPyFile(out)
    sc._changeflow_shipped = True
