"""Keyed output tables published together by one manifest.

Layout under ``root``::

    <entity>/v=<version>/_bucket=<b>/part-*.parquet   data files, never modified
    _manifests/m-<version>.json                       one per published version

A table is split into ``buckets`` by ``pmod(xxhash64(policy_id), buckets)``.
Every entity's key starts with ``policy_id``, so a policy and all its children
live in the same bucket number of each table. A merge reads only the buckets
its changes touch (the bucket ids are collected: at most ``buckets`` small
ints), writes the merged buckets to a new version folder, then publishes a new
manifest that points the touched buckets of *all* changed tables at the new
files and carries the caller's progress (watermarks, source batch id).

Readers resolve one manifest, so they see all tables of one version or of the
previous one, never a mix (all-or-nothing publish). A crash before the
manifest is written leaves only unreferenced files; a replay overwrites the
same version folder. The manifest is written under a temporary name and
renamed (atomic on POSIX and HDFS; on object stores use a conditional put).
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.schemas import ENTITIES, EntitySpec
from changeflow.session import shuffles_deleted

# hidden columns kept with each row when a table set keeps the order of its rows
ORDER_FIELDS = [("op", T.StringType()), ("event_time", T.TimestampNTZType()), ("seq", T.LongType()),
                ("pos", T.IntegerType()), ("pos2", T.IntegerType())]


UNKNOWN = 1 << 60       # from this on, the planner's size of a table says that it has none


def bucket_of(col: str | Column, buckets: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


class HadoopFS:
    """Small file operations through the cluster's Hadoop FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._gateway = spark.sparkContext._gateway
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self._Path(p)

    def exists(self, p: str) -> bool:
        return bool(self.fs.exists(self._Path(p)))

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self._Path(p))

    def list_names(self, p: str) -> list[str]:
        if not self.exists(p):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._Path(p))]

    def list_times(self, p: str) -> list[tuple[str, float]]:
        """Names in a folder with their modification times, in seconds."""
        if not self.exists(p):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self._Path(p))]

    def size(self, p: str) -> int:
        """Bytes of all files below a path."""
        return self.fs.getContentSummary(self._Path(p)).getLength()

    def write_text(self, p: str, text: str, overwrite: bool = False) -> None:
        out = self.fs.create(self._Path(p), overwrite)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self._Path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def rename(self, src: str, dst: str) -> bool:
        return bool(self.fs.rename(self._Path(src), self._Path(dst)))

    def rename_new(self, src: str, dst: str) -> bool:
        """Rename onto a name that must not exist yet; False if it does."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        Rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(Rename, 1)
        how[0] = Rename.NONE
        try:
            context.rename(self._Path(src), self._Path(dst), how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, p: str) -> None:
        self.fs.delete(self._Path(p), True)


class TableSet:
    """Keyed tables of several entities with one shared manifest."""

    def __init__(self, spark: SparkSession, root: str, specs=None, buckets: int = 64, keep_order: bool = False,
                 write_bytes: int = 1 << 24):
        """``write_bytes``: a commit that works by bucket writes buckets of so many bytes
        at a time, of rows and changes, so that its shuffles take the room of these.

        ``keep_order=True`` stores each row's ``op, event_time, seq, pos, pos2``
        as hidden columns (needed by the exact merge, which ranks the stored
        row against newer events, and keeps deleted keys as rows with op ``d``);
        public reads leave out both the columns and the deleted rows."""
        self.keep_order = keep_order
        self.spark = spark
        self.root = root.rstrip("/")
        self.specs: dict[str, EntitySpec] = {s.name: s for s in (specs or ENTITIES.values())}
        self.buckets, self.write_bytes = buckets, write_bytes
        self.fs = HadoopFS(spark, self.root)

    # ---- manifests -----------------------------------------------------------------------------
    def _mdir(self) -> str:
        return f"{self.root}/_manifests"

    def versions(self) -> list[int]:
        return sorted(int(n[2:-5]) for n in self.fs.list_names(self._mdir())
                      if n.startswith("m-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        vs = self.versions()
        if version is None:
            version = vs[-1] if vs else None
        if version is None:
            return {"version": 0, "tables": {n: {} for n in self.specs}, "progress": {}, "buckets": self.buckets}
        m = json.loads(self.fs.read_text(f"{self._mdir()}/m-{version:020d}.json"))
        if m["buckets"] != self.buckets:
            raise ValueError(f"the tables have {m['buckets']} buckets, not {self.buckets}")
        return m

    def _publish(self, m: dict) -> bool:
        final = f"{self._mdir()}/m-{m['version']:020d}.json"
        if self.fs.exists(final):
            return False
        self.fs.mkdirs(self._mdir())
        tmp = f"{self._mdir()}/.tmp-{uuid.uuid4().hex}.json"
        self.fs.write_text(tmp, json.dumps(m, sort_keys=True))
        ok = self.fs.rename_new(tmp, final)
        if not ok:
            self.fs.delete(tmp)
        return ok

    # ---- reads ---------------------------------------------------------------------------------
    def stored_columns(self, name: str) -> list[str]:
        return self.specs[name].columns + ([f for f, _ in ORDER_FIELDS] if self.keep_order else [])

    def _schema(self, name: str) -> T.StructType:
        s = self.specs[name].output_schema()
        for f, t in ORDER_FIELDS if self.keep_order else []:
            s = s.add(f, t)
        return s

    def _frame(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*paths)

    def read(self, name: str, version: int | None = None, hidden: bool = False) -> DataFrame:
        m = self.manifest(version)
        df = self._frame(name, sorted(m["tables"].get(name, {}).values()))
        if hidden:
            return df
        if self.keep_order:
            df = df.filter(~F.col("op").eqNullSafe("d"))
        return df.select(*self.specs[name].columns)

    def read_all(self, version: int | None = None, hidden: bool = False) -> dict[str, DataFrame]:
        return {n: self.read(n, version, hidden) for n in self.specs}

    def read_buckets(self, name: str, buckets, m: dict) -> DataFrame:
        entries = m["tables"].get(name, {})
        return self._frame(name, sorted(entries[str(b)] for b in buckets if str(b) in entries))

    def touched_buckets(self, keys: DataFrame, id_col: str = "policy_id") -> list[int]:
        """Bucket ids holding the given keys (at most ``buckets`` values)."""
        return self.touched_buckets_all({"_": (keys, id_col)}).get("_", [])

    def touched_buckets_all(self, keyed: dict[str, tuple[DataFrame, str]]) -> dict[str, list[int]]:
        """Touched bucket ids of several tables in one job: ``{name: (keys, id_col)}``.
        The result has at most ``tables x buckets`` small ints."""
        parts = [df.select(F.lit(name).alias("t"), bucket_of(col, self.buckets).alias("b"))
                 for name, (df, col) in keyed.items()]
        if not parts:
            return {}
        out: dict[str, list[int]] = {n: [] for n in keyed}
        for r in reduce(DataFrame.unionByName, parts).distinct().collect():
            if r["b"] is not None:
                out[r["t"]].append(r["b"])
        return {n: sorted(v) for n, v in out.items()}

    # ---- commit --------------------------------------------------------------------------------
    def _waves(self, rows: DataFrame, cur: DataFrame, bks: list[int]) -> list[list[int]]:
        """The buckets to write, in parts of about ``write_bytes`` each."""
        known = [n for n in (int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (rows, cur)) if n < UNKNOWN]
        n = min(len(bks), -(-sum(known) // self.write_bytes) or 1)
        return [bks[len(bks) * k // n:len(bks) * (k + 1) // n] for k in range(n)]

    def _write(self, name: str, rows: DataFrame, merge, bks: list[int], m: dict, version: int, by_bucket: bool) -> tuple[str, list[int], set, dict]:
        spec = self.specs[name]
        # a folder of its own for each attempt: what an aborted one left is never read
        path = f"{self.root}/{name}/v={version:020d}-{uuid.uuid4().hex}"
        bucket = bucket_of(spec.id_column, self.buckets)
        waves = self._waves(rows, self.read_buckets(name, bks, m), bks) if by_bucket else [bks]
        found: dict[str, int] = {}
        for part in waves:
            cur = self.read_buckets(name, part, m)
            if by_bucket:
                new = merge(cur, rows.filter(bucket.isin(part)) if len(waves) > 1 else rows)
            else:
                new = merge(cur)
            new, seen = new if isinstance(new, tuple) else (new, None)
            new = new.select(*self.stored_columns(name))
            # one shuffle by bucket: few files per bucket, and AQE splits a bucket that is too large for a task
            with shuffles_deleted(new.sparkSession):
                (new.withColumn("_bucket", bucket).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *spec.keys).write.mode("append")
                    .options(partitionOverwriteMode="static", compression="zstd").partitionBy("_bucket").parquet(path))
            for key, n in (seen.get if seen else {}).items():
                found[key] = found.get(key, 0) + n
        written = {n.split("=", 1)[1] for n in self.fs.list_names(path) if n.startswith("_bucket=")}
        return path, bks, written, found

    def commit(self, updates: dict[str, tuple[DataFrame, Callable[..., DataFrame]]],
               progress: dict | None = None, metrics: dict | None = None, all_buckets: bool = False,
               applied: Callable[[dict], bool] | None = None, tries: int = 6, by_bucket: bool = False) -> dict:
        """Merge and publish one version.

        ``updates``: ``{entity: (touched_keys, merge)}`` where ``merge`` maps the
        current rows of the touched buckets to their new rows. Only those buckets
        are read and rewritten; the tables are written concurrently (one Spark
        job each), then one manifest publishes all of them. Returns it.
        With ``by_bucket`` the first entry has all columns, and ``merge`` takes the current
        rows and those of the first entry; it is called for some buckets at a time. A merge may return
        an ``Observation`` of counts beside its rows: their sums over the buckets are added to the
        table's metrics.

        If another writer publishes first, the commit goes on from its version: tables whose
        touched buckets it left alone keep what is written, the others are merged again.
        ``applied(manifest)`` tells whether that version has these changes already; then
        it is returned as it is.
        """
        if all_buckets:
            bks = {n: list(range(self.buckets)) for n in updates}
        else:
            bks = self.touched_buckets_all({n: (k, self.specs[n].id_column) for n, (k, _) in updates.items()})
        todo = {n: merge for n, (_, merge) in updates.items() if bks.get(n)}
        results: dict[str, tuple] = {}
        for attempt in range(tries):
            m = self.manifest()
            if attempt and applied and applied(m):
                return m
            version, tables = m["version"] + 1, {n: dict(v) for n, v in m["tables"].items()}
            read = {n: [tables.get(n, {}).get(str(b)) for b in bks[n]] for n in todo}
            again = [n for n in todo if n not in results or results[n][0] != read[n]]
            if again:
                with ThreadPoolExecutor(max_workers=len(again)) as pool:
                    futures = {n: pool.submit(self._write, n, updates[n][0], todo[n], bks[n], m, version, by_bucket) for n in again}
                    results |= {n: (read[n], *f.result()) for n, f in futures.items()}
            seen = dict(metrics or {})
            for name, (_, path, buckets, written, found) in results.items():
                if found:
                    seen[name] = {**seen.get(name, {}), **found}
                entry = tables.setdefault(name, {})
                for b in buckets:
                    if str(b) in written:
                        entry[str(b)] = f"{path}/_bucket={b}"
                    else:
                        entry.pop(str(b), None)
            new_m = {"version": version, "tables": tables, "buckets": self.buckets,
                     "progress": {**m.get("progress", {}), **(progress or {})}, "metrics": seen}
            if self._publish(new_m):
                return new_m
            time.sleep(random.random() * min(0.05 * 2 ** attempt, 5))
        raise RuntimeError(f"{tries} times another writer published first")
