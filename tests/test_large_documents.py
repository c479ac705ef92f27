"""Documents and messages of any number pass through files of few rows at a time, each built and parsed once."""

import datetime
import json
import os

import pyarrow.parquet as pq

from changeflow.operators.drift import document_paths
from changeflow.plans.fixtures import customer_documents, document_versions
from changeflow.plans.pipelines import decode, stage, stage_written
from changeflow.plans.registry import _write_phases, q_key_conflicts, q_row_counts
from changeflow.sources.partitioned_log import Segments, append_log, read_log
from pyspark.sql import functions as F
from tests.helpers import cov, doc, ev, msgs


def small_tables(spark, root):
    day = datetime.datetime(2024, 1, 2)
    frames = {
        "region": [(0, "R")], "nation": [(0, "N", 0)],
        "customer": [(k, f"c{k}", 0, k / 2, ("BUILDING", "OTHER", None)[k % 3]) for k in (1, 2, 3, 4, 5, 6, 7, 7)],
        "orders": [(10 * c + i, c if i else None, (None, "F", "O", "P")[i], 1.5 * i, day, "1-URGENT")
                   for c in (1, 2, 3, 7) for i in range(4) if c != 3 or i < 2],
        "lineitem": [(10 * c + i, 5, 6, 1, 1.0, 2.0, 0.0, 0.0, "A", "F", day) for c in (1, 2, 7) for i in (1, 2)]}
    names = {
        "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
        "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"}
    for t, rows in frames.items():
        spark.createDataFrame(rows, names[t]).write.parquet(f"{root}/{t}.parquet")
    return root


def groups(folder):
    return [pq.ParquetFile(f"{d}/{f}").metadata.row_group(i).num_rows for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")
            for i in range(pq.ParquetFile(f"{d}/{f}").num_row_groups)]


def test_both_versions_of_a_document_come_from_one_pass(spark, workdir):
    d, kept = small_tables(spark, workdir), F.col("o_orderstatus") != "F"
    both = document_versions(spark, d, kept)
    for name, df in (("data", customer_documents(spark, d)), ("shrunk", customer_documents(spark, d, orders_filter=kept))):
        assert sorted(map(tuple, both.select("id", name, "ts_ms", "seq").collect())) == sorted(map(tuple, df.select("id", "data", "ts_ms", "seq").collect()))


def test_phases_have_small_row_groups_and_few_files(spark, workdir):
    n = _write_phases(spark, small_tables(spark, f"{workdir}/in"), f"{workdir}/log")
    rows = {k: spark.read.parquet(f"{workdir}/log/src/phase{k}").collect() for k in range(3)}
    assert [len(rows[k]) for k in range(3)] == [8, 8, 2] and n >= 1
    assert {json.loads(r.value)["op"] for r in rows[2]} == {"d"} and not os.path.exists(f"{workdir}/log/docs")


def test_written_rows_are_the_staged_rows(spark, workdir):
    events = [ev("c", 1000 + i, i, i, after=doc(coverages=[cov("a", i), cov("b")])) for i in range(1200)]
    envelopes = decode(msgs(spark, events).coalesce(1))
    want, got = stage(envelopes), stage_written(envelopes, f"{workdir}/w")
    for name in want:
        assert got[name].schema.simpleString() == want[name].schema.simpleString()
        assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect()))
    assert max(groups(f"{workdir}/w/images")) <= 512 and sum(groups(f"{workdir}/w/images")) == 1200


def test_a_log_partition_is_numbered_in_pieces_and_read_by_files(spark, workdir):
    rows = spark.range(2000).select(F.concat(F.lit("v"), "id").alias("value"), (F.col("id") * 7 % 2000).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ends = append_log(rows, f"{workdir}/log", F.col("n") % 2, 2, order="n", piece_rows=300)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ends == {"0": 1000, "1": 1000} and max(groups(f"{workdir}/log")) <= 512
    segments = Segments(f"{workdir}/log")
    assert len(segments.slices({}, segments.ends())) > 2
    want = {(r.value, r.n // 2, r.n % 2) for r in rows.collect()}
    assert {tuple(r) for r in read_log(spark, f"{workdir}/log").collect()} == want
    assert {tuple(r) for r in read_log(spark, f"{workdir}/log", {"0": 900, "1": 1000}).collect()} == {w for w in want if w[2] == 0 and w[1] >= 900}


def test_paths_of_documents_by_one_scan(spark, workdir):
    spark.createDataFrame([('{"a": [], "b": {}, "c": [[1, {}], "x"], "d": null}',), ("7",)], "data string").write.parquet(f"{workdir}/d")
    paths = document_paths(spark.read.parquet(f"{workdir}/d"), depth=3)
    assert paths._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, paths.collect())) == [("$", "number", 1), ("$.c[*]", "string", 1), ("$.c[*][*]", "number", 1),
                                                   ("$.c[*][*]", "object", 1), ("$.d", "null", 1)]


def test_checks_read_documents_that_are_built_once(spark, workdir):
    d = small_tables(spark, f"{workdir}/in")
    counts, conflicts = q_row_counts(spark, d), q_key_conflicts(spark, d)
    for df in (counts, conflicts):
        assert "lineitem" not in df._jdf.queryExecution().analyzed().toString() and "l_orderkey" not in df._jdf.queryExecution().analyzed().toString()
    assert {r.table_name: r.n_rows for r in counts.collect()}["policy"] == 8
    got = {r.table_name: (r.n_keys, r.n_rows) for r in conflicts.collect()}
    assert got["policy"] == (1, 4)      # policy 7, which comes twice, planted twice
