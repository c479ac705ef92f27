"""Registered queries: one per operator family of the inventory, each built from
the library operators over fixtures Spark derives from the driver tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns equal the oracle SQL of the same name (``oracle_sql.ORACLE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.casts import cast_leaf
from changeflow.functions.json import json_patch, json_text, json_value, json_values, summary_json
from changeflow.functions.time import elapsed_ms, epoch_millis, event_time_from_ms
from changeflow.operators import checks
from changeflow.operators.filters import drop_deletes, filter_ops, image, since_watermark
from changeflow.operators.flatten import flatten, flatten_union, parse_document, vanished_children
from changeflow.operators.merge import (
    advance_watermarks, apply_deletes, batch_metrics, merge_batch, merge_delete_insert, merge_upsert,
    model_rows, run_model,
)
from changeflow.operators.resolve import current_state, dead_keys, dead_keys_correlated, history, latest_per_key
from changeflow.plans.fixtures import change_envelopes, change_log, customer_documents, document_versions, table
from changeflow.plans.pipelines import write_documents
from changeflow.schemas import CLAIM, COVERAGE, DRIVER, POLICY, VEHICLE, EntitySpec, Leaf
from changeflow.sources.changes import envelope_rejects, parse_envelope, peek_changes
from changeflow.sources.snapshots import diff_snapshots, snapshot_events

SPLIT = "2024-01-16 00:00:00"
LCOLS = ["policy_id", "event_type", "op", "event_time", "seq", "k", "value"]
MCOLS = ["policy_id", "event_type", "source_event_time", "seq", "k", "value"]


def _split():
    return F.lit(SPLIT).cast("timestamp_ntz")


def _empty(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


# ---- events ---------------------------------------------------------------------------------------

def q_op_filter_after(spark, d):
    env = parse_envelope(change_envelopes(spark, d))
    return image(filter_ops(env), "after").select("seq", "id", "op", "data")


def q_op_filter_all_coalesce(spark, d):
    env = parse_envelope(change_envelopes(spark, d))
    return image(filter_ops(env, ("c", "r", "u", "d")), "coalesce").select("seq", "id", "op", "data", "created_at")


def q_lenient_parse(spark, d):
    env = parse_envelope(change_envelopes(spark, d, corrupt=True))
    return env.select("seq", "op", F.coalesce("after.id", "before.id").alias("id"), "ts_ms")


def q_envelope_rejects(spark, d):
    return envelope_rejects(change_envelopes(spark, d, corrupt=True), strict=True).select("seq", "reason")


def q_epoch_millis(spark, d):
    ev = table(spark, d, "events")
    ms = epoch_millis("ts")
    return ev.select(F.col("event_id").alias("seq"), ms.alias("ts_ms"), event_time_from_ms(ms).alias("arrival_time"))


def q_json_value_scalar(spark, d):
    ev = table(spark, d, "events")
    return ev.select(F.col("event_id").alias("seq"), json_value("props", "$.k", "int").alias("k"))


def q_json_value_paths(spark, d):
    docs = customer_documents(spark, d).select("id", "data", json_text("data", "status").alias("status_text"))
    return json_values(docs, "data", {
        "policy_number": "$.policy_number",
        "city": "$.policyholder.contact.address.city",
        "first_coverage": "$.coverages[0].type",
        "first_limit": ("$.coverages[0].limit", "decimal(12,2)"),
        "first_license": "$.vehicles[0].drivers[0].license_number",
        "holder_object": "$.policyholder"}).drop("data")


def q_json_cast_types(spark, d):
    li = table(spark, d, "lineitem")
    text = F.to_json(F.struct(
        F.col("l_shipdate").cast("date").cast("string").alias("d"), F.col("l_extendedprice").alias("p"),
        (F.col("l_linestatus") == "F").alias("b"), F.col("l_linenumber").cast("string").alias("i"),
        F.col("l_shipdate").cast("string").alias("t")))
    leaves = {"d": "date", "p": "decimal(12,2)", "b": "boolean", "i": "int", "t": "timestamp_ntz"}
    parsed = F.from_json(text, "d string, p string, b string, i string, t string")
    return li.select("l_orderkey", "l_linenumber", parsed.alias("j")).select(
        "l_orderkey", "l_linenumber", *[cast_leaf(F.col(f"j.{k}"), t).alias(k) for k, t in leaves.items()])


def q_json_patch(spark, d):
    ev = table(spark, d, "events")
    patch = F.to_json(F.struct((F.get_json_object("props", "$.k").try_cast("int") + 1).alias("k"),
                               F.col("value").alias("v")))
    p = json_patch("props", patch)
    return ev.select(F.col("event_id").alias("seq"), json_value(p, "$.k", "int").alias("k"),
                     json_value(p, "$.v", "decimal(12,2)").alias("v"))


# ---- flatten --------------------------------------------------------------------------------------

def _docs(spark, d, specs):
    return parse_document(customer_documents(spark, d), specs)


def q_flatten_root(spark, d):
    return flatten(_docs(spark, d, POLICY), POLICY).select(*POLICY.columns)


def q_flatten_array_round_trip(spark, d):
    return flatten(_docs(spark, d, COVERAGE), COVERAGE).select(*COVERAGE.columns)


def q_flatten_union_equiv(spark, d):
    return flatten_union(_docs(spark, d, COVERAGE), COVERAGE).select(*COVERAGE.columns)


def q_flatten_union_uncapped(spark, d):
    return flatten_union(_docs(spark, d, COVERAGE), COVERAGE, caps=None).select(*COVERAGE.columns)


def q_flatten_vehicles(spark, d):
    return flatten(_docs(spark, d, VEHICLE), VEHICLE).select(*VEHICLE.columns)


def q_flatten_claims(spark, d):
    return flatten(_docs(spark, d, CLAIM), CLAIM).select(*CLAIM.columns)


def q_flatten_nested(spark, d):
    return flatten(_docs(spark, d, DRIVER), DRIVER).select(*DRIVER.columns)


def q_flatten_nested_masked(spark, d):
    return flatten(_docs(spark, d, DRIVER), DRIVER, skip=DRIVER.staging_skip).select(*DRIVER.columns)


def q_flatten_uncapped(spark, d):
    return flatten(_docs(spark, d, DRIVER), DRIVER, caps=None).select(*DRIVER.columns)


def q_vanished_children(spark, d):
    full = customer_documents(spark, d)
    shrunk = customer_documents(spark, d, orders_filter=F.col("o_orderstatus") != "F")
    ev = full.alias("b").join(shrunk.alias("a"), "id").select(
        F.struct(F.col("id"), F.col("b.data").alias("data")).alias("before"),
        F.struct(F.col("id"), F.col("a.data").alias("data")).alias("after"),
        F.lit("u").alias("op"), F.col("b.event_time").alias("event_time"), F.col("b.seq").alias("seq"))
    return vanished_children(ev, COVERAGE).select("policy_id", "coverage_type", "op")


# ---- resolve --------------------------------------------------------------------------------------

def q_latest_window(spark, d):
    return latest_per_key(change_log(spark, d), ["policy_id"], method="window").select(*LCOLS)


def q_latest_max_by(spark, d):
    return latest_per_key(change_log(spark, d), ["policy_id"], method="max_by").select(*LCOLS)


def q_current_state(spark, d):
    return current_state(change_log(spark, d), ["policy_id"]).select(*LCOLS)


def q_history(spark, d):
    return history(change_log(spark, d), ["policy_id"]).select("policy_id", "seq", "event_time", "version",
                                                                "valid_to")


def q_history_window(spark, d):
    return history(change_log(spark, d), ["policy_id"], method="window").select(
        "policy_id", "seq", "event_time", "version", "valid_to")


def q_distinct_ops(spark, d):
    return checks.distinct_ops(change_log(spark, d))


def q_count_by_op(spark, d):
    return checks.count_by_op(change_log(spark, d))


# ---- merges ---------------------------------------------------------------------------------------

def q_upsert_no_delete(spark, d):
    log = filter_ops(change_log(spark, d)).select(*LCOLS, "pos", "pos2", "arrival_time")
    h1, h2 = log.filter(F.col("arrival_time") < _split()), log.filter(F.col("arrival_time") >= _split())
    t1 = merge_upsert(_empty(log).select(*LCOLS), h1, ["policy_id"])
    return merge_upsert(t1, h2, ["policy_id"])


def q_delete_insert(spark, d):
    log = change_log(spark, d)
    h1, h2 = log.filter(F.col("arrival_time") < _split()), log.filter(F.col("arrival_time") >= _split())
    t1 = model_rows(h1, ["policy_id"], LCOLS)
    return merge_delete_insert(t1, model_rows(h2, ["policy_id"], LCOLS), ["policy_id"])


def q_post_hook_delete(spark, d):
    log = change_log(spark, d)
    return apply_deletes(model_rows(log, ["policy_id"], LCOLS), dead_keys(log, ["policy_id"], method="join"),
                         ["policy_id"])


def q_post_hook_delete_agg(spark, d):
    log = change_log(spark, d)
    return apply_deletes(model_rows(log, ["policy_id"], LCOLS), dead_keys(log, ["policy_id"]), ["policy_id"])


def q_post_hook_delete_correlated(spark, d):
    log = change_log(spark, d)
    return apply_deletes(model_rows(log, ["policy_id"], LCOLS), dead_keys_correlated(log, ["policy_id"]),
                         ["policy_id"])


def _model_log(spark, d):
    return change_log(spark, d).withColumn("source_event_time", F.col("event_time"))


def q_incremental_max_time(spark, d):
    stg = _model_log(spark, d)
    h1 = stg.filter(F.col("arrival_time") < _split())
    t1 = run_model(_empty(stg).select(*MCOLS), h1, ["policy_id"], MCOLS, incremental=True)
    return run_model(t1, stg, ["policy_id"], MCOLS, incremental=True)


def q_full_rescan_model(spark, d):
    stg = _model_log(spark, d)
    h1 = stg.filter(F.col("arrival_time") < _split())
    t1 = run_model(_empty(stg).select(*MCOLS), h1, ["policy_id"], MCOLS)
    return run_model(t1, stg, ["policy_id"], MCOLS)


def _slices(spark, d):
    log = change_log(spark, d)
    s1 = log.filter(F.col("arrival_time") < _split())
    # the watermark is one number: computed first, then a literal bound the scan can use
    wm1 = s1.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("wm")).first()["wm"]
    return log, s1, since_watermark(log, wm1)


def q_batch_merge(spark, d):
    log, s1, s2 = _slices(spark, d)
    t1 = merge_batch(_empty(log).select(*LCOLS), s1, ["policy_id"])
    return merge_batch(t1, s2, ["policy_id"])


def q_batch_merge_tuple_key(spark, d):
    log, s1, s2 = _slices(spark, d)
    keys = ["policy_id", "event_type"]
    t1 = merge_batch(_empty(log).select(*LCOLS), s1, keys)
    return merge_batch(t1, s2, keys)


def q_batch_merge_triple_key(spark, d):
    log, s1, s2 = _slices(spark, d)
    keys = ["policy_id", "event_type", "k"]
    t1 = merge_batch(_empty(log).select(*LCOLS), s1, keys)
    return merge_batch(t1, s2, keys)


def q_batch_merge_exact(spark, d):
    log = change_log(spark, d)
    state = _empty(log).select(*LCOLS)
    # slices by arrival; late events and tombstones meet the rows stored before
    for part in (log.filter(F.col("arrival_time") < _split()), log.filter(F.col("arrival_time") >= _split())):
        state = merge_batch(state, part, ["policy_id"], exact=True)
    return drop_deletes(state)


def q_watermark_advance(spark, d):
    log = change_log(spark, d).withColumnRenamed("event_type", "entity")
    wm0 = log.select("entity").distinct().withColumn("watermark", F.lit(0).cast("long"))
    w1 = advance_watermarks(log.filter(F.col("arrival_time") < _split()), wm0, "entity")
    w2 = advance_watermarks(log, w1, "entity")
    w3 = advance_watermarks(log, w2, "entity")
    return (w1.withColumnRenamed("watermark", "wm1").join(w2.withColumnRenamed("watermark", "wm2"), "entity")
            .join(w3.withColumnRenamed("watermark", "wm3"), "entity"))


def q_merge_summary(spark, d):
    log = change_log(spark, d).withColumnRenamed("event_type", "entity")
    return batch_metrics(log, ["policy_id"], 0, by=["entity"])


def q_merge_result_json(spark, d):
    m = q_merge_summary(spark, d)
    return m.select("entity", summary_json(F.col("rows_merged"), F.col("watermark")).alias("result"))


# ---- sources --------------------------------------------------------------------------------------

def q_peek_changes(spark, d):
    return peek_changes(change_log(spark, d), 10).select("seq", "op", "policy_id")


def _customer_rows(spark, d, acct=None):
    c = table(spark, d, "customer")
    acct = acct if acct is not None else F.col("c_acctbal")
    return c.select(F.col("c_custkey").alias("id"),
                    F.to_json(F.struct("c_name", acct.alias("c_acctbal"))).alias("data"))


def q_snapshot_events(spark, d):
    ev = snapshot_events(_customer_rows(spark, d), 0)
    return ev.select(F.col("after.id").alias("id"), "op", "ts_ms", F.col("before").isNull().alias("no_before"),
                     json_value("after.data", "$.c_name").alias("name"))


def q_snapshot_diff(spark, d):
    old = _customer_rows(spark, d).filter(F.col("id") % 5 != 0)
    acct = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    new = _customer_rows(spark, d, acct).filter(F.col("id") % 7 != 0)
    # rows without an id are left to the rejects
    lost = new.filter(F.col("id") % 9 == 0).withColumn("id", F.lit(None).cast("long"))
    ev = diff_snapshots(old, new.unionByName(lost), 0, seq=1)
    return ev.select(F.coalesce("after.id", "before.id").alias("id"), "op",
                     json_value("before.data", "$.c_acctbal", "decimal(12,2)").alias("before_acct"),
                     json_value("after.data", "$.c_acctbal", "decimal(12,2)").alias("after_acct"))


# ---- checks ---------------------------------------------------------------------------------------

def q_parent_child_counts(spark, d):
    docs = _docs(spark, d, [POLICY, VEHICLE])
    parents = flatten(docs, POLICY).filter(F.col("status") == "BUILDING")
    return checks.children_per_parent(parents, flatten(docs, VEHICLE))


def q_orphans(spark, d):
    docs = _docs(spark, d, [POLICY, COVERAGE])
    parents = flatten(docs, POLICY).filter(F.col("status") != "BUILDING")
    return checks.orphans(flatten(docs, COVERAGE).select(*COVERAGE.columns), parents)


def q_unique_violations(spark, d):
    li = table(spark, d, "lineitem")
    # planted: rows without a line number, which repeat no key
    none = li.filter(F.col("l_linenumber") == 1).withColumn("l_linenumber", F.lit(None).cast(li.schema["l_linenumber"].dataType))
    return checks.unique_violations(li.unionByName(none).unionByName(none), ["l_orderkey", "l_linenumber"])


def q_null_violations(spark, d):
    v = flatten(_docs(spark, d, VEHICLE), VEHICLE)
    # planted: some rows lose a value
    for col, every in (("vin", 11), ("year_made", 13), ("make", 17)):
        v = v.withColumn(col, F.when(F.col("policy_id") % every != 0, F.col(col)))
    return checks.null_violations(v, ["policy_id", "vin", "year_made", "make"])


def _entity_tables(spark, d):
    """All five tables, from documents that are built once; each table parses its own fields of them."""
    path = _scratch(spark, "documents")
    docs = customer_documents(spark, d)
    write_documents(docs, path)
    docs = spark.read.schema(docs.schema).parquet(path)
    return {s.name: flatten(parse_document(docs, s), s).select(*s.columns) for s in (POLICY, COVERAGE, VEHICLE, DRIVER, CLAIM)}


def q_key_conflicts(spark, d):
    t = _entity_tables(spark, d)
    specs = {s.name: s for s in (POLICY, COVERAGE, VEHICLE, DRIVER, CLAIM)}
    # planted: repeated rows, and rows without a key, which conflict with none
    for name, every in (("policy", 7), ("claim", 5)):
        copies = F.when(F.col("policy_id") % every == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
        t[name] = t[name].withColumn("copy", F.explode(copies)).withColumn(
            "policy_id", F.when(F.col("copy") < 2, F.col("policy_id"))).drop("copy")
    found = checks.key_conflicts({n: (df, specs[n].keys) for n, df in t.items()})
    return found.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"))


def q_row_counts(spark, d):
    return checks.row_counts(_entity_tables(spark, d), minimum=1)


def q_envelope_shape(spark, d):
    env = parse_envelope(change_envelopes(spark, d))
    # planted: images that are missing
    env = env.withColumn("after", F.when(F.col("seq") % 13 != 0, F.col("after"))).withColumn(
        "before", F.when(F.col("seq") % 17 != 0, F.col("before")))
    return checks.envelope_shape(env)


def q_lag_percentiles(spark, d):
    log = change_log(spark, d)
    lag = F.col("ts_ms") - epoch_millis("event_time")
    return checks.lag_stats(log.withColumn("lag_ms", lag), "lag_ms", by=["op"])


# ---- streaming and publish ----------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    import uuid
    from changeflow.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/changeflow-queries/{name}-{uuid.uuid4().hex}"


def _doc_events(docs: DataFrame) -> list[DataFrame]:
    """Three phases over documents D: snapshot reads, updates that drop the
    orders with status F, deletes of BUILDING customers (before = shrunk)."""
    none = F.lit(None).cast("struct<id:bigint,data:string,created_at:string,updated_at:string>")

    def im(version: str):
        return F.struct("id", F.col(version).alias("data"), F.lit(None).cast("string").alias("created_at"),
                        F.lit(None).cast("string").alias("updated_at"))

    def phase(k: int, op: str, before, after) -> DataFrame:
        rows = docs.filter(F.col("id").isNotNull()) if k else docs
        rows = rows.filter(F.col("segment") == "BUILDING") if k == 2 else rows
        return rows.select(F.to_json(F.struct(before.alias("before"), after.alias("after"), F.lit(op).alias("op"),
                                              (F.col("ts_ms") + F.lit(k * 10**12)).alias("ts_ms"))).alias("value"),
                           (F.col("seq") + F.lit(k * 10**9)).alias("seq"))
    return [phase(0, "r", none, im("data")), phase(1, "u", im("data"), im("shrunk")), phase(2, "d", im("shrunk"), none)]


def _phases(spark, d, root: str, phases=(0, 1, 2)) -> Iterator[int]:
    """Write the phases as a change log, each when it is asked for; the number of files of each.
    The documents are built once, into files whose number goes by their bytes, as that of each
    phase's files does."""
    from changeflow.sinks.tables import HadoopFS
    docs = document_versions(spark, d, F.col("o_orderstatus") != "F")
    write_documents(docs, f"{root}/docs")
    docs = spark.read.schema(docs.schema).parquet(f"{root}/docs")
    fs, events = HadoopFS(spark, root), _doc_events(docs)
    for i in phases:
        write_documents(events[i], f"{root}/src/phase{i}")
        if i == phases[-1]:
            fs.delete(f"{root}/docs")
        yield sum(n.startswith("part-") for n in fs.list_names(f"{root}/src/phase{i}"))


def _write_phases(spark, d, root: str, phases=(0, 1, 2)) -> int:
    """Write the phases as a change log (files of one phase, then the next);
    returns the files per phase, so one micro-batch takes one phase."""
    return max([1, *_phases(spark, d, root, phases)])


def q_stream_equals_batch(spark, d):
    from changeflow.sinks import StagingStore, TableSet
    from changeflow.sources.changes import read_changes
    from changeflow.streaming.jobs import start_merge, start_staging
    root = _scratch(spark, "stream")
    per_phase = _write_phases(spark, d, root)
    store = StagingStore(spark, f"{root}/stg")
    tables = TableSet(spark, f"{root}/out", buckets=8)
    opts = {"maxFilesPerTrigger": str(per_phase), "recursiveFileLookup": "true"}
    start_staging(read_changes(spark, f"{root}/src", "parquet", opts), store, f"{root}/ck_stg",
                  {"availableNow": True}).awaitTermination()
    store.fs.delete(f"{root}/src")      # all of it is staged
    start_merge(store, tables, f"{root}/ck_merge", trigger={"availableNow": True}).awaitTermination()
    return tables.read("coverage")


ENTITY_SPECS = (POLICY, COVERAGE, VEHICLE, DRIVER, CLAIM)


def _keys_of(df: DataFrame, spec, version: int) -> DataFrame:
    """(version, entity, policy_id, key1, key2): the keys of an entity's rows."""
    keys = [F.col(k).cast("string") for k in spec.child_keys] + [F.lit(None).cast("string")] * 2
    return df.select(F.lit(version).alias("version"), F.lit(spec.name).alias("entity"), "policy_id",
                     keys[0].alias("key1"), keys[1].alias("key2"))


def q_atomic_publish(spark, d):
    """All phases, each published for all five tables at once; the rows of each version."""
    from changeflow.operators.merge import merge_batch as mb
    from changeflow.plans.pipelines import decode, stage_written
    from changeflow.sinks import TableSet
    from changeflow.sources.changes import read_change_log
    root = _scratch(spark, "publish")
    tables = TableSet(spark, f"{root}/out", buckets=8)
    for phase, _ in enumerate(_phases(spark, d, root)):
        work = f"{root}/work{phase}"
        rows = stage_written(decode(read_change_log(spark, f"{root}/src/phase{phase}")), work)
        tables.fs.delete(f"{work}/images")
        tables.commit({s.name: (rows[s.name], lambda cur, x, sp=s: mb(cur, x, sp.keys, sp.columns)) for s in ENTITY_SPECS}, by_bucket=True)
        for done in (work, f"{root}/src/phase{phase}"):     # the tables have it now
            tables.fs.delete(done)
    return reduce(DataFrame.unionByName, [_keys_of(tables.read(s.name, version=v), s, v) for v in (1, 2, 3) for s in ENTITY_SPECS])


#: the change log as an entity, by (policy_id, k)
LOG = EntitySpec("log", ("policy_id", "k"), (Leaf("k", (), "int"), Leaf("event_type", ()), Leaf("event_id", (), "bigint"),
                                             Leaf("value", (), "double")), time_column="source_event_time")


def _log_rows(spark, d) -> tuple[DataFrame, int]:
    """The change log as rows of LOG, and one more than its last ``seq``."""
    log = change_log(spark, d).withColumn("source_event_time", F.col("event_time")).withColumn("event_id", F.col("seq"))
    n = log.agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).first()[0]
    return log.select(*LOG.columns, "op", "event_time", "seq", "pos", "pos2"), n


def _merged_on_read(spark, d, commits: int, exact: bool):
    """Half of the log at once, the rest in small commits; the rows before and after folding."""
    from changeflow.sinks import ChangeTables
    log, n = _log_rows(spark, d)
    tables = ChangeTables(spark, f"{_scratch(spark, 'changes')}/t", [LOG], buckets=8, exact=exact)
    tables.append({"log": log.filter(F.col("seq") * 2 < n)})
    tables.fold(everything=True)
    part = F.floor((F.col("seq") * 2 - n) * commits / F.lit(n))
    for k in range(commits):
        # bounds on seq itself reach the scan
        lo, hi = (n + -(-n * k // commits)) // 2, (n + -(-n * (k + 1) // commits)) // 2 + 1
        tables.append({"log": log.filter((F.col("seq") >= lo) & (F.col("seq") <= hi) & (F.col("seq") * 2 >= n) & (part == k))})
    before = tables.manifest()["version"]
    tables.fold(everything=True)
    cols = ["policy_id", "k", "event_type", "event_id", "source_event_time", "value"]
    return tables.read("log", version=before).select(F.lit(False).alias("folded"), *cols).unionByName(
        tables.read("log").select(F.lit(True).alias("folded"), *cols))


def q_merge_on_read(spark, d):
    return _merged_on_read(spark, d, 50, exact=False)


def q_merge_on_read_exact(spark, d):
    return _merged_on_read(spark, d, 8, exact=True)


def q_bucket_growth(spark, d):
    """Four commits; folds split every bucket of more than one id, so that 4 buckets become 32. The rows after the second
    commit, read before its fold, and after the last, which no fold follows."""
    from changeflow.sinks import ChangeTables
    log, n = _log_rows(spark, d)
    tables = ChangeTables(spark, f"{_scratch(spark, 'growth')}/t", [LOG], buckets=4, exact=True, split_bytes=1)
    part, version = F.floor(F.col("seq") * 4 / F.lit(n)), {}
    for k in range(4):
        tables.append({"log": log.filter(part == k)})
        version[k + 1] = tables.manifest()["version"]
        if k < 3:
            tables.fold(everything=True)
    cols = ["policy_id", "k", "event_type", "event_id", "source_event_time", "value"]
    return reduce(DataFrame.unionByName, [tables.read("log", version=version[c]).select(F.lit(c).alias("commits"), *cols) for c in (2, 4)])


def q_models_incremental(spark, d):
    """Six model runs, each from its own staging batch and the touched keys' states."""
    from changeflow.sinks import StagingStore
    from changeflow.streaming.jobs import merge_once, model_tables
    root = _scratch(spark, "models")
    log, n = _log_rows(spark, d)
    store, tables = StagingStore(spark, f"{root}/stg", [LOG]), model_tables(spark, f"{root}/out", [LOG], buckets=8)
    for b in range(6):
        # bounds on seq itself reach the scan
        part = log.filter(F.col("seq").between(n * b // 6 - 1, n * (b + 1) // 6 + 1))
        store.append("log", part.filter(F.floor(F.col("seq") * 6 / F.lit(n)) == b), b)
        store.mark(b)
        merge_once(store, tables, mode="models_incremental")
    return tables.read("log").select("policy_id", "k", "event_type", "event_id", "source_event_time", "value")


def q_direct_stream(spark, d):
    """Every phase by the direct job: neither deletes nor shrunk documents remove a row."""
    from changeflow.sinks import TableSet
    from changeflow.sources.changes import read_changes
    from changeflow.streaming.jobs import start_direct
    root = _scratch(spark, "direct")
    per_phase = _write_phases(spark, d, root)
    tables = TableSet(spark, f"{root}/out", specs=[COVERAGE], buckets=8)
    opts = {"maxFilesPerTrigger": str(per_phase), "recursiveFileLookup": "true"}
    start_direct(read_changes(spark, f"{root}/src", "parquet", opts), tables, f"{root}/ck",
                 {"availableNow": True}).awaitTermination()
    return tables.read("coverage")


def q_debounced_merge(spark, d):
    """A burst of five staging batches, merged by a running job once it has settled; ``n_merges``
    is the number of merges that this took."""
    from changeflow.sinks import ChangeTables, StagingStore
    from changeflow.streaming.jobs import start_merge
    root = _scratch(spark, "burst")
    log, n = _log_rows(spark, d)
    store, tables = StagingStore(spark, f"{root}/stg", [LOG]), ChangeTables(spark, f"{root}/out", [LOG], buckets=8)
    for b in range(5):
        store.append("log", log.filter(F.floor(F.col("seq") * 5 / F.lit(n)) == b), b)
        store.mark(b)
    job = start_merge(store, tables, f"{root}/ck", trigger={"processingTime": "200 milliseconds"}, quiet_sec=0.3, max_batches=2)
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    merges = {tables.manifest(v)["progress"]["staging_batch"] for v in tables.versions()}
    return tables.read("log").select("policy_id", "k", "event_type", "event_id", "source_event_time", "value",
                                     F.lit(len(merges)).cast("long").alias("n_merges"))


def q_unnamed_paths(spark, d):
    """Documents of which some have begun to carry fields that no entity names."""
    from changeflow.operators.drift import unnamed_paths
    key = F.col("id")
    extra = F.to_json(F.struct(
        F.when(key % 3 == 0, F.lit("web")).alias("channel"),
        F.when(key % 4 == 0, F.struct((key * 2).alias("score"), (key % 8 == 0).alias("high"))).alias("risk"),
        F.when(key % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags")))
    docs = customer_documents(spark, d).withColumn("data", F.when((key % 3 == 0) | (key % 4 == 0) | (key % 5 == 0),
                                                                  json_patch("data", extra)).otherwise(F.col("data")))
    return unnamed_paths(docs)


def q_merge_lag(spark, d):
    """Six commits, each at the time of its last arrival; lag from event to merge of the rows
    that the table has in the end, by the time stored with them."""
    from changeflow.sinks import ChangeTables
    spec = EntitySpec("log", LOG.keys, (*LOG.leaves, Leaf("merged_at", (), "timestamp_ntz")), time_column=LOG.time_column)
    log, n = _log_rows(spark, d)
    log = log.join(change_log(spark, d).select("seq", "arrival_time"), "seq")
    tables = ChangeTables(spark, f"{_scratch(spark, 'lag')}/t", [spec], buckets=8)
    for b in range(6):
        part = log.filter(F.floor(F.col("seq") * 6 / F.lit(n)) == b)
        last = part.agg(F.max("arrival_time").cast("string")).first()[0]
        tables.append({"log": part}, run_at=F.lit(last).cast("timestamp_ntz"))
    rows = tables.read("log").withColumn("lag_ms", elapsed_ms("source_event_time", F.col("merged_at")))
    return checks.lag_stats(rows, "lag_ms", by=["merged_at"])


AS_OF = ("2024-01-05 12:00:00", "2024-01-16 00:00:00", "2024-01-29 06:30:00")


def q_history_as_of(spark, d):
    """The timeline from batches in no order of time, and what held at three times."""
    from changeflow.operators.timeline import add_to_timeline, as_of, timeline_spec
    from changeflow.sinks import ChangeTables
    log, _ = _log_rows(spark, d)
    line = timeline_spec(LOG)
    tables = ChangeTables(spark, f"{_scratch(spark, 'line')}/t", [line], buckets=8)
    for b in (2, 0, 3, 1):
        add_to_timeline(tables, LOG, log.filter(F.col("seq") % 4 == b))
    rows = tables.read(line.name)
    return reduce(DataFrame.unionByName, [
        as_of(rows, F.lit(t).cast("timestamp_ntz")).select(F.lit(t).cast("timestamp_ntz").alias("held_at"), "policy_id", "k", "event_id",
                                                           "event_type", "valid_from", "valid_to") for t in AS_OF])


def q_log_resume(spark, d):
    """A log in three partitions, read again from a position vector: half of partition 0, all
    of 1 (which the vector doesn't name), nothing of 2."""
    from changeflow.sources.partitioned_log import append_log, read_log
    path = f"{_scratch(spark, 'log')}/log"
    log = change_envelopes(spark, d).withColumn("p", F.get_json_object("value", "$.after.id"))
    key = F.coalesce(F.col("p"), F.get_json_object("value", "$.before.id")).cast("long")
    ends = append_log(log, path, F.pmod(key, F.lit(3)), 3)
    rest = parse_envelope(read_log(spark, path, {"0": ends["0"] // 2, "2": ends["2"]}))
    return rest.select("partition", "seq", "op", F.coalesce("after.id", "before.id").alias("id"))


def q_lost_checkpoint(spark, d):
    """Staging that loses its checkpoint between the updates and the deletes, and goes on by
    the positions that the store keeps; merged on read."""
    from changeflow.sinks import ChangeTables, StagingStore
    from changeflow.sources.changes import read_change_log
    from changeflow.sources.partitioned_log import append_log, stream_log
    from changeflow.streaming.jobs import merge_once, start_staging
    root = _scratch(spark, "lost")
    written = _phases(spark, d, root)
    store, tables = StagingStore(spark, f"{root}/stg"), ChangeTables(spark, f"{root}/out", buckets=8)
    for part, phases in enumerate(((0, 1), (2,))):
        for phase in phases:
            next(written)
            # a key has one partition in every phase
            append_log(read_change_log(spark, f"{root}/src/phase{phase}"), f"{root}/log", F.col("seq") % 10**9 % 3, 3)
            store.fs.delete(f"{root}/src/phase{phase}")     # the log has it now
        start_staging(stream_log(spark, f"{root}/log"), store, f"{root}/ck{part}", {"availableNow": True}).awaitTermination()
        merge_once(store, tables)
    return tables.read("coverage")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
