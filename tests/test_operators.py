"""Operators on hand-made inputs: sources, hot keys, checks."""

import json

from pyspark.sql import functions as F

from changeflow.operators import checks
from changeflow.operators.resolve import dead_keys, dead_keys_correlated, history, latest_per_key
from changeflow.sources.changes import parse_envelope, peek_changes, read_change_log
from changeflow.sources.seeds import messages_frame, scenario_messages, seed_policies
from changeflow.sources.snapshots import diff_snapshots, snapshot_events


def _skewed_log(spark, n=3000):
    """One key (7) holds a third of all events; the rest spread over 200 keys."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 200 + 100).alias("policy_id"),
        F.col("id").alias("seq"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                                          ((F.col("id") * 37) % 1000).cast("decimal(18,6)"))
         ).alias("event_time"),
        F.when(F.col("id") % 5 == 0, F.lit("d")).otherwise(F.lit("u")).alias("op"),
        F.lit(0).alias("pos"), F.lit(0).alias("pos2"))


def test_history_slices_equal_window_on_hot_and_null_keys(spark):
    log = _skewed_log(spark)
    nulls = log.limit(50).withColumn("policy_id", F.lit(None).cast(log.schema["policy_id"].dataType))
    log = log.unionByName(nulls)
    a = history(log, ["policy_id"], slice_ms=60_000)
    b = history(log, ["policy_id"], method="window").select(*a.columns)
    assert a.count() == log.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.filter("policy_id = 7").agg(F.max("version")).collect()[0][0] == 1000


def test_latest_forms_agree_on_hot_key(spark):
    log = _skewed_log(spark)
    w = latest_per_key(log, ["policy_id"], method="window")
    m = latest_per_key(log, ["policy_id"], method="max_by")
    assert w.exceptAll(m).count() == 0 and w.count() == 201


def test_dead_key_forms_agree(spark):
    log = _skewed_log(spark)
    forms = [dead_keys(log, ["policy_id"]), dead_keys(log, ["policy_id"], method="join"),
             dead_keys_correlated(log, ["policy_id"])]
    sets = [sorted(r[0] for r in f.collect()) for f in forms]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) > 0


def test_peek_and_batch_log(spark, workdir):
    msgs = messages_frame(spark, [r for b in scenario_messages() for r in b])
    msgs.write.parquet(f"{workdir}/log")
    log = read_change_log(spark, f"{workdir}/log")
    assert [r["seq"] for r in peek_changes(log, 2).collect()] == [1, 2]
    assert parse_envelope(log).count() == 7


def test_snapshot_events_and_diff(spark):
    seeds = seed_policies(spark)
    ev = parse_envelope(snapshot_events(seeds, 5).select(F.to_json(F.struct("*")).alias("value"),
                                                         F.lit(1).cast("long").alias("seq")))
    assert [r["op"] for r in ev.collect()] == ["r"] * 4
    changed = seeds.withColumn("data", F.when(F.col("id") == 2, F.lit('{"status":"x"}')).otherwise(F.col("data")))
    new = changed.filter("id != 3").unionByName(spark.createDataFrame([(9, "{}")], "id long, data string"))
    d = diff_snapshots(seeds, new, 10)
    got = sorted((r["op"], (r["after"] or r["before"])["id"]) for r in d.collect())
    assert got == [("c", 9), ("d", 3), ("u", 2)]
    u = d.filter("op = 'u'").collect()[0]
    assert json.loads(u["before"]["data"])["status"] == "expired" and json.loads(u["after"]["data"]) == {"status": "x"}


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    assert checks.unique_violations(df, ["k", "v"]).collect()[0]["n_rows"] == 2
    nulls = {r["column_name"]: r["n_null"] for r in checks.null_violations(df, ["k", "v"]).collect()}
    assert nulls == {"k": 0, "v": 1}
    rc = {r["table_name"]: (r["n_rows"], r["ok"]) for r in checks.row_counts({"t": df, "e": df.limit(0)}).collect()}
    assert rc == {"t": (3, True), "e": (0, False)}
    parent = spark.createDataFrame([(1,), (3,)], "policy_id long")
    child = spark.createDataFrame([(1,), (1,), (2,)], "policy_id long")
    assert sorted(tuple(r) for r in checks.children_per_parent(parent, child).collect()) == [(1, 2), (3, 0)]
    assert [r[0] for r in checks.orphans(child, parent).collect()] == [2]
    lag = spark.createDataFrame([(10,), (20,), (30,), (40,)], "lag long")
    r = checks.lag_stats(lag, "lag").collect()[0]
    assert (r["p50_ms"], r["p90_ms"], r["max_ms"], r["n_rows"]) == (20, 40, 40, 4)


def test_exact_quantiles_match_nearest_rank_on_hot_group(spark):
    import math
    import random
    rnd = random.Random(3)
    vals = [("hot", rnd.randint(0, 500)) for _ in range(3000)] + [(f"g{i % 40}", rnd.randint(0, 50)) for i in range(6000)]
    df = spark.createDataFrame(vals, "g string, v long")
    got = {r["g"]: (r["p50"], r["p90"], r["p99"], r["n_rows"])
           for r in checks.exact_quantiles(df, "v", ["g"], partitions=7).collect()}
    for g in ("hot", "g3"):
        xs = sorted(v for k, v in vals if k == g)
        want = tuple(xs[max(math.ceil(len(xs) * p) - 1, 0)] for p in (0.5, 0.9, 0.99)) + (len(xs),)
        assert got[g] == want
