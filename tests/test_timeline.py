"""The kept timeline against the history of all events, and as-of reads; snapshot diffs by ranges."""

from pyspark.sql import functions as F

from changeflow.operators.resolve import history
from changeflow.operators.timeline import add_to_timeline, as_of, join_as_of, timeline_spec
from changeflow.sinks import ChangeTables
from changeflow.sources.snapshots import changed_ranges, diff_snapshots, without_id
from tests.test_change_files import ITEM, batches


def spans(df, time="event_time"):
    return sorted((str(r.policy_id), r.code, r.amount, str(r[time]), str(r.valid_to)) for r in df.collect())


def test_timeline_equals_history(spark, workdir):
    parts = batches(spark, 11, n=4, keys=4)
    line = timeline_spec(ITEM)
    tables = ChangeTables(spark, f"{workdir}/t", [line], buckets=2)
    log = None
    for k in (2, 0, 3, 1):      # batches out of order; one comes twice
        log = parts[k] if log is None else log.unionByName(parts[k])
        m = add_to_timeline(tables, ITEM, parts[k], progress={"k": k})
        if k == 3:
            again = add_to_timeline(tables, ITEM, parts[k])
            assert again["metrics"][line.name]["keys_touched"] == 0
        assert spans(tables.read(line.name), "valid_from") == spans(history(log, ITEM.keys))
    # a batch writes its own rows and those whose span it ends, no others
    assert m["metrics"][line.name]["keys_touched"] <= 2 * parts[1].count()
    rows = tables.read(line.name)
    asked = log.select("policy_id", "code").distinct().crossJoin(spark.range(0, 41, 5).select(
        F.expr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("at")))
    got = {(r.policy_id, r.code, r.at): (r.amount if r.event_op else None) for r in join_as_of(asked, rows, ITEM.keys, "at").collect()}
    want, events = {}, log.collect()
    for r in asked.collect():
        before = [e for e in events if (e.policy_id, e.code) == (r.policy_id, r.code) and e.event_time <= r["at"]]
        last = max(before, key=lambda e: (e.event_time, e.seq), default=None)
        want[r.policy_id, r.code, r["at"]] = last.amount if last and last.op != "d" else None
    assert got == want
    at = max(t for _, _, t in want)
    held = as_of(rows, F.lit(str(at)).cast("timestamp_ntz")).collect()
    assert sorted((r.policy_id, r.code, r.amount) for r in held) == sorted((p, c, n) for (p, c, t), n in want.items() if t == at and n is not None)


def test_diff_by_ranges(spark):
    old = spark.range(2000).select("id", F.concat(F.lit("v"), "id").alias("data"))
    new = old.filter("id not in (5, 77)").withColumn("data", F.when(F.col("id") % 500 == 3, F.lit(None)).otherwise(F.col("data")))
    new = new.unionByName(spark.createDataFrame([(9000, "new"), (None, "lost")], "id long, data string"))
    for ranges in (0, 1, 64, 65_536):
        got = {(r.op, (r.after or r.before).id): r.seq for r in diff_snapshots(old, new, 5, seq=7, ranges=ranges).collect()}
        assert got == {k: 7 for k in [("d", 5), ("d", 77), ("c", 9000), *(("u", i) for i in (3, 503, 1003, 1503))]}
    # rows that take part in the join go by the changes
    assert changed_ranges(old, new.filter("id is not null"), "id", ["id", "data"], 65_536).count() == 7
    assert diff_snapshots(old, old, 5).count() == 0
    assert [(r.data, r.reason) for r in without_id(new).collect()] == [("lost", "null_id")]
