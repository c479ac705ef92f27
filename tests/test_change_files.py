"""Merge-on-read tables and incremental model runs: equal to the rewriting forms, with cost by the change."""

import json
import os
from random import Random

import pytest
from pyspark.sql import functions as F

from changeflow.operators.filters import drop_deletes
from changeflow.operators.merge import merge_batch, run_model
from changeflow.schemas import EntitySpec, Leaf
from changeflow.sinks import ChangeTables, StagingStore, TableSet
from changeflow.sinks.staging import staging_schema
from changeflow.sources.seeds import messages_frame, scenario_messages
from changeflow.streaming.jobs import merge_once, model_tables, staging_batch

ITEM = EntitySpec("item", ("policy_id", "code"), (Leaf("code", ()), Leaf("amount", (), "int")))
NAMES = ["policy", "coverage", "vehicle", "driver", "claim"]


def batches(spark, seed, n=7, keys=9):
    """Batches of events with late, deleted and revived keys."""
    rng, seq, out = Random(seed), 0, []
    for _ in range(n):
        rows = []
        for _ in range(rng.randrange(1, 14)):
            seq += 1
            t = rng.randrange(40)
            rows.append((rng.randrange(keys), rng.choice("ab"), seq, rng.choice("cruudd"), f"2024-01-01 00:00:{t:02d}", seq, 1, None))
        df = spark.createDataFrame(rows, "policy_id long, code string, amount int, op string, t string, seq long, pos int, pos2 int")
        out.append(df.withColumn("event_time", F.col("t").cast("timestamp_ntz")).drop("t"))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("policy_id", "code", "amount").collect()))


@pytest.mark.parametrize("exact", [False, True])
def test_merge_on_read_equals_rewriting(spark, workdir, exact):
    # a folder above that is named like a commit's
    tables = ChangeTables(spark, f"{workdir}/changes-{'0' * 32}/t", [ITEM], buckets=3, exact=exact, fold_commits=3)
    cols = tables.stored_columns("item")
    state = spark.createDataFrame([], tables._schema("item"))
    for k, batch in enumerate(batches(spark, 3, n=5)):
        state = spark.createDataFrame(
            merge_batch(state, batch, ITEM.keys, cols, exact=exact).collect(), state.schema)
        tables.append({"item": batch}, progress={"k": k})
        want = rows_of(drop_deletes(state) if exact else state)
        assert rows_of(tables.read("item")) == want
        if k % 2:
            tables.fold()
            assert rows_of(tables.read("item")) == want
    before = tables.manifest()["version"]
    tables.fold(everything=True)
    assert rows_of(tables.read("item")) == want == rows_of(tables.read("item", version=before))
    m = tables.manifest()
    assert m["tables"]["item"]["changes"] == [] and m["progress"] == {"k": 4} and tables.due() == {}


def one_key(spark, key):
    return spark.createDataFrame([(key, "a", 1, "u", 10**9, 1, None)], "policy_id long, code string, amount int, op string, seq long, pos int, pos2 int") \
        .withColumn("event_time", F.lit("2024-02-01").cast("timestamp_ntz"))


def test_bytes_written_go_by_the_change(spark, workdir):
    sizes = {}
    for n in (100, 50_000):
        tables = ChangeTables(spark, f"{workdir}/t{n}", [ITEM], buckets=4)
        big = spark.range(n).select(F.col("id").alias("policy_id"), F.lit("a").alias("code"), F.col("id").cast("int").alias("amount"),
                                    F.lit("c").alias("op"), F.lit("2024-01-01").cast("timestamp_ntz").alias("event_time"),
                                    F.col("id").alias("seq"), F.lit(1).alias("pos"), F.lit(1).alias("pos2"))
        tables.append({"item": big})
        base = tables.fold()["tables"]["item"]["base"]
        m = tables.append({"item": one_key(spark, 7)})["tables"]["item"]
        assert m["base"] == base and len(m["changes"]) == 1 and len(m["changes"][0]["bytes"]) == 1
        sizes[n] = sum(m["changes"][0]["bytes"].values())
        assert tables.read("item").filter("policy_id = 7").collect()[0]["amount"] == 1 and tables.read("item").count() == n
    assert sizes[100] == pytest.approx(sizes[50_000], abs=64)


def test_few_keys_reach_the_scan(spark, workdir):
    """A lookup of few keys reads their buckets' files only, with the ids as a pushed filter."""
    from tests.test_plans import plan
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=8)
    events = spark.range(4000).select(F.col("id").alias("policy_id"), F.lit("a").alias("code"), F.col("id").cast("int").alias("amount"),
                                      F.lit("c").alias("op"), F.lit("2024-01-01").cast("timestamp_ntz").alias("event_time"),
                                      F.col("id").alias("seq"), F.lit(1).alias("pos"), F.lit(1).alias("pos2"))
    tables.append({"item": events})
    m = tables.fold(everything=True)
    few = tables.read_keys("item", events.filter("policy_id in (7, 2500)"), m)
    assert rows_of(few) == [(7, "a", 7), (2500, "a", 2500)] and len(few.inputFiles()) <= 2
    assert "PushedFilters: [In(policy_id" in plan(few) or "PushedFilters: [Or(EqualTo(policy_id" in plan(few)
    many = tables.read_keys("item", events.filter("policy_id < 300"), m, most=10)
    assert {(k, "a", k) for k in range(300)} <= set(rows_of(many))
    assert tables.read_keys("item", events.limit(0), m).count() == 0


def test_concurrent_writers_all_get_in(spark, workdir):
    """A commit that another overtakes adds itself to the newer version; a fold keeps what came after it."""
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=2)
    other = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=2)
    tables.append({"item": one_key(spark, 1)})
    publish, met = tables._publish, []

    def overtaken(m):
        if not met:
            met.append(m["version"])
            other.append({"item": one_key(spark, 2)}, progress={"other": 1})
        return publish(m)

    tables._publish = overtaken
    m = tables.append({"item": one_key(spark, 3)}, progress={"own": 1})
    assert m["version"] == 3 and m["progress"] == {"other": 1, "own": 1}
    met.clear()

    def overtaken_fold(m):
        if not met:
            met.append(m["version"])
            other.append({"item": one_key(spark, 1).withColumn("amount", F.lit(5))})
        return publish(m)

    tables._publish = overtaken_fold
    m = tables.fold(everything=True)
    assert len(m["tables"]["item"]["changes"]) == 1
    assert rows_of(tables.read("item")) == [(1, "a", 5), (2, "a", 1), (3, "a", 1)]
    # what is already applied is not published again
    tables._publish = publish
    again = tables.append({"item": one_key(spark, 9)}, applied=lambda m: m["progress"].get("own") == 1)
    assert again["version"] == m["version"]


def test_expiry_keeps_what_is_named(spark, workdir):
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=2)
    for k in range(4):
        tables.append({"item": one_key(spark, k)})
    tables.fold(everything=True)
    folder = f"{tables.root}/item"
    assert len(os.listdir(folder)) == 5 and tables.expire(keep_versions=1) == []       # too young
    gone = tables.expire(keep_versions=1, older_than_sec=-5)
    assert len(gone) == 4 and len(os.listdir(folder)) == 1 and tables.versions() == [5]
    assert tables.read("item").count() == 4 and tables.expire(keep_versions=1, older_than_sec=-5) == []


PARENT = EntitySpec("parent", ("policy_id",), (Leaf("amount", (), "int"),))


def many(spark, lo, hi, seq, op="c", code="a"):
    return spark.range(lo, hi).select(
        F.col("id").alias("policy_id"), F.lit(code).alias("code"), (F.col("id") + seq).cast("int").alias("amount"), F.lit(op).alias("op"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("event_time"), F.lit(seq).cast("long").alias("seq"), F.lit(1).alias("pos"), F.lit(1).alias("pos2"))


def buckets_of(m, name):
    return {b: e["path"] for b, e in m["tables"][name]["base"].items() if "path" in e}


@pytest.mark.parametrize("exact", [False, True])
def test_buckets_grow(spark, workdir, exact):
    """Two buckets become many over folds; every version reads as the plain merge does."""
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM, PARENT], buckets=2, exact=exact, split_bytes=4000, fold_commits=2)
    cols = tables.stored_columns("item")
    state, seen, grown = spark.createDataFrame([], tables._schema("item")), {}, []
    for k in range(4):
        batch = many(spark, 100 * k, 100 * k + 300, k, "c" if k % 2 else "u").unionByName(many(spark, 50 * k, 50 * k + 20, k, "d"))
        state = spark.createDataFrame(merge_batch(state, batch, ITEM.keys, cols, exact=exact).collect(), state.schema)
        want = rows_of(drop_deletes(state) if exact else state)
        tables.append({"item": batch, "parent": batch.drop("code")})
        m = tables.manifest()
        seen[m["version"]] = want
        assert rows_of(tables.read("item")) == want
        after = tables.fold(everything=k % 2 == 0)
        seen[after["version"]] = want
        assert rows_of(tables.read("item")) == want
        grown.append(len(buckets_of(after, "item")))
        leaves = [leaf for b in "01" for leaf in tables._within(b, after)]
        for name in ("item", "parent"):     # parent and children by the same buckets, each row in its own
            assert buckets_of(after, name).keys() <= set(leaves)
            for b, path in buckets_of(after, name).items():
                assert tables.touched_buckets(spark.read.parquet(path), m=after) == [b]
    assert grown == sorted(grown) and grown[-1] >= 8
    for v, want in seen.items():
        assert rows_of(tables.read("item", version=v)) == want
    keys = tables.read_keys("item", many(spark, 340, 342, 0), tables.manifest())
    assert {r for r in rows_of(drop_deletes(keys) if exact else keys) if r[0] in (340, 341)} == {r for r in want if r[0] in (340, 341)}
    again = ChangeTables(spark, f"{workdir}/t", [ITEM, PARENT], buckets=2, exact=exact)     # any reader follows the manifest
    assert rows_of(again.read("item")) == want
    tables.fold(everything=True)
    tables.expire(keep_versions=1, older_than_sec=-5)
    assert rows_of(tables.read("item")) == want


def test_a_split_leaves_the_other_buckets(spark, workdir):
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=4)
    tables.append({"item": many(spark, 0, 400, 1)})
    m = tables.fold()
    before = buckets_of(m, "item")
    target = tables.touched_buckets(many(spark, 7, 8, 0), m=m)[0]
    near = many(spark, 1000, 9000, 2).filter(tables.bucket_column("policy_id", m) == target)
    tables.append({"item": near})
    tables.split_bytes = max(e["bytes"] for e in m["tables"]["item"]["base"].values()) + 1000
    after = buckets_of(tables.fold(), "item")
    assert target not in after and {b: p for b, p in after.items() if "." not in b} == {b: p for b, p in before.items() if b != target}
    assert set(after) - set(before) == set(tables._halves(target))
    assert tables.read("item").count() == 400 + near.count()
    read = tables.read_keys("item", many(spark, 7, 8, 0), tables.manifest())
    assert len(read.inputFiles()) == 1 and rows_of(read) == [(7, "a", 8)]


def test_one_hot_id_is_not_split(spark, workdir):
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=1, split_bytes=1)
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("policy_id"), F.concat(F.lit("c"), "id").alias("code"), F.col("id").cast("int").alias("amount"),
                                   F.lit("c").alias("op"), F.lit("2024-01-01").cast("timestamp_ntz").alias("event_time"), F.col("id").alias("seq"),
                                   F.lit(1).alias("pos"), F.lit(1).alias("pos2"))
    tables.append({"item": hot.unionByName(many(spark, 6, 8, 1))})
    for _ in range(70):
        v = tables.manifest()["version"]
        if tables.fold()["version"] == v:
            break
    m = tables.manifest()
    assert tables.too_large() == [] and m["version"] < 60
    assert len(buckets_of(m, "item")) == 3      # one id each
    assert tables.read("item").count() == 3002 and tables.read_keys("item", hot.limit(1), m).count() == 3000
    # an empty table and null ids have nothing to split
    empty = ChangeTables(spark, f"{workdir}/e", [ITEM], buckets=1, split_bytes=1)
    assert empty.too_large() == [] and empty.fold()["version"] == 0
    empty.append({"item": many(spark, 0, 2, 1).withColumn("policy_id", F.lit(None).cast("long")).withColumn("code", F.col("amount").cast("string"))})
    empty.fold()
    assert empty.too_large() == [] and empty.read("item").count() == 2


def test_commits_from_before_a_split_are_read_for_both_halves(spark, workdir):
    """A commit that a split overtakes keeps its files; folding one half leaves them live for the other."""
    tables = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=1, split_bytes=1)
    other = ChangeTables(spark, f"{workdir}/t", [ITEM], buckets=1, split_bytes=1)
    tables.append({"item": many(spark, 0, 40, 1)})
    publish, met = tables._publish, []

    def overtaken(m):
        if not met:
            met.append(other.fold())
        return publish(m)

    tables._publish = overtaken
    tables.append({"item": many(spark, 0, 40, 2).filter("policy_id % 2 = 0")})
    m = tables.manifest()
    assert met[0]["splits"] == ["0"] == m["splits"] and list(m["tables"]["item"]["changes"][0]["bytes"]) == ["0"]
    want = [(k, "a", k + (2 if k % 2 == 0 else 1)) for k in range(40)]
    assert rows_of(tables.read("item")) == want
    half, rest = tables._halves("0")
    assert sorted(rows_of(tables.read_buckets("item", [half], m)) + rows_of(tables.read_buckets("item", [rest], m))) == want
    # newer changes of one half only, folded there alone
    newer = many(spark, 0, 40, 3).filter(tables.bucket_column("policy_id", m) == half)
    tables.append({"item": newer})
    tables.fold_commits, tables.fold_share, tables.split_bytes = 2, 10 ** 6, 1 << 30
    m = tables.fold()
    of = {b: e["v"] for b, e in m["tables"]["item"]["base"].items()}
    assert of[half] > of[rest] and len(m["tables"]["item"]["changes"]) == 1
    ids = {r[0] for r in newer.select("policy_id").collect()}
    want = [(k, c, k + 3 if k in ids else a) for k, c, a in want]
    assert rows_of(tables.read("item")) == want
    assert tables.fold(everything=True)["tables"]["item"]["changes"] == [] and rows_of(tables.read("item")) == want
    # a split that another fold of the same bucket overtakes changes nothing
    tables.split_bytes, met[:] = 1, []
    v = tables.manifest()["version"]
    other.split_bytes = 1
    assert tables.fold()["version"] == v + 1 == tables.manifest()["version"] and rows_of(tables.read("item")) == want


def staged(spark, store, name, df, b):
    store.append(name, df.select(*[f.name for f in staging_schema(store.specs[name]).fields if f.name != "batch_id"]), b)
    store.mark(b)


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_models_equal_full_rescans(spark, workdir, seed):
    store = StagingStore(spark, f"{workdir}/stg", [ITEM])
    tables = model_tables(spark, f"{workdir}/t", [ITEM], buckets=2, fold_commits=3)
    target, log = spark.createDataFrame([], ITEM.output_schema()), None
    for b, batch in enumerate(batches(spark, seed, n=5, keys=4)):
        staged(spark, store, "item", batch, b)
        log = batch if log is None else log.unionByName(batch)
        full = run_model(target, log, ITEM.keys, ITEM.columns)
        target = spark.createDataFrame(full.collect(), ITEM.output_schema())
        merge_once(store, tables, mode="models_incremental")
        assert rows_of(tables.read("item")) == rows_of(target), b
    v = tables.manifest()["version"]
    merge_once(store, tables, mode="models_incremental")      # nothing new
    assert tables.manifest()["version"] == v


def test_incremental_models_read_new_slices_only(spark, workdir):
    from tests.test_plans import plan
    store = StagingStore(spark, f"{workdir}/stg", [ITEM])
    for b, batch in enumerate(batches(spark, 4, n=3)):
        staged(spark, store, "item", batch, b)
    p = plan(store.read("item", 1, 2))
    assert "PartitionFilters" in p and "batch_id" in p
    tables = model_tables(spark, f"{workdir}/t", [ITEM], buckets=4)
    read = []
    store.read, true = lambda n, lo=None, hi=None: read.append((lo, hi)) or true(n, lo, hi), store.read
    merge_once(store, tables, hi=1, mode="models_incremental")
    merge_once(store, tables, hi=2, mode="models_incremental")
    assert read == [(-1, 1), (1, 2)]


def test_scenario_in_change_tables(spark, workdir):
    store = StagingStore(spark, f"{workdir}/stg")
    plain, change = TableSet(spark, f"{workdir}/p", buckets=4), ChangeTables(spark, f"{workdir}/c", buckets=4)
    models = model_tables(spark, f"{workdir}/m", buckets=4)
    for b, batch in enumerate(scenario_messages()):
        staging_batch(store)(messages_frame(spark, batch), b)
        if b in (1, 3):     # two merges of two batches each
            last, got = merge_once(store, plain), merge_once(store, change)
            assert got["metrics"]["policy"].items() >= last["metrics"]["policy"].items()
            merge_once(store, models, mode="models_incremental")
    for n in NAMES:
        want = sorted(map(str, plain.read(n).collect()))
        assert [sorted(map(str, t.read(n).collect())) for t in (change, models)] == [want] * 2
    assert json.loads(change.fs.read_text(f"{change._mdir()}/m-{1:020d}.json"))["version"] == 1


def test_metrics_are_observed_by_the_write(spark, workdir):
    spec = EntitySpec("item", ITEM.keys, (*ITEM.leaves, Leaf("merged_at", (), "timestamp_ntz")))
    tables = ChangeTables(spark, f"{workdir}/t", [spec], buckets=2)
    lags = []
    for k, batch in enumerate(batches(spark, 6, n=3)):
        at = f"2024-01-0{k + 2} 00:00:00"
        m = tables.append({"item": batch}, run_at=F.lit(at).cast("timestamp_ntz"))
        seen = m["metrics"]["item"]
        latest = merge_batch(spark.createDataFrame([], tables._schema("item")), batch.withColumn("merged_at", F.lit(at).cast("timestamp_ntz")),
                             ITEM.keys, spec.columns)
        touched = batch.select(*ITEM.keys).distinct().count()
        assert (seen["rows_merged"], seen["keys_touched"]) == (latest.count(), touched)
        assert seen["max_seq"] == batch.agg(F.max("seq")).collect()[0][0]
        assert {str(r[0]) for r in tables.read("item").filter(f"merged_at = '{at}'").select("merged_at").collect()} <= {at}
        lags.append(touched)
    got = tables.lag().collect()
    assert [(r.entity, r.n_rows) for r in got] == [("item", sum(lags))] and 86_300_000 < got[0].p50_ms < 3 * 86_400_000
    # an empty slice has metrics too, and adds no file
    empty = tables.append({"item": batch.limit(0)})
    assert empty["metrics"]["item"].get("rows_merged", 0) == 0 and empty["tables"] == m["tables"]


def test_clock_columns(spark):
    from changeflow.functions.time import elapsed_ms, run_time
    at = F.lit("2024-01-02 00:00:01.5").cast("timestamp_ntz")
    r = spark.range(3).select(elapsed_ms(F.lit("2024-01-02").cast("timestamp_ntz"), at).alias("ms"), run_time().alias("now"),
                              elapsed_ms(run_time()).alias("none")).collect()
    assert [x.ms for x in r] == [1500] * 3 and len({x.now for x in r}) == 1 and {x.none for x in r} == {0}
    import datetime
    assert abs((r[0].now - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).total_seconds()) < 60


def test_a_burst_gives_one_version(spark, workdir):
    from changeflow.streaming.jobs import merge_batch_handler, settled_batch, start_merge
    store = StagingStore(spark, f"{workdir}/stg")
    tables = ChangeTables(spark, f"{workdir}/out", buckets=2)
    handler, messages = staging_batch(store), scenario_messages()
    # a clock of its own: every look at it finds another batch, until the burst is over
    now, left = [0.0], list(enumerate(messages))

    def sleep(sec):
        now[0] += sec
        if left:
            b, batch = left.pop(0)
            handler(messages_frame(spark, batch), b)

    assert settled_batch(store, 0.25, 100, clock=lambda: now[0], sleep=sleep) == 3
    handle = merge_batch_handler(store, tables, quiet_sec=0.2)
    handle(spark.createDataFrame([(0, 0)], "batch_id long, n_messages long"), 0)
    assert tables.versions()[0] == 1 and tables.manifest()["progress"]["staging_batch"] == 3
    assert handle.last["metrics"]["tables_seen"] == ["policy", "coverage", "vehicle", "driver", "claim"]
    versions = tables.versions()
    handle(spark.createDataFrame([(3, 0)], "batch_id long, n_messages long"), 1)      # a marker of the same burst
    assert tables.versions() == versions and handle.last["metrics"]["tables_seen"] == []
    # a burst without end is merged after the upper bound
    now[0] = 0
    assert settled_batch(store, 50, 3, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)) == 3 and 3 <= now[0] < 4
    other = ChangeTables(spark, f"{workdir}/other", buckets=2)
    start_merge(store, other, f"{workdir}/ck", trigger={"availableNow": True}, quiet_sec=0.2, max_batches=1).awaitTermination()
    assert other.manifest()["progress"]["staging_batch"] == 3
    assert len({v for v in other.versions() if other.manifest(v)["progress"] != (other.manifest(v - 1)["progress"] if v > 1 else None)}) == 1
