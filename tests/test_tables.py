"""Keyed table set: bucket-local rewrite, all-or-nothing publish, replay safety."""

import json

from changeflow.operators.merge import merge_batch
from changeflow.plans.pipelines import decode, stage
from changeflow.sinks import TableSet
from changeflow.sources.seeds import messages_frame, scenario_messages


def _staged(spark, b):
    return stage(decode(messages_frame(spark, scenario_messages()[b])))


def _commit(ts, rows):
    return ts.commit({s.name: (rows[s.name], lambda cur, r=rows[s.name], sp=s: merge_batch(cur, r, sp.keys, sp.columns))
                      for s in ts.specs.values()})


def test_publish_rewrites_only_touched_buckets(spark, workdir):
    ts = TableSet(spark, f"{workdir}/t", buckets=16)
    m1 = _commit(ts, _staged(spark, 0))
    m2 = _commit(ts, _staged(spark, 1))          # one new policy: one bucket per table rewritten
    changed = {n: [b for b, p in m2["tables"][n].items() if m1["tables"][n].get(b) != p] for n in ts.specs}
    assert changed.pop("claim") == []                         # the new policy has no claims
    assert all(len(v) == 1 for v in changed.values())
    assert len({tuple(v) for v in changed.values()}) == 1    # same bucket number in every table
    assert ts.read("coverage").count() == 9


def test_interrupted_publish_keeps_previous_version(spark, workdir):
    ts = TableSet(spark, f"{workdir}/t", buckets=4)
    _commit(ts, _staged(spark, 0))
    original = ts._publish
    ts._publish = lambda m: (_ for _ in ()).throw(RuntimeError("crash before manifest"))
    try:
        _commit(ts, _staged(spark, 1))
    except RuntimeError:
        pass
    ts._publish = original
    # data files of the failed version exist, but readers still see version 1 for every table
    assert ts.manifest()["version"] == 1
    assert [ts.read(n).count() for n in ("policy", "coverage")] == [4, 8]
    m = _commit(ts, _staged(spark, 1))           # the retry reuses the version folder
    assert m["version"] == 2 and ts.read("coverage").count() == 9


def test_manifest_is_plain_json_and_versions_are_readable(spark, workdir):
    ts = TableSet(spark, f"{workdir}/t", buckets=4)
    _commit(ts, _staged(spark, 0))
    _commit(ts, _staged(spark, 1))
    assert ts.read("policy", version=1).count() == 4 and ts.read("policy").count() == 5
    text = ts.fs.read_text(f"{ts.root}/_manifests/m-{2:020d}.json")
    assert json.loads(text)["version"] == 2


def test_exact_transactional_merge_through_tables(spark, workdir):
    from changeflow.sinks import StagingStore
    from changeflow.streaming.jobs import merge_once, staging_batch
    from tests.helpers import doc, ev, msgs
    new, old = doc(status="new"), doc(status="old")
    batches = [[ev("u", 20_000, 1, 1, before=old, after=new)], [ev("u", 10_000, 1, 2, before=new, after=old)]]
    results = {}
    for exact in (False, True):
        store = StagingStore(spark, f"{workdir}/stg{exact}")
        tables = TableSet(spark, f"{workdir}/t{exact}", buckets=4, keep_order=exact)
        for b, rows in enumerate(batches):
            staging_batch(store)(msgs(spark, rows), b)
            merge_once(store, tables, exact=exact)
        results[exact] = [r["status"] for r in tables.read("policy").collect()]
        if exact:
            assert "event_time" not in tables.read("policy").columns
            assert "event_time" in tables.read("policy", hidden=True).columns
    assert results == {False: ["old"], True: ["new"]}


def test_exact_tables_hide_deleted_rows_and_keep_them_dead(spark, workdir):
    from changeflow.sinks import StagingStore
    from changeflow.streaming.jobs import merge_once, staging_batch
    from tests.helpers import cov, doc, ev, msgs
    d = doc(coverages=[cov("a")])
    store, tables = StagingStore(spark, f"{workdir}/stg"), TableSet(spark, f"{workdir}/t", buckets=4, keep_order=True)
    for b, event in enumerate([ev("c", 10_000, 1, 1, after=d), ev("d", 30_000, 1, 2, before=d),
                               ev("u", 20_000, 1, 3, before=d, after=d)]):
        staging_batch(store)(msgs(spark, [event]), b)
        merge_once(store, tables, exact=True)
        assert tables.read("coverage").count() == (1 if b == 0 else 0)
    assert [r["op"] for r in tables.read("coverage", hidden=True).collect()] == ["d"]


def test_direct_batch_keeps_rejects(spark, workdir):
    from changeflow.streaming.jobs import direct_batch
    from tests.helpers import doc, ev, msgs
    no_vin = doc(vehicles=[{"make": "x", "drivers": [{"name": "n", "license_number": "L1"}]}])
    tables = TableSet(spark, f"{workdir}/t", buckets=4)
    batch = msgs(spark, [("{", 1), ev("x", 1000, 1, 2, after=doc()), ev("c", 1000, 2, 3, after=no_vin)])
    direct_batch(tables)(batch, 0)
    direct_batch(tables)(batch, 0)
    got = sorted((r["seq"], r["reason"]) for r in spark.read.parquet(f"{tables.root}/rejects").collect())
    assert got == [(1, "unparsable_or_no_op"), (2, "unknown_op"), (3, "driver:null_key")]
    assert [r["policy_id"] for r in tables.read("policy").collect()] == [2]


def test_commit_goes_on_from_a_newer_version(spark, workdir):
    """Another commit comes first: untouched buckets keep what was written, touched ones are merged again."""
    from changeflow.schemas import EntitySpec, Leaf
    spec = EntitySpec("item", ("policy_id",), (Leaf("amount", (), "int"),))
    own, other = (TableSet(spark, f"{workdir}/t", [spec], buckets=4) for _ in range(2))

    def add(ts, rows, **kw):
        df = spark.createDataFrame(rows, "policy_id long, amount int")
        merged = []

        def merge(cur):
            merged.append(1)
            return cur.join(df.select("policy_id"), "policy_id", "left_anti").unionByName(df)

        m = ts.commit({"item": (df, merge)}, **kw)
        return m, len(merged)

    add(own, [(k, 0) for k in range(20)])
    publish = own._publish
    near, far = 1, next(k for k in range(2, 20) if own.touched_buckets(spark.createDataFrame([(k,)], "policy_id long"))
                        != own.touched_buckets(spark.createDataFrame([(1,)], "policy_id long")))
    for other_key, merges in ((far, 1), (near, 2)):
        def overtaken(m, key=other_key):
            own._publish = publish
            add(other, [(key, 5)], progress={"other": key})
            return publish(m)

        own._publish = overtaken
        m, n = add(own, [(near, 7), (100 + other_key, 7)] if other_key == near else [(near, 7)], progress={"own": other_key})
        assert n == merges and m["progress"] == {"own": other_key, "other": other_key}
        got = {r.policy_id: r.amount for r in own.read("item").collect()}
        assert got[near] == 7 and got[far] == 5
    own._publish = lambda m: False
    m, _ = add(own, [(near, 9)], applied=lambda m: m["progress"].get("own") == near)
    assert m["version"] == own.versions()[-1]
    try:
        add(own, [(near, 9)], tries=2)
    except RuntimeError:
        pass
    else:
        raise AssertionError("a commit that can't publish must fail")
