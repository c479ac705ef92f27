"""Physical-plan properties the scale design relies on (checked on plans, not data)."""

from changeflow.operators.filters import incremental_filter
from changeflow.operators.merge import merge_batch
from changeflow.operators.resolve import dead_keys, history, latest_per_key
from changeflow.plans.pipelines import decode, empty_output, stage
from changeflow.schemas import COVERAGE, POLICY
from changeflow.sinks import StagingStore
from changeflow.sources.seeds import messages_frame, scenario_messages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _staging(spark, workdir):
    store = StagingStore(spark, f"{workdir}/stg")
    for b, batch in enumerate(scenario_messages()):
        rows = stage(decode(messages_frame(spark, batch)))
        for n in ("policy", "coverage"):
            store.append(n, rows[n], b)
    return store


def test_flatten_does_not_shuffle(spark):
    rows = stage(decode(messages_frame(spark, scenario_messages()[0])))
    for n in ("coverage", "driver"):
        p = plan(rows[n])
        assert "Exchange" not in p and "Generate" in p


def test_latest_per_key_limits_before_the_shuffle(spark, workdir):
    stg = _staging(spark, workdir).read("coverage")
    p = plan(latest_per_key(stg, COVERAGE.keys))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p
    assert p.index("Final") < p.index("Exchange") < p.rindex("Partial")   # partial below the exchange
    assert "partial_max_by" in plan(latest_per_key(stg, COVERAGE.keys, method="max_by"))


def test_dead_keys_and_touched_keys_aggregate_map_side(spark, workdir):
    stg = _staging(spark, workdir).read("coverage")
    assert "partial_max_by" in plan(dead_keys(stg, COVERAGE.keys))
    p = plan(merge_batch(empty_output(spark, COVERAGE), stg, COVERAGE.keys, COVERAGE.columns))
    assert "LeftAnti" in p and "HashAggregate" in p


def test_staging_slice_prunes_partitions(spark, workdir):
    store = _staging(spark, workdir)
    p = plan(store.read("policy", lo=1, hi=2))
    assert "PartitionFilters: [isnotnull(batch_id" in p and "batch_id" in p.split("PartitionFilters")[1][:200]


def test_incremental_bound_is_pushed_to_the_scan(spark, workdir):
    store = _staging(spark, workdir)
    stg = store.read("policy")
    target = stg.select(*POLICY.columns)
    p = plan(incremental_filter(stg, target))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(event_time" in pushed


def test_history_is_dealt_by_slices(spark, workdir):
    stg = _staging(spark, workdir).read("coverage")
    p = plan(history(stg, COVERAGE.keys)).lower()
    assert "hashpartitioning(_slice" in p and "rangepartitioning" not in p


def test_direct_job_parses_a_document_once(spark, workdir, monkeypatch):
    """All jobs of a direct batch but the one that fills the cache read parsed images."""
    from changeflow.sinks import TableSet
    from changeflow.streaming.jobs import direct_batch
    tables, plans = TableSet(spark, f"{workdir}/t", buckets=2), []
    commit = tables.commit

    def spy(updates, **kw):
        for name, (rows, merge) in updates.items():
            plans.extend([plan(rows), plan(merge(tables.read_buckets(name, [0, 1], tables.manifest())))])
        return commit(updates, **kw)

    monkeypatch.setattr(tables, "commit", spy)
    direct_batch(tables)(messages_frame(spark, scenario_messages()[0]), 0)
    assert len(plans) == 10
    for p in plans:
        # what is above the cached relation; below it is the one plan that parses
        assert "InMemoryTableScan" in p
        above = p.split("InMemoryRelation")[0]
        assert "from_json" not in above and "try_parse_json" not in above and "parse_json" not in above
