"""Invariants on random change logs (arrival order = event-time order).

* batch merge replayed in any batching == full rebuild == full-rescan model
* direct upsert of a no-delete log == rebuild of its staging
* one row per key in every output
* explode flatten == index-union flatten
"""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from changeflow.operators.flatten import flatten, flatten_union, parse_document
from changeflow.operators.merge import merge_batch, merge_upsert, rebuild, run_model
from changeflow.operators.resolve import ARRIVAL_ORDER
from changeflow.plans.pipelines import decode, direct_rows, empty_output, stage
from changeflow.schemas import COVERAGE, POLICY
from tests.helpers import cov, doc, ev, msgs

TYPES = ["liability", "collision", "comprehensive", "glass", "rental", "towing", "medical"]


def random_log(seed: int, n_events: int = 30, n_keys: int = 6, deletes: bool = True):
    rnd = random.Random(seed)
    state, log = {}, []
    for i in range(n_events):
        pid = rnd.randint(1, n_keys)
        d = doc(status=rnd.choice(["active", "expired"]),
                coverages=[cov(t, round(rnd.uniform(1, 99), 2)) for t in rnd.sample(TYPES, rnd.randint(0, 6))])
        ts = 1_000_000 + i * 1000
        if pid not in state:
            log.append(ev("c", ts, pid, i + 1, after=d))
            state[pid] = d
        elif deletes and rnd.random() < 0.2:
            log.append(ev("d", ts, pid, i + 1, before=state.pop(pid)))
        else:
            log.append(ev("u", ts, pid, i + 1, before=state[pid], after=d))
            state[pid] = d
    return log


def as_set(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@settings(max_examples=3, deadline=None, derandomize=True)
@given(seed=st.integers(0, 10_000), cuts=st.lists(st.integers(1, 29), max_size=3))
def test_batch_merge_any_batching_equals_rebuild_and_model(spark, seed, cuts):
    log = random_log(seed)
    bounds = sorted(set([0, *cuts, len(log)]))
    full = stage(decode(msgs(spark, log)), [POLICY, COVERAGE])
    for spec in (POLICY, COVERAGE):
        expected = as_set(rebuild(full[spec.name], spec.keys, spec.columns), spec.columns)
        model = run_model(empty_output(spark, spec), full[spec.name], spec.keys, spec.columns)
        assert as_set(model, spec.columns) == expected
        out = empty_output(spark, spec)
        for a, b in zip(bounds, bounds[1:]):
            part = stage(decode(msgs(spark, log[a:b])), [spec])[spec.name]
            out = merge_batch(out, part, spec.keys, spec.columns)
        got = as_set(out, spec.columns)
        assert got == expected
        assert len({r[:len(spec.keys)] for r in got}) == len(got)      # one row per key


@settings(max_examples=2, deadline=None, derandomize=True)
@given(seed=st.integers(0, 10_000))
def test_direct_upsert_of_no_delete_log_equals_rebuild(spark, seed):
    log = random_log(seed, deletes=False)
    env = decode(msgs(spark, log))
    direct = direct_rows(env, [COVERAGE])["coverage"]
    up = merge_upsert(empty_output(spark, COVERAGE), direct, COVERAGE.keys, ARRIVAL_ORDER)
    staged = stage(env, [COVERAGE])["coverage"]
    assert as_set(up, COVERAGE.columns) == as_set(rebuild(staged, COVERAGE.keys, COVERAGE.columns),
                                                  COVERAGE.columns)


@settings(max_examples=2, deadline=None, derandomize=True)
@given(seed=st.integers(0, 10_000))
def test_explode_equals_index_union(spark, seed):
    env = decode(msgs(spark, random_log(seed)))
    img = parse_document(env.selectExpr("coalesce(after.id, before.id) AS id",
                                        "coalesce(after.data, before.data) AS data", "op", "event_time", "seq"),
                         COVERAGE)
    cols = COVERAGE.columns + ["pos"]
    assert as_set(flatten(img, COVERAGE, caps="compat"), cols) == as_set(flatten_union(img, COVERAGE, caps="compat"), cols)
