"""What is written leaves no shuffle files, no second copies and no finished phases; buckets are merged some at a time."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from changeflow.functions.json import variant_text
from changeflow.plans import pipelines
from changeflow.plans.pipelines import decode, merge_summary, stage
from changeflow.plans.registry import q_atomic_publish, q_lost_checkpoint, q_stream_equals_batch
from changeflow.session import SHUFFLE_CLEANUP, checkpoint_dir, shuffles_deleted
from changeflow.sinks import StagingStore, TableSet
from changeflow.streaming.jobs import merge_once, staging_batch
from tests.helpers import cov, doc, ev, msgs
from tests.test_large_documents import small_tables


def events(n, op="c", seq=0, **more):
    image = {("before" if op == "d" else "after"): doc(coverages=[cov("a", 1.5), cov("b")], **more)}
    return [ev(op, 1000 + seq + i, i, seq + i, **image) for i in range(n)]



def merged(spark, root, **options):
    store, tables = StagingStore(spark, f"{root}/stg"), TableSet(spark, f"{root}/out", buckets=4, **options)
    out = []
    for b, batch in enumerate((events(40), events(20, "u", 100, status="x") + events(9, "d", 200))):
        staging_batch(store)(msgs(spark, batch), b)
        out.append(merge_once(store, tables))
    return store, tables, out


def test_buckets_merged_some_at_a_time_give_the_same_tables_and_metrics(spark, workdir, monkeypatch):
    seen, waves = [], TableSet._waves
    monkeypatch.setattr(TableSet, "_waves", lambda *a: seen.append(waves(*a)) or seen[-1])
    _, whole, m = merged(spark, f"{workdir}/a", write_bytes=1 << 40)
    assert {len(w) for w in seen} == {1}
    store, parts, n = merged(spark, f"{workdir}/b", write_bytes=1)
    assert max(map(len, seen)) == 4
    for name in whole.specs:
        assert sorted(map(str, parts.read(name).collect())) == sorted(map(str, whole.read(name).collect()))
    slices = {s: store.read(s, 0, 1) for s in store.specs}
    want = {r["entity"]: (r["rows_merged"], r["keys_touched"], r["watermark"]) for r in merge_summary(slices, {}).collect()}
    for found in (m[1], n[1]):
        assert {e: (x["rows_merged"], x["keys_touched"], x["max_seq"]) for e, x in found["metrics"].items() if isinstance(x, dict)} == want
    assert want["policy"] == (11, 20, 208) and want["driver"] == (0, 0, 0)


def test_a_staging_batch_writes_each_row_once(spark, workdir, monkeypatch):
    written, paths = pipelines._written, []
    monkeypatch.setattr(pipelines, "_written", lambda df, path, *a: paths.append(os.path.basename(path)) or written(df, path, *a))
    store = StagingStore(spark, f"{workdir}/stg")
    batch = [*events(3), ev("c", 9, 8, 8, after=doc(coverages=[{"limit": 4}, cov("z")], vehicles=[{"year": 1}])), ("not json", 9)]
    staging_batch(store, on_error="quarantine")(msgs(spark, batch), 0)
    assert paths == ["images"]
    want = stage(decode(msgs(spark, batch)))
    for name in store.specs:
        clean = want[name].filter(" and ".join(f"{k} is not null" for k in store.specs[name].keys))
        assert store.read(name).drop("batch_id").exceptAll(clean).count() == 0 and store.read(name).count() == clean.count()
    assert {r.reason.split(":")[0] for r in spark.read.parquet(f"{workdir}/stg/rejects").collect()} >= {"unparsable_or_no_op"}


@pytest.mark.parametrize("query, left", [(q_atomic_publish, {"out"}), (q_lost_checkpoint, {"out", "stg", "log", "ck0", "ck1"}),
                                         (q_stream_equals_batch, {"out", "stg", "ck_stg", "ck_merge"})])
def test_a_phase_is_deleted_once_it_is_read(spark, workdir, query, left):
    before = set(glob.glob(f"{checkpoint_dir(spark)}/changeflow-queries/*"))
    assert query(spark, small_tables(spark, f"{workdir}/in")).count()
    root, = set(glob.glob(f"{checkpoint_dir(spark)}/changeflow-queries/*")) - before
    assert {p for p in os.listdir(root) if any(f.endswith(".parquet") or p.startswith("ck") for _, _, fs in os.walk(f"{root}/{p}") for f in fs)} == left


def test_writers_side_by_side_restore_the_setting(spark, workdir):
    before = spark.conf.get(SHUFFLE_CLEANUP)

    def write(n):
        with shuffles_deleted(spark):
            spark.range(100).repartition(3).write.parquet(f"{workdir}/{n}")
            return spark.conf.get(SHUFFLE_CLEANUP)

    with ThreadPoolExecutor(4) as pool:
        assert set(pool.map(write, range(8))) == {"true"}
    assert spark.conf.get(SHUFFLE_CLEANUP) == before


def test_text_of_variants(spark):
    rows = [('"x"', "x"), ('"{x"', "{x"), ('"["', "["), ('"{}"', "{}"), ("{}", None), ('{"a": 1}', None), ("[1]", None), ("[]", None), ("null", None),
            ("1.50", "1.5"), ("true", "true"), ('""', ""), (None, None), ('"OBJECT<a"', "OBJECT<a")]
    table = spark.createDataFrame(rows, "j string, want string")
    got = table.select("j", "want", variant_text(F.parse_json("j")).alias("text")).collect()
    assert [(r.j, r.text) for r in got] == [(r.j, r.want) for r in got]
