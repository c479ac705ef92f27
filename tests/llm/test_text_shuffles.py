"""How often whole texts are shuffled, and that the rows are still those of the operators."""

import os
from random import Random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeflow.llm import common, near_dup


def text_shuffles(spark, made):
    """What ``made()`` returns, and how many exchanges moved, or would, whole texts for it."""
    def count(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return count(plan.initialPlan())
        names = [plan.output().apply(k).name() for k in range(plan.output().size())] if plan.nodeName() == "Exchange" else []
        return ("text" in names) + sum(count(plan.children().apply(k)) for k in range(plan.children().size()))

    moved = []
    written, bucketed = common._written, common.Scratch.bucketed
    of = lambda df: count(df._jdf.queryExecution().executedPlan())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common, "_written", lambda df, path: (moved.append(of(df)), written(df, path))[1])
        patch.setattr(common.Scratch, "bucketed", lambda self, df, *rest: (moved.append(of(df)), bucketed(self, df, *rest))[1])
        least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for tables too large for it
        try:
            out = made()
            return out, sum(moved) + of(out)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_pipeline_stages_shuffle_texts_once(spark):
    r = Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(30)]
    passage = " ".join(r.choice(words) for _ in range(40))
    texts = [t + (" " + passage) * (k % 3 == 0) for k, t in enumerate(texts)] + texts[:5] + [texts[7] + " more"] + [None, "", "short"]
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    rows += [rows[2], (4, texts[9], "de", None, 0), (None, texts[1], "en", "a", 0), (None, "x" * 300, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    held = common.Scratch(spark, "test-held")
    out, moved = text_shuffles(spark, lambda: corpus_pipeline.near_duplicate_stage(spark, docs, "", held))
    assert moved == 1
    verdicts = {}
    for v in near_dup.near_duplicates(docs).collect():
        verdicts[v.doc_id] = verdicts.get(v.doc_id, True) and v.kept
    assert not all(verdicts.values())
    kept = common.saved(out, "test-kept")
    held.drop()
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, kept.collect())) == order(x for x in rows if verdicts[x[0]])

    held = common.Scratch(spark, "test-held")
    out, moved = text_shuffles(spark, lambda: corpus_pipeline.passage_stage(spark, docs, "", held))
    assert moved == 0           # but for the aggregate that deals them to their buckets, which names them otherwise
    passages = common.saved(out, "test-passages").collect()
    held.drop()
    named = {k: t for k, t, *_ in rows if k is not None and k not in (2, 4)}
    got = {x.doc_id: x.text for x in passages}
    assert got[1] == named[1] and got[len(texts) - 1] == "short"
    assert len(texts) - 3 not in got and passage in got[0] and passage not in got[3]


def test_saved_tables_leave_no_shuffle_files(spark, workdir):
    sc = spark.sparkContext._jsc.sc()
    folders = sc.env().blockManager().diskBlockManager().localDirsString()

    def files():
        return {n for d in folders for at, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}

    before, option = files(), spark.conf.get(common.SHUFFLE_CLEANUP)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("x")).repartition(3, "x")
    work = common.Scratch(spark, "test-shuffles")
    tables = work.saved(sums, "t"), work.bucketed(sums, "t", ["k"])
    assert files() <= before and spark.conf.get(common.SHUFFLE_CLEANUP) == option
    assert [t.count() for t in (*tables, sums)] == [7, 7, 7]
    work.drop()
