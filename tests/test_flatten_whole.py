"""The index form keeps every element of every level without caps."""

from pyspark.sql import functions as F

from changeflow.operators.flatten import flatten, flatten_union
from changeflow.plans.registry import QUERIES
from changeflow.schemas import COVERAGE, DRIVER
from tests.conftest import SF_SMALL


def test_index_form_keeps_all_elements(spark):
    data = ['{"coverages": [%s], "vehicles": [%s]}' % (
        ", ".join('{"type": "t%d"}' % i for i in range(n)),
        ", ".join('{"vin": "v%d", "drivers": [%s]}' % (i, ", ".join(
            '{"license_number": "l%d-%d"}' % (i, j) for j in range(i))) for i in range(n))) for n in (0, 1, 9)]
    data += ["{}", '{"coverages": null}', '{"coverages": [null, {"type": "x"}]}']
    df = spark.createDataFrame(list(enumerate(data)), "id long, data string").withColumn(
        "event_time", F.timestamp_seconds(F.lit(0)))
    for spec, n in ((COVERAGE, 11), (DRIVER, 36)):
        a, b = flatten_union(df, spec, caps=None), flatten(df, spec)
        assert a.count() == n
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    capped = flatten_union(df, DRIVER, caps=(None, 2), skip=((8, 1),))
    want = flatten(df, DRIVER, caps=(None, 2), skip=((8, 1),))
    assert sorted(map(str, capped.collect())) == sorted(map(str, want.select(*capped.columns).collect()))


def test_uncapped_query_covers_the_round_trip(spark):
    a = QUERIES["flatten_union_uncapped"](spark, SF_SMALL)
    b = QUERIES["flatten_array_round_trip"](spark, SF_SMALL)
    assert a.count() == b.count() == QUERIES["flatten_union_equiv"](spark, SF_SMALL).count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
