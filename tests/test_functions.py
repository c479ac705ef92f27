from decimal import Decimal

from pyspark.sql import functions as F

from changeflow.functions import cast_leaf, epoch_millis, event_time_from_ms, json_patch, json_value, json_values, summary_json
from changeflow.schemas import DRIVER, document_schema


def test_json_value_scalar_only(spark):
    df = spark.createDataFrame([('{"a":"x","o":{"b":1},"arr":[1,2],"s":"{\\"q\\":1}","n":null,"d":1200.00}',)], "j string")
    r = df.select(*[json_value("j", p).alias(a) for a, p in
                    [("a", "$.a"), ("o", "$.o"), ("arr", "$.arr"), ("s", "$.s"), ("n", "$.n"), ("m", "$.missing"),
                     ("ob", "$.o.b"), ("ai", "$.arr[1]")]],
                  json_value("j", "$.d", "decimal(12,2)").alias("d")).collect()[0]
    assert (r.a, r.o, r.arr, r.s, r.n, r.m, r.ob, r.ai) == ("x", None, None, '{"q":1}', None, None, "1", "2")
    assert r.d == Decimal("1200.00")


def test_json_patch_is_shallow_and_right_wins(spark):
    df = spark.createDataFrame([('{"a":1,"c":{"z":2},"k":5}', '{"c":[3],"d":"e"}')], "x string, y string")
    out = df.select(json_patch("x", "y").alias("p")).collect()[0].p
    import json
    assert json.loads(out) == {"a": 1, "c": [3], "d": "e", "k": 5}


def test_casts_modes(spark):
    df = spark.createDataFrame([("2",), ("x",), ("1.0E7",)], "t string")
    got = [r[0] for r in df.select(cast_leaf(F.col("t"), "int")).collect()]
    assert got == [2, None, None]
    dec = [r[0] for r in df.select(cast_leaf(F.col("t"), "decimal(12,2)")).collect()]
    assert dec == [Decimal("2.00"), None, Decimal("10000000.00")]


def test_epoch_round_trip(spark):
    df = spark.createDataFrame([(1_700_000_000_123,)], "ms long")
    r = df.select(event_time_from_ms("ms").alias("t")).select(epoch_millis("t").alias("back"), "t").collect()[0]
    assert r.back == 1_700_000_000_123


def test_summary_json(spark):
    df = spark.createDataFrame([(3, 7)], "rows_merged int, watermark long")
    assert df.select(summary_json(F.col("rows_merged"), F.col("watermark"))).collect()[0][0] == \
        '{"rows_merged":3,"watermark":7}'


def test_document_schema_prunes_to_entity_paths():
    s = document_schema([DRIVER])
    assert [f.name for f in s.fields] == ["vehicles"]
    veh = s["vehicles"].dataType.elementType
    assert sorted(f.name for f in veh.fields) == ["drivers", "vin"]


def test_json_values_parse_once(spark):
    from tests.test_plans import plan
    docs = ['{"a": {"b": "x", "n": 1.50}, "l": [true, {"k": "7"}], "z": null}', '{"a": 3}', "not json", None, "", '{"a": {"b": {"c": 1}}}']
    df = spark.createDataFrame([(i, d, "mine") for i, d in enumerate(docs)], "id int, j string, _doc string")
    paths = {"b": "$.a.b", "n": ("$.a.n", "decimal(6,2)"), "first": ("$.l[0]", "boolean"), "k": ("$.l[1].k", "int"), "a": "$.a", "z": "$.z"}
    got = json_values(df, "j", paths)
    assert got.columns == ["id", "j", "_doc", *paths]
    want = df.select("id", "j", "_doc", *[json_value("j", *([p] if isinstance(p, str) else p)).alias(n) for n, p in paths.items()])
    assert sorted(got.collect()) == sorted(want.collect()) and {r["_doc"] for r in got.collect()} == {"mine"}
    assert plan(got).count("parseJson(") == 1
    assert json_values(df.limit(0), "j", paths).count() == 0
    assert json_values(df, "j", {"j": "$.a"}).filter("id = 1").first()["j"] == "3"
