"""Fixtures derived by Spark from the driver tables, so their work grows with them.

**Change log L** (from ``events``): one change per event. ``policy_id`` =
``user_id`` (the key), ``seq`` = ``event_id`` (arrival order), op by event type
(signup -> c, view -> r, error -> d, click / purchase -> u), ``ts_ms`` = epoch
ms of ``ts`` (truncated), ``arrival_time`` = that instant, and ``event_time`` =
arrival time minus ``event_id % 7`` hours, so event time disagrees with arrival
order (late and out-of-order events). ``data`` = ``props``.

**Documents D** (from ``customer -> orders -> lineitem``): one policy-shaped
JSON document per customer. Orders (sorted by key) become coverages,
vehicles and claims; the line items of an order (sorted on all columns)
become the drivers of that vehicle. Flattening D must give back the base rows
that rank within the caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions.time import epoch_millis, event_time_from_ms

OP_BY_EVENT_TYPE = {"signup": "c", "view": "r", "error": "d", "click": "u", "purchase": "u"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op(col: str = "event_type"):
    e = None
    for k, v in OP_BY_EVENT_TYPE.items():
        e = F.when(F.col(col) == k, F.lit(v)) if e is None else e.when(F.col(col) == k, F.lit(v))
    return e


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture L as staging-like rows."""
    ev = table(spark, sf_dir, "events")
    ms = epoch_millis("ts")
    arrival = event_time_from_ms(ms)
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("policy_id"),
        "event_type",
        _op().alias("op"),
        ms.alias("ts_ms"),
        arrival.alias("arrival_time"),
        (arrival - F.make_dt_interval(F.lit(0), (F.col("event_id") % 7).cast("int"))).alias("event_time"),
        F.col("props").alias("data"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        "value",
        F.lit(0).alias("pos"),
        F.lit(0).alias("pos2"),
    )


def change_envelopes(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """Fixture L as JSON envelope messages ``(value, seq)``.

    ``u`` events carry a before-image with an older document and a
    ``created_at`` only in the before-image; ``d`` events carry only a
    before-image. ``corrupt=True`` damages some messages: ``seq % 10 = 0`` cut
    in half, ``= 5`` null (tombstone), ``= 9`` an envelope holding only an op.
    """
    log = change_log(spark, sf_dir)
    img_t = "struct<id:bigint,data:string,created_at:string,updated_at:string>"
    before = F.when(F.col("op").isin("u", "d"), F.struct(
        F.col("policy_id").alias("id"),
        F.when(F.col("op") == "u", F.lit('{"k": -1}')).otherwise(F.col("data")).alias("data"),
        F.concat(F.lit("t"), F.col("seq").cast("string")).alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"))).otherwise(F.lit(None).cast(img_t))
    after = F.when(F.col("op") != "d", F.struct(
        F.col("policy_id").alias("id"), F.col("data"),
        F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"))).otherwise(F.lit(None).cast(img_t))
    value = F.to_json(F.struct(before.alias("before"), after.alias("after"), "op", "ts_ms"))
    if corrupt:
        m = F.col("seq") % 10
        value = (F.when(m == 0, F.substring(value, 1, 20))
                 .when(m == 5, F.lit(None).cast("string"))
                 .when(m == 9, F.to_json(F.struct("op")))
                 .otherwise(value))
    return log.select(value.alias("value"), "seq")


def _lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    drv = F.struct(
        F.concat(F.lit("D"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("license_number"),
        (F.col("l_linenumber") == 1).alias("is_primary"))
    # sort on every column: (l_orderkey, l_linenumber) is not unique
    s = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", drv.alias("d"))
    # collect_list gains nothing from a map-side partial aggregate (its buffer keeps every
    # element), so hash-partition on the key first: one shuffle, collection after it in parallel
    return (li.repartition("l_orderkey").groupBy("l_orderkey")
              .agg(F.sort_array(F.collect_list(s)).alias("_ls"))
              .select("l_orderkey", F.transform("_ls", lambda x: x["d"]).alias("drivers")))


def customer_documents(spark: SparkSession, sf_dir: str, orders_filter=None) -> DataFrame:
    """Fixture D: ``(id, data, ts_ms, seq, event_time)``, one row per customer.

    ``orders_filter`` (a Column on ``orders``) keeps only some orders in the
    documents: used to build a second, shrunk version of each document.
    """
    o = table(spark, sf_dir, "orders")
    if orders_filter is not None:
        o = o.filter(orders_filter)
    return _documents(spark, sf_dir, o, {"data": None})


def document_versions(spark: SparkSession, sf_dir: str, orders_filter) -> DataFrame:
    """``(id, data, shrunk, segment, ts_ms, seq, event_time)``: each customer's document with all
    orders and with those of ``orders_filter`` only, out of one pass over the tables."""
    o = table(spark, sf_dir, "orders").withColumn("_keep", orders_filter)
    return _documents(spark, sf_dir, o, {"data": None, "shrunk": "_keep"}, F.col("c_mktsegment").alias("segment"))


def _documents(spark: SparkSession, sf_dir: str, o: DataFrame, versions: dict, *more) -> DataFrame:
    """A document column per version; its value names a boolean column of the orders to keep."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    flags = [f for f in versions.values() if f]
    okey = F.col("o_orderkey").cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")  # zone-free ISO day
    ostruct = F.struct(
        F.col("o_orderkey").alias("k"),
        F.struct(okey.alias("type"), F.col("o_totalprice").alias("limit"),
                 F.col("c_acctbal").alias("deductible"), F.col("o_totalprice").alias("premium")).alias("cov"),
        F.struct(F.concat(F.lit("V"), okey).alias("vin"), F.year("o_orderdate").alias("year"),
                 F.col("o_orderstatus").alias("make"), F.col("o_orderpriority").alias("model"),
                 F.col("drivers")).alias("veh"),
        F.struct(F.concat(F.lit("C"), okey).alias("claim_id"), day.alias("date"),
                 F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"),
                 F.col("o_orderpriority").alias("description")).alias("clm"),
        *flags)
    cust = c.select("c_custkey", "c_acctbal")
    per_order = (o.join(_lines(spark, sf_dir), o["o_orderkey"] == F.col("l_orderkey"), "left")
                  .join(cust, o["o_custkey"] == cust["c_custkey"], "inner")
                  .select("o_custkey", "o_orderdate", *flags, ostruct.alias("s")))
    days = []
    for name, flag in versions.items():
        at = F.when(F.col(flag), F.col("o_orderdate")) if flag else F.col("o_orderdate")
        days += [F.min(at).alias(f"{name}_first_day"), F.max(at).alias(f"{name}_last_day")]
    per_cust = (per_order.repartition("o_custkey").groupBy("o_custkey")
                .agg(F.sort_array(F.collect_list("s")).alias("os"), *days))
    base = (c.join(n, c["c_nationkey"] == n["n_nationkey"])
             .join(r, n["n_regionkey"] == r["r_regionkey"])
             .join(per_cust, c["c_custkey"] == per_cust["o_custkey"], "left"))
    key = F.col("c_custkey").cast("string")

    def document(name: str, flag: str | None):
        os = F.col("os")
        if flag:
            kept = F.filter("os", lambda x: x[flag])
            os = F.when(F.size(kept) > 0, kept)     # a customer without orders has no arrays
        return F.struct(
            F.col("c_name").alias("policy_number"),
            F.col("c_mktsegment").alias("status"),
            F.col(f"{name}_first_day").cast("date").cast("string").alias("effective_date"),
            F.col(f"{name}_last_day").cast("date").cast("string").alias("expiration_date"),
            F.struct(F.col("c_name").alias("first_name"), F.col("n_name").alias("last_name"),
                     F.struct(F.concat(key, F.lit("@example.com")).alias("email"),
                              F.col("c_nationkey").cast("string").alias("phone"),
                              F.struct(F.concat(key, F.lit(" Main St")).alias("street"),
                                       F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                                       F.lpad(key, F.greatest(F.lit(5), F.length(key)), "0").alias("zip")).alias("address")).alias("contact"),
                     ).alias("policyholder"),
            F.transform(os, lambda x: x["cov"]).alias("coverages"),
            F.transform(os, lambda x: x["veh"]).alias("vehicles"),
            F.transform(os, lambda x: x["clm"]).alias("claims_history"),
        )
    ts_ms = F.col("c_custkey") * F.lit(1000)
    return base.select(F.col("c_custkey").alias("id"), *[F.to_json(document(v, f)).alias(v) for v, f in versions.items()], *more,
                       ts_ms.alias("ts_ms"), F.col("c_custkey").alias("seq"),
                       event_time_from_ms(ts_ms).alias("event_time"))
