"""DuckDB SQL for every registered query (the correctness oracle).

Written against the raw driver tables; the fixtures are rebuilt in SQL:
``L`` (change log) and ``C`` / ``O`` / ``LI`` (customers, ranked orders,
ranked line items) for documents. Column names equal the Spark output.
"""

L = """L AS (
  SELECT event_id AS seq, user_id AS policy_id, event_type,
         CASE event_type WHEN 'signup' THEN 'c' WHEN 'view' THEN 'r' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
         epoch_us(ts) // 1000 AS ts_ms,
         make_timestamp((epoch_us(ts) // 1000) * 1000) AS arrival_time,
         make_timestamp((epoch_us(ts) // 1000) * 1000) - to_hours(CAST(event_id % 7 AS INTEGER)) AS event_time,
         props AS data, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
  FROM events)"""

DOCS = """C AS (
  SELECT c.c_custkey, c.c_name, c.c_mktsegment, c.c_acctbal, c.c_nationkey, n.n_name, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
O AS (
  SELECT o.*, c.c_acctbal, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS r0
  FROM orders o JOIN C c ON c.c_custkey = o.o_custkey),
LI AS (
  SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS r1
  FROM lineitem l)"""

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"

POLICY_COLS = """c_custkey AS policy_id, c_name AS policy_number, c_mktsegment AS status,
  CAST(first_day AS DATE) AS effective_date, CAST(last_day AS DATE) AS expiration_date,
  c_name AS holder_first_name, n_name AS holder_last_name, CAST(NULL AS DATE) AS holder_dob,
  CAST(c_custkey AS VARCHAR) || '@example.com' AS holder_email, CAST(c_nationkey AS VARCHAR) AS holder_phone,
  CAST(c_custkey AS VARCHAR) || ' Main St' AS holder_street, n_name AS holder_city, r_name AS holder_state,
  lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS holder_zip, make_timestamp(c_custkey * 1000000) AS source_event_time"""

POLICY_FROM = """C LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day
  FROM orders GROUP BY o_custkey) d ON d.o_custkey = C.c_custkey"""

COVERAGE_COLS = """o_custkey AS policy_id, CAST(o_orderkey AS VARCHAR) AS coverage_type,
  CAST(o_totalprice AS DECIMAL(12,2)) AS coverage_limit, CAST(c_acctbal AS DECIMAL(12,2)) AS deductible,
  CAST(o_totalprice AS DECIMAL(12,2)) AS premium"""

VEHICLE_COLS = """o_custkey AS policy_id, 'V' || CAST(o_orderkey AS VARCHAR) AS vin,
  CAST(year(o_orderdate) AS INTEGER) AS year_made, o_orderstatus AS make, o_orderpriority AS model"""

DRIVER_COLS = """o_custkey AS policy_id, 'V' || CAST(o_orderkey AS VARCHAR) AS vehicle_vin,
  'D' || CAST(l_partkey AS VARCHAR) AS driver_name,
  CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS license_number,
  l_linenumber = 1 AS is_primary"""

CLAIM_COLS = """o_custkey AS policy_id, 'C' || CAST(o_orderkey AS VARCHAR) AS claim_id,
  CAST(o_orderdate AS DATE) AS claim_date, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
  o_orderstatus AS status, o_orderpriority AS description"""

# latest per key by event time then arrival, non-deleted, over a relation R
LCOLS = "policy_id, event_type, op, event_time, seq, k, value"


def _latest(rel: str, keys: str = "policy_id", cols: str = LCOLS, keep_deletes: bool = False) -> str:
    cond = "" if keep_deletes else " AND op <> 'd'"
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY event_time DESC, seq DESC) AS rn FROM {rel}) WHERE rn = 1{cond}")


def _dead(rel: str) -> str:
    return (f"SELECT s.policy_id FROM {rel} s JOIN (SELECT policy_id, max(seq) AS m FROM {rel} GROUP BY policy_id) mx "
            f"ON s.policy_id = mx.policy_id AND s.seq = mx.m WHERE s.op = 'd'")


MCOLS = "policy_id, event_type, source_event_time, seq, k, value"

ORACLE: dict[str, str] = {
    # ---- events: parsing, op filters, images -------------------------------------------------
    "op_filter_after": f"WITH {L} SELECT seq, policy_id AS id, op, data FROM L WHERE op IN ('c', 'r', 'u')",
    "op_filter_all_coalesce": f"""WITH {L} SELECT seq, policy_id AS id, op, data,
        CASE WHEN op IN ('u', 'd') THEN 't' || CAST(seq AS VARCHAR) END AS created_at FROM L""",
    "lenient_parse": f"""WITH {L} SELECT seq, op, CASE WHEN seq % 10 = 9 THEN NULL ELSE policy_id END AS id,
        CASE WHEN seq % 10 = 9 THEN NULL ELSE ts_ms END AS ts_ms FROM L WHERE seq % 10 NOT IN (0, 5)""",
    "envelope_rejects": f"""WITH {L} SELECT seq, 'unparsable_or_no_op' AS reason FROM L WHERE seq % 10 = 0
        UNION ALL SELECT seq, 'no_image' AS reason FROM L WHERE seq % 10 = 9""",
    "epoch_millis": f"WITH {L} SELECT seq, ts_ms, arrival_time FROM L",
    "json_value_scalar": "SELECT event_id AS seq, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "json_value_paths": f"""WITH {DOCS}
        SELECT C.c_custkey AS id, C.c_name AS policy_number, C.n_name AS city,
               CAST(o.o_orderkey AS VARCHAR) AS first_coverage, CAST(o.o_totalprice AS DECIMAL(12,2)) AS first_limit,
               CAST(li.l_partkey AS VARCHAR) || '-' || CAST(li.l_suppkey AS VARCHAR) || '-' || CAST(li.l_linenumber AS VARCHAR) AS first_license,
               CAST(NULL AS VARCHAR) AS holder_object, C.c_mktsegment AS status_text
        FROM C LEFT JOIN O o ON o.o_custkey = C.c_custkey AND o.r0 = 1
               LEFT JOIN LI li ON li.l_orderkey = o.o_orderkey AND li.r1 = 1""",
    "json_cast_types": """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS d,
        CAST(l_extendedprice AS DECIMAL(12,2)) AS p, l_linestatus = 'F' AS b, l_linenumber AS i,
        CAST(l_shipdate AS TIMESTAMP) AS t FROM lineitem""",
    "json_patch": """SELECT event_id AS seq, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k,
        CAST(value AS DECIMAL(12,2)) AS v FROM events""",
    # ---- flatten --------------------------------------------------------------------------------
    "flatten_root": f"WITH {DOCS} SELECT {POLICY_COLS} FROM {POLICY_FROM}",
    "flatten_array_round_trip": f"WITH {DOCS} SELECT {COVERAGE_COLS} FROM O",
    "flatten_union_equiv": f"WITH {DOCS} SELECT {COVERAGE_COLS} FROM O",
    "flatten_union_uncapped": f"WITH {DOCS} SELECT {COVERAGE_COLS} FROM O",
    "flatten_vehicles": f"WITH {DOCS} SELECT {VEHICLE_COLS} FROM O",
    "flatten_claims": f"WITH {DOCS} SELECT {CLAIM_COLS} FROM O",
    "flatten_nested": f"""WITH {DOCS} SELECT {DRIVER_COLS} FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey
       """,
    "flatten_nested_masked": f"""WITH {DOCS} SELECT {DRIVER_COLS} FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey
        WHERE NOT (r0 = 3 AND r1 = 3)""",
    "flatten_uncapped": f"""WITH {DOCS} SELECT {DRIVER_COLS} FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey""",
    "vanished_children": f"""WITH {DOCS},
        B AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS coverage_type FROM O),
        A AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS coverage_type FROM (
              SELECT o.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS ra
              FROM orders o WHERE o.o_orderstatus <> 'F'))
        SELECT B.o_custkey AS policy_id, B.coverage_type, 'd' AS op FROM B
        WHERE NOT EXISTS (SELECT 1 FROM A WHERE A.o_custkey = B.o_custkey AND A.coverage_type = B.coverage_type)""",
    # ---- resolve --------------------------------------------------------------------------------
    "latest_window": f"WITH {L} {_latest('L', keep_deletes=True)}",
    "latest_max_by": f"WITH {L} {_latest('L', keep_deletes=True)}",
    "current_state": f"WITH {L} {_latest('L')}",
    "history": f"""WITH {L} SELECT policy_id, seq, event_time,
        row_number() OVER (PARTITION BY policy_id ORDER BY event_time, seq) AS version,
        lead(event_time) OVER (PARTITION BY policy_id ORDER BY event_time, seq) AS valid_to FROM L""",
    "history_window": f"""WITH {L} SELECT policy_id, seq, event_time,
        row_number() OVER (PARTITION BY policy_id ORDER BY event_time, seq) AS version,
        lead(event_time) OVER (PARTITION BY policy_id ORDER BY event_time, seq) AS valid_to FROM L""",
    "distinct_ops": f"WITH {L} SELECT DISTINCT op FROM L",
    "count_by_op": f"WITH {L} SELECT op, count(*) AS n_rows FROM L GROUP BY op",
    # ---- merges ---------------------------------------------------------------------------------
    "upsert_no_delete": f"""WITH {L} SELECT {LCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY policy_id
        ORDER BY seq DESC) AS rn FROM L WHERE op <> 'd') WHERE rn = 1""",
    "delete_insert": f"""WITH {L},
        t1 AS ({_latest(f"(SELECT * FROM L WHERE arrival_time < {SPLIT})")}),
        n2 AS ({_latest(f"(SELECT * FROM L WHERE arrival_time >= {SPLIT})")})
        SELECT * FROM t1 WHERE policy_id NOT IN (SELECT policy_id FROM n2) UNION ALL SELECT * FROM n2""",
    "post_hook_delete": f"""WITH {L} SELECT * FROM ({_latest('L')}) WHERE policy_id NOT IN ({_dead('L')})""",
    "post_hook_delete_agg": f"""WITH {L} SELECT * FROM ({_latest('L')}) WHERE policy_id NOT IN ({_dead('L')})""",
    "post_hook_delete_correlated": f"""WITH {L} SELECT * FROM ({_latest('L')}) WHERE policy_id NOT IN (
        SELECT s.policy_id FROM L s WHERE s.op = 'd' AND s.seq = (SELECT max(s2.seq) FROM L s2 WHERE s2.policy_id = s.policy_id))""",
    "incremental_max_time": f"""WITH {L},
        S AS (SELECT *, event_time AS source_event_time FROM L),
        h1 AS (SELECT * FROM S WHERE arrival_time < {SPLIT}),
        t1 AS (SELECT * FROM ({_latest('h1', cols=MCOLS)}) WHERE policy_id NOT IN ({_dead('h1')})),
        n2 AS ({_latest(f"(SELECT * FROM S WHERE event_time >= (SELECT COALESCE(max(source_event_time), TIMESTAMP '1970-01-01') FROM t1))", cols=MCOLS)}),
        t2 AS (SELECT * FROM t1 WHERE policy_id NOT IN (SELECT policy_id FROM n2) UNION ALL SELECT * FROM n2)
        SELECT * FROM t2 WHERE policy_id NOT IN ({_dead('S')})""",
    "full_rescan_model": f"""WITH {L},
        S AS (SELECT *, event_time AS source_event_time FROM L),
        h1 AS (SELECT * FROM S WHERE arrival_time < {SPLIT}),
        t1 AS (SELECT * FROM ({_latest('h1', cols=MCOLS)}) WHERE policy_id NOT IN ({_dead('h1')})),
        n2 AS ({_latest('S', cols=MCOLS)}),
        t2 AS (SELECT * FROM t1 WHERE policy_id NOT IN (SELECT policy_id FROM n2) UNION ALL SELECT * FROM n2)
        SELECT * FROM t2 WHERE policy_id NOT IN ({_dead('S')})""",
    "batch_merge": f"""WITH {L},
        s1 AS (SELECT * FROM L WHERE arrival_time < {SPLIT}),
        s2 AS (SELECT * FROM L WHERE seq > (SELECT COALESCE(max(seq), 0) FROM s1)),
        t1 AS ({_latest('s1')})
        SELECT * FROM t1 WHERE policy_id NOT IN (SELECT policy_id FROM s2) UNION ALL {_latest('s2')}""",
    "batch_merge_tuple_key": f"""WITH {L},
        s1 AS (SELECT * FROM L WHERE arrival_time < {SPLIT}),
        s2 AS (SELECT * FROM L WHERE seq > (SELECT COALESCE(max(seq), 0) FROM s1)),
        t1 AS ({_latest('s1', keys='policy_id, event_type')})
        SELECT * FROM t1 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.policy_id = t1.policy_id AND s2.event_type = t1.event_type)
        UNION ALL {_latest('s2', keys='policy_id, event_type')}""",
    "batch_merge_triple_key": f"""WITH {L},
        s1 AS (SELECT * FROM L WHERE arrival_time < {SPLIT}),
        s2 AS (SELECT * FROM L WHERE seq > (SELECT COALESCE(max(seq), 0) FROM s1)),
        t1 AS ({_latest('s1', keys='policy_id, event_type, k')})
        SELECT * FROM t1 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.policy_id = t1.policy_id
              AND s2.event_type = t1.event_type AND s2.k = t1.k)
        UNION ALL {_latest('s2', keys='policy_id, event_type, k')}""",
    "batch_merge_exact": f"WITH {L} {_latest('L')}",
    "watermark_advance": f"""WITH {L},
        E AS (SELECT DISTINCT event_type FROM L),
        w1 AS (SELECT E.event_type, COALESCE(m, 0) AS wm1 FROM E LEFT JOIN (
               SELECT event_type, max(seq) AS m FROM L WHERE arrival_time < {SPLIT} GROUP BY event_type) x USING (event_type)),
        w2 AS (SELECT w1.event_type, wm1, COALESCE(m, wm1) AS wm2 FROM w1 LEFT JOIN (
               SELECT L.event_type, max(seq) AS m FROM L JOIN w1 USING (event_type) WHERE seq > wm1 GROUP BY L.event_type) x USING (event_type))
        SELECT w2.event_type AS entity, wm1, wm2, COALESCE(m, wm2) AS wm3 FROM w2 LEFT JOIN (
               SELECT L.event_type, max(seq) AS m FROM L JOIN w2 USING (event_type) WHERE seq > wm2 GROUP BY L.event_type) x USING (event_type)""",
    "merge_summary": f"""WITH {L},
        r AS (SELECT event_type, policy_id, op, seq, row_number() OVER (PARTITION BY event_type, policy_id
              ORDER BY event_time DESC, seq DESC) AS rn FROM L)
        SELECT event_type AS entity, count(*) FILTER (WHERE rn = 1 AND op <> 'd') AS rows_merged,
               count(*) FILTER (WHERE rn = 1) AS keys_touched, COALESCE(max(seq), 0) AS watermark
        FROM r GROUP BY event_type""",
    "merge_result_json": f"""WITH {L},
        r AS (SELECT event_type, op, seq, row_number() OVER (PARTITION BY event_type, policy_id
              ORDER BY event_time DESC, seq DESC) AS rn FROM L)
        SELECT event_type AS entity, '{{"rows_merged":' || count(*) FILTER (WHERE rn = 1 AND op <> 'd')
               || ',"watermark":' || COALESCE(max(seq), 0) || '}}' AS result FROM r GROUP BY event_type""",
    "peek_changes": f"WITH {L} SELECT seq, op, policy_id FROM L ORDER BY seq LIMIT 10",
    # ---- sources --------------------------------------------------------------------------------
    "snapshot_events": """SELECT c_custkey AS id, 'r' AS op, CAST(0 AS BIGINT) AS ts_ms, true AS no_before,
        c_name AS name FROM customer""",
    "snapshot_diff": """WITH old AS (SELECT c_custkey AS id, c_acctbal AS acct FROM customer WHERE c_custkey % 5 <> 0),
        new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS acct
                FROM customer WHERE c_custkey % 7 <> 0)
        SELECT COALESCE(o.id, n.id) AS id,
               CASE WHEN o.id IS NULL THEN 'c' WHEN n.id IS NULL THEN 'd' ELSE 'u' END AS op,
               CAST(o.acct AS DECIMAL(12,2)) AS before_acct, CAST(n.acct AS DECIMAL(12,2)) AS after_acct
        FROM old o FULL OUTER JOIN new n ON o.id = n.id
        WHERE o.id IS NULL OR n.id IS NULL OR o.acct <> n.acct""",
    # ---- streaming and publish ----
    "stream_equals_batch": f"""WITH {DOCS},
        F5 AS (SELECT o_custkey, o_orderkey, o_totalprice, c_acctbal FROM O),
        S5 AS (SELECT o_custkey, o_orderkey, o_totalprice, c_acctbal FROM (
               SELECT O.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rs
               FROM O WHERE o_orderstatus <> 'F')),
        B AS (SELECT c_custkey FROM C WHERE c_mktsegment = 'BUILDING'),
        K AS (SELECT * FROM F5 WHERE o_custkey NOT IN (SELECT c_custkey FROM B)
              UNION SELECT * FROM S5 WHERE o_custkey NOT IN (SELECT c_custkey FROM B)
              UNION SELECT * FROM F5 WHERE o_custkey IN (SELECT c_custkey FROM B)
                    AND NOT EXISTS (SELECT 1 FROM S5 WHERE S5.o_orderkey = F5.o_orderkey))
        SELECT {COVERAGE_COLS} FROM K""",
    "atomic_publish": f"""WITH {DOCS},
        E AS (SELECT 'policy' AS entity, c_custkey AS policy_id, NULL AS key1, NULL AS key2, 'O' AS st FROM C
              UNION ALL SELECT 'coverage', o_custkey, CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus FROM O
              UNION ALL SELECT 'vehicle', o_custkey, 'V' || CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus FROM O
              UNION ALL SELECT 'claim', o_custkey, 'C' || CAST(o_orderkey AS VARCHAR), NULL, o_orderstatus FROM O
              UNION ALL SELECT DISTINCT 'driver', o_custkey, 'V' || CAST(o_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) || '-'
                     || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), o_orderstatus
                     FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey)
        SELECT v.version, entity, policy_id, key1, key2 FROM E JOIN C ON C.c_custkey = policy_id,
               (VALUES (1), (2), (3)) v(version)
        WHERE v.version < 3 OR c_mktsegment <> 'BUILDING' OR st = 'F'""",
    "merge_on_read": f"""WITH {L}, N AS (SELECT max(seq) + 1 AS n FROM L),
        S AS (SELECT L.*, CASE WHEN 2 * seq < n THEN 0 ELSE 1 + (2 * seq - n) * 50 // n END AS s FROM L, N),
        T AS (SELECT *, max(s) OVER (PARTITION BY policy_id, k) AS last_s FROM S),
        R AS (SELECT *, row_number() OVER (PARTITION BY policy_id, k ORDER BY event_time DESC, seq DESC) AS rn FROM T WHERE s = last_s)
        SELECT folded, policy_id, k, event_type, seq AS event_id, event_time AS source_event_time, value
        FROM R, (VALUES (false), (true)) f(folded) WHERE rn = 1 AND op <> 'd'""",
    "merge_on_read_exact": f"""WITH {L}
        SELECT folded, policy_id, k, event_type, seq AS event_id, event_time AS source_event_time, value
        FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, k ORDER BY event_time DESC, seq DESC) AS rn FROM L),
             (VALUES (false), (true)) f(folded) WHERE rn = 1 AND op <> 'd'""",
    "bucket_growth": f"""WITH {L}, N AS (SELECT max(seq) + 1 AS n FROM L),
        S AS (SELECT L.*, commits, row_number() OVER (PARTITION BY commits, policy_id, k ORDER BY event_time DESC, seq DESC) AS rn
              FROM L, N, (VALUES (2), (4)) c(commits) WHERE seq * 4 // n < commits)
        SELECT commits, policy_id, k, event_type, seq AS event_id, event_time AS source_event_time, value
        FROM S WHERE rn = 1 AND op <> 'd'""",
    "models_incremental": f"""WITH {L}, N AS (SELECT max(seq) + 1 AS n FROM L),
        S AS (SELECT L.*, seq * 6 // n AS s FROM L, N),
        runs AS (SELECT DISTINCT policy_id, k, s AS run FROM S),
        seen AS (SELECT r.run, S.*, row_number() OVER (PARTITION BY S.policy_id, S.k, run ORDER BY event_time DESC, seq DESC) AS rt,
                        row_number() OVER (PARTITION BY S.policy_id, S.k, run ORDER BY seq DESC) AS ra
                 FROM runs r JOIN S ON S.policy_id = r.policy_id AND S.k = r.k AND S.s <= r.run),
        says AS (SELECT t.*, CASE WHEN a.op = 'd' THEN 'd' WHEN t.op <> 'd' THEN 'u' END AS does
                 FROM seen t JOIN seen a ON t.policy_id = a.policy_id AND t.k = a.k AND t.run = a.run WHERE t.rt = 1 AND a.ra = 1),
        fin AS (SELECT *, row_number() OVER (PARTITION BY policy_id, k ORDER BY run DESC) AS rn FROM says WHERE does IS NOT NULL)
        SELECT policy_id, k, event_type, seq AS event_id, event_time AS source_event_time, value FROM fin WHERE rn = 1 AND does = 'u'""",
    "debounced_merge": f"""WITH {L}
        SELECT policy_id, k, event_type, seq AS event_id, event_time AS source_event_time, value, CAST(1 AS BIGINT) AS n_merges
        FROM (SELECT *, row_number() OVER (PARTITION BY policy_id, k ORDER BY event_time DESC, seq DESC) AS rn FROM L)
        WHERE rn = 1 AND op <> 'd'""",
    "unnamed_paths": """SELECT * FROM (
        SELECT '$.channel' AS path, 'string' AS kind, count(*) AS n FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT '$.risk.score', 'number', count(*) FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT '$.risk.high', 'boolean', count(*) FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT '$.tags[*]', 'string', 2 * count(*) FROM customer WHERE c_custkey % 5 = 0) WHERE n > 0""",
    "merge_lag": f"""WITH {L}, N AS (SELECT max(seq) + 1 AS n FROM L), S AS (SELECT L.*, seq * 6 // n AS s FROM L, N),
        T AS (SELECT *, max(s) OVER (PARTITION BY policy_id, k) AS last_s, max(arrival_time) OVER (PARTITION BY s) AS merged_at FROM S),
        R AS (SELECT *, row_number() OVER (PARTITION BY policy_id, k ORDER BY event_time DESC, seq DESC) AS rn FROM T WHERE s = last_s),
        G AS (SELECT merged_at, epoch_ms(merged_at) - epoch_ms(event_time) AS lag FROM R WHERE rn = 1 AND op <> 'd')
        SELECT merged_at, quantile_disc(lag, 0.5) AS p50_ms, quantile_disc(lag, 0.9) AS p90_ms,
               quantile_disc(lag, 0.99) AS p99_ms, max(lag) AS max_ms, count(*) AS n_rows FROM G GROUP BY merged_at""",
    "history_as_of": f"""WITH {L},
        H AS (SELECT *, lead(event_time) OVER (PARTITION BY policy_id, k ORDER BY event_time, seq) AS valid_to FROM L)
        SELECT held_at, policy_id, k, seq AS event_id, event_type, event_time AS valid_from, valid_to
        FROM H, (VALUES (TIMESTAMP '2024-01-05 12:00:00'), (TIMESTAMP '2024-01-16 00:00:00'), (TIMESTAMP '2024-01-29 06:30:00')) v(held_at)
        WHERE event_time <= held_at AND (valid_to IS NULL OR valid_to > held_at) AND op <> 'd'""",
    "log_resume": f"""WITH {L},
        P AS (SELECT L.*, policy_id % 3 AS part, row_number() OVER (PARTITION BY policy_id % 3 ORDER BY seq) - 1 AS off,
                     count(*) OVER (PARTITION BY policy_id % 3) AS n FROM L)
        SELECT CAST(part AS INTEGER) AS partition, off AS seq, op, policy_id AS id FROM P
        WHERE part = 1 OR part = 0 AND off >= n // 2""",
    "direct_stream": f"WITH {DOCS} SELECT {COVERAGE_COLS} FROM O",
    # ---- checks ---------------------------------------------------------------------------------
    "parent_child_counts": f"""WITH {DOCS} SELECT C.c_custkey AS policy_id, COALESCE(n, 0) AS n_children FROM C
        LEFT JOIN (SELECT o_custkey, count(*) AS n FROM O GROUP BY o_custkey) x ON x.o_custkey = C.c_custkey
        WHERE C.c_mktsegment = 'BUILDING'""",
    "orphans": f"""WITH {DOCS} SELECT {COVERAGE_COLS} FROM O
        WHERE o_custkey IN (SELECT c_custkey FROM C WHERE c_mktsegment = 'BUILDING')""",
    "unique_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "null_violations": f"""WITH {DOCS}, V AS (SELECT {VEHICLE_COLS} FROM O)
        SELECT 'policy_id' AS column_name, count(*) FILTER (WHERE policy_id IS NULL) AS n_null FROM V
        UNION ALL SELECT 'vin', count(*) FILTER (WHERE vin IS NULL OR policy_id % 11 = 0) FROM V
        UNION ALL SELECT 'year_made', count(*) FILTER (WHERE year_made IS NULL OR policy_id % 13 = 0) FROM V
        UNION ALL SELECT 'make', count(*) FILTER (WHERE make IS NULL OR policy_id % 17 = 0) FROM V""",
    "key_conflicts": f"""WITH {DOCS},
        D AS (SELECT o_custkey AS policy_id, 'V' || CAST(o_orderkey AS VARCHAR) AS vehicle_vin,
                     CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS license_number
              FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey),
        X AS (SELECT count(*) AS n FROM D GROUP BY policy_id, vehicle_vin, license_number HAVING count(*) > 1)
        SELECT 'driver' AS table_name, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows FROM X HAVING count(*) > 0
        UNION ALL SELECT 'policy', count(*), 2 * count(*) FROM C WHERE c_custkey % 7 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'claim', count(*), 2 * count(*) FROM O WHERE o_custkey % 5 = 0 HAVING count(*) > 0""",
    "row_counts": f"""WITH {DOCS} SELECT table_name, n_rows, n_rows >= 1 AS ok FROM (
        SELECT 'policy' AS table_name, (SELECT count(*) FROM C) AS n_rows
        UNION ALL SELECT 'coverage', (SELECT count(*) FROM O)
        UNION ALL SELECT 'vehicle', (SELECT count(*) FROM O)
        UNION ALL SELECT 'driver', (SELECT count(*) FROM O JOIN LI ON LI.l_orderkey = O.o_orderkey)
        UNION ALL SELECT 'claim', (SELECT count(*) FROM O))""",
    "envelope_shape": f"""WITH {L} SELECT count(*) AS n_events, count(*) FILTER (WHERE op <> 'd' AND seq % 13 = 0) AS n_missing_after,
        count(*) FILTER (WHERE op = 'd' AND seq % 17 = 0) AS n_missing_before FROM L""",
    "lag_percentiles": f"""WITH {L}, G AS (SELECT op, ts_ms - epoch_ms(event_time) AS lag FROM L)
        SELECT op, quantile_disc(lag, 0.5) AS p50_ms, quantile_disc(lag, 0.9) AS p90_ms,
               quantile_disc(lag, 0.99) AS p99_ms, max(lag) AS max_ms, count(*) AS n_rows FROM G GROUP BY op""",
}

# the same rows by another way
ORACLE["lost_checkpoint"] = ORACLE["stream_equals_batch"]
