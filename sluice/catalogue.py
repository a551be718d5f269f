"""Queries of the predicate-transfer engine and the SQL that checks them.

Each query is SQL that Spark and a plain SQL engine both run; here it goes through a ``TransferSession`` with the cost rules off, so that transfers happen
on small tables too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.session import TransferSession
from sluice.sources.tables import register

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Sums are exact (decimal) and turned into doubles at the end, so they don't depend on the order of rows.
_MONEY = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)"
_REVENUE = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"
_QTY = "CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)"

_CHAIN3 = f"""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderstatus"""
_CHAIN4 = f"""SELECT n_name, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 2 AND c_acctbal > 5000 GROUP BY n_name"""
_STAR4 = f"""SELECT p_brand, CAST(count(*) AS BIGINT) AS n, {_MONEY} AS price
FROM lineitem, part, supplier, orders WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey
AND p_size < 5 AND s_acctbal > 0 AND o_orderstatus = 'F' GROUP BY p_brand"""
#: Four relations with null, repeated and unmatched keys of two types: p - q - r - s is a chain, q also has s's key, and p and s share a string.
_T = """WITH p(pq, pt, px) AS (VALUES (7, 'a', 2), (7, 'b', 3), (CAST(NULL AS INT), 'c', 5), (8, CAST(NULL AS STRING), 7), (9, 'd', 11), (9, 'd', 13), (12, 'e', 17)),
q(pq, qr, qs, qx) AS (VALUES (7, 70, 1, 1), (8, 71, 2, 10), (8, CAST(NULL AS INT), 2, 100), (CAST(NULL AS INT), 72, 3, 1000), (10, 73, 1, 10000), (9, 71, CAST(NULL AS INT), 100000), (9, 74, 4, 200000)),
r(qr, rs, rx) AS (VALUES (70, 3, 1), (71, 4, 20), (71, 5, 300), (CAST(NULL AS INT), 6, 4000), (75, 4, 50000), (74, CAST(NULL AS INT), 60000)),
s(rs, qs, pt, sx) AS (VALUES (3, 1, 'b', 1), (4, 2, 'd', 10), (4, 4, CAST(NULL AS STRING), 100), (CAST(NULL AS INT), 2, 'a', 1000), (5, CAST(NULL AS INT), 'd', 10000), (9, 9, 'z', 100000))
"""
_SUMS = "CAST(count(*) AS BIGINT) AS n, CAST(sum(px) AS BIGINT) AS sp, CAST(sum(qx) AS BIGINT) AS sq"

SQL: dict[str, str] = {
    "two_way_join": f"SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 1000 GROUP BY o_orderstatus",
    "chain3": _CHAIN3,
    "chain4": _CHAIN4,
    "star4": _STAR4,
    "bushy5": f"""SELECT s_name, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty
FROM (SELECT l_orderkey, l_quantity, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000) a
JOIN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3') b
ON l_orderkey = o_orderkey GROUP BY s_name""",
    "chain4_largest_root": _CHAIN4,
    "chain4_forward_only": _CHAIN4,
    "chain4_keep_redundant": _CHAIN4,
    "star4_no_flip": _STAR4,
    "star4_bloom_only": _STAR4,
    "star4_minmax_only": _STAR4,
    "filter_eq": f"SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_custkey = 7 GROUP BY c_mktsegment",
    "filter_in": f"SELECT c_custkey, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_custkey IN (3, 40, 77, 101) GROUP BY c_custkey",
    "filter_minmax": f"SELECT c_custkey, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_custkey BETWEEN 10 AND 30 GROUP BY c_custkey",
    "filter_bloom": f"SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_brand = 'Brand#3' GROUP BY s_nationkey",
    "filter_empty": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(o_orderkey) AS BIGINT) AS top FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_mktsegment = 'NONE' AND c_acctbal < -5",
    "multi_column_join": """SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(b.vb) AS BIGINT) AS vb, CAST(sum(p_size) AS BIGINT) AS size
FROM lineitem a JOIN (SELECT l_orderkey AS ok, l_partkey AS pk, max(l_linenumber) AS vb FROM lineitem WHERE l_quantity > 45 GROUP BY l_orderkey, l_partkey) b ON a.l_orderkey = b.ok AND a.l_partkey = b.pk
JOIN part ON a.l_partkey = p_partkey WHERE p_size < 10""",
    "having_in_subquery": """SELECT c_custkey, CAST(count(*) AS BIGINT) AS n FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey
AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(18,2))) > 200) GROUP BY c_custkey""",
    "in_list_mark": "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) OR o_totalprice > 400000) AND n_regionkey < 2 GROUP BY o_orderstatus",
    "exists_semi": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment",
    "not_exists_anti": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY c_mktsegment",
    "not_in_anti": "SELECT CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "left_outer": f"SELECT c_custkey, CAST(count(l_orderkey) AS BIGINT) AS n, {_QTY} AS qty FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE c_acctbal > 9000 GROUP BY c_custkey",
    "right_outer": "SELECT n_name, CAST(count(o_orderkey) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey RIGHT JOIN nation ON c_nationkey = n_nationkey AND o_totalprice > 450000 GROUP BY n_name",
    "full_outer": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(c_custkey) AS BIGINT) AS c, CAST(count(s_suppkey) AS BIGINT) AS s FROM (SELECT * FROM customer WHERE c_acctbal > 8000) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_custkey = s_suppkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "null_keys": _T + f"SELECT {_SUMS}, CAST(sum(rx) AS BIGINT) AS sr, CAST(sum(sx) AS BIGINT) AS ss FROM p JOIN q ON p.pq = q.pq JOIN r ON q.qr = r.qr JOIN s ON r.rs = s.rs",
    "null_keys_star": _T + f"SELECT {_SUMS}, CAST(sum(rx) AS BIGINT) AS sr, CAST(sum(sx) AS BIGINT) AS ss FROM q JOIN p ON p.pq = q.pq JOIN r ON q.qr = r.qr JOIN s ON q.qs = s.qs",
    "null_keys_outer": _T + f"SELECT {_SUMS}, CAST(sum(rx) AS BIGINT) AS sr, CAST(sum(sx) AS BIGINT) AS ss FROM p LEFT JOIN q ON p.pq = q.pq AND qx < 100000 LEFT JOIN r ON q.qr = r.qr JOIN s ON p.pt = s.pt",
    "null_safe_key": _T + f"SELECT {_SUMS} FROM p JOIN q ON p.pq IS NOT DISTINCT FROM q.pq JOIN r ON q.qr = r.qr JOIN s ON r.rs IS NOT DISTINCT FROM s.rs",
    "cycle_triangle": _T + "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(qx) AS BIGINT) AS sq FROM q JOIN r ON q.qr = r.qr JOIN s ON q.qs = s.qs AND r.rs = s.rs",
    "cycle4": _T + f"SELECT {_SUMS} FROM p JOIN q ON p.pq = q.pq JOIN r ON q.qr = r.qr JOIN s ON r.rs = s.rs AND p.pt = s.pt",
    "theta_only": _T + f"SELECT {_SUMS} FROM p JOIN q ON p.pq < q.pq JOIN r ON q.qr < r.qr",
    "theta_plus_equi": _T + f"SELECT {_SUMS} FROM q JOIN p ON p.px > q.qx JOIN r ON q.qr = r.qr",
    "cross_component": "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM region CROSS JOIN (SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 5 AND o_totalprice > 400000) x GROUP BY r_name",
    "redundant_dense": "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM orders, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "redundant_gapped": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(f.l_linenumber) AS BIGINT) AS v FROM lineitem f JOIN (SELECT p_partkey * 2 AS k FROM part) d ON f.l_partkey = d.k JOIN (SELECT s_suppkey * 3 AS k FROM supplier) e ON f.l_suppkey = e.k",
    "equiv_broadcast": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(a.l_linenumber) AS BIGINT) AS v FROM lineitem a JOIN orders ON a.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity = 50) b ON b.k = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 3000",
    "self_join": "SELECT CAST(count(*) AS BIGINT) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON b.n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND a.n_nationkey < 10",
    "computed_key": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey + 1 AS k, o_custkey FROM orders WHERE o_totalprice > 300000) o JOIN lineitem ON k = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 4",
    "limit_below_join": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS s FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3",
    "window_below_join": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE rn = 2 AND n_regionkey = 3",
    "union_below_join": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT s_suppkey FROM supplier) u JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY c_mktsegment",
    "agg_below_join": "SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY o_custkey) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 GROUP BY c_mktsegment",
    "string_key": "SELECT CAST(count(*) AS BIGINT) AS n FROM customer a JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_acctbal > 9900) b ON a.c_mktsegment = b.seg JOIN nation ON a.c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "date_key": "SELECT CAST(count(*) AS BIGINT) AS n FROM orders JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity = 50 AND l_discount < 0.02) x ON CAST(o_orderdate AS DATE) = x.d JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5",
    "decimal_key": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(o_custkey AS DECIMAL(12, 2)) AS k, o_orderkey FROM orders WHERE o_totalprice > 300000) o JOIN (SELECT CAST(c_custkey AS DECIMAL(12, 2)) AS k, c_mktsegment, c_nationkey FROM customer) c ON o.k = c.k JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 4 GROUP BY c_mktsegment",
    "double_key": """WITH a(k, x) AS (VALUES (CAST('NaN' AS DOUBLE), 1), (CAST('-0.0' AS DOUBLE), 2), (CAST('1.5' AS DOUBLE), 3), (CAST(NULL AS DOUBLE), 4)), b(k, y) AS (VALUES (CAST('NaN' AS DOUBLE), 10), (CAST('0.0' AS DOUBLE), 20), (CAST('1.5' AS DOUBLE), 30)),
c(y) AS (VALUES (10), (20), (40)) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS sx FROM a JOIN b ON a.k = b.k JOIN c ON b.y = c.y""",
    "boolean_key": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT c_acctbal > 0 AS k, c_nationkey FROM customer) c JOIN (SELECT true AS k UNION ALL SELECT CAST(NULL AS BOOLEAN)) b ON c.k = b.k JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1",
    "cte_twice": "WITH best AS (SELECT o_custkey AS k, max(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, CAST(b.n AS BIGINT) AS n FROM best a JOIN customer ON a.k = c_custkey JOIN best b ON c_custkey = b.k JOIN nation ON c_nationkey = n_nationkey WHERE a.price > 400000 AND n_regionkey = 2",
    "ungrouped_aggregate": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(o_orderkey) AS BIGINT) AS top FROM (SELECT max(c_custkey) AS k FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 <> 0) m JOIN orders ON o_custkey = m.k JOIN lineitem ON l_orderkey = o_orderkey",
    "scalar_subquery": f"SELECT n_name, CAST(count(*) AS BIGINT) AS n, {_QTY} AS qty FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND l_quantity = (SELECT max(x.l_quantity) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey) AND o_totalprice > (SELECT max(o_totalprice) * 0.8 FROM orders) GROUP BY n_name",
    "intersect_below_join": "SELECT n_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) x JOIN customer ON k = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 2 GROUP BY n_name",
    "limit_unordered": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey FROM orders LIMIT 100) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "chain4_summaries": _CHAIN4,
    "star4_summaries": _STAR4,
    "tpch_q1": f"SELECT l_returnflag, l_linestatus, {_QTY} AS sum_qty, {_MONEY} AS sum_price, {_REVENUE} AS sum_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": f"SELECT l_orderkey, {_REVENUE} AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1996-03-15 00:00:00' GROUP BY l_orderkey",
    "tpch_q5": f"SELECT n_name, {_REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6": "SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7": f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {_REVENUE} AS revenue FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_name IN ('NATION_1', 'NATION_2') AND n2.n_name IN ('NATION_1', 'NATION_2') GROUP BY n1.n_name, n2.n_name",
    "tpch_q8": f"SELECT o_orderstatus, {_REVENUE} AS volume FROM part, supplier, lineitem, orders, customer, nation, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA' AND p_type = 'ECONOMY' GROUP BY o_orderstatus",
    "tpch_q10": f"SELECT c_custkey, n_name, {_REVENUE} AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND o_totalprice > 400000 GROUP BY c_custkey, n_name",
    "tpch_q14": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN p_type = 'PROMO' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'",
    "tpch_q17": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem, part, (SELECT l_partkey AS pk, avg(CAST(l_quantity AS DOUBLE)) AS q FROM lineitem GROUP BY l_partkey) a WHERE p_partkey = l_partkey AND pk = p_partkey AND p_brand = 'Brand#23' AND l_quantity < 0.5 * q",
    "tpch_q18": f"SELECT c_name, o_orderkey, {_QTY} AS qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(18,2))) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey",
    "tpch_q21": "SELECT s_name, CAST(count(*) AS BIGINT) AS n FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey AND n_name = 'NATION_7' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 45) GROUP BY s_name",
    "window_rank": "SELECT c_nationkey, c_custkey, CAST(r AS BIGINT) AS r FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) x WHERE r <= 3",
    "rollup": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "set_ops": "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_suppkey FROM supplier",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}
#: Settings beside the gate. Without local builds every filter comes from a distributed aggregation.
_WITH: dict[str, dict] = {
    "chain4_largest_root": {"heuristic": "largest_root"},
    "chain4_forward_only": {"passMode": "forward_only"},
    "chain4_keep_redundant": {"removeRedundantPairs": False},
    "star4_no_flip": {"flipRoots": False},
    "star4_bloom_only": {"filterType": "bf_only", "localBuildBytes": 0},
    "star4_minmax_only": {"filterType": "minmax_only", "localBuildBytes": 0},
    **{k: {"localBuildBytes": 0} for k in ("chain4_summaries", "star4_summaries", "filter_eq", "filter_in", "filter_minmax", "filter_bloom", "multi_column_join", "decimal_key", "boolean_key", "limit_unordered")},
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, _TABLES)
        session = TransferSession(spark)
        with session.settings(minProbeBytes=0, **_WITH.get(name, {})):
            return session.sql(SQL[name])

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in SQL}
ORACLES = dict(SQL)
