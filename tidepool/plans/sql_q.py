"""Q01 + P01-P20: SQL acceptance queries run through ``run_sql``.

Each entry is (Spark SQL statements, DuckDB SQL). The Spark text is what a
user passes to Q01; the DuckDB text is the independent oracle.
"""

from __future__ import annotations

from ..operators.sqlpass import run_sql
from ..session import prepare, work_path
from ..sources.tables import load

SQL: dict[str, tuple[list[str], str]] = {}


def _add(key, spark_sql, duck_sql):
    SQL[key] = ([spark_sql] if isinstance(spark_sql, str) else spark_sql, duck_sql)


# P01 scan, projection, predicate
_add("sql_filter", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_shipdate
FROM lineitem
WHERE l_shipdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'
  AND l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'
  AND l_discount BETWEEN 0.05 AND 0.07
  AND l_quantity < 24
  AND l_returnflag IN ('A', 'R')
  AND l_linestatus IS NOT NULL
""", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_shipdate
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00'
  AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
  AND l_discount BETWEEN 0.05 AND 0.07
  AND l_quantity < 24
  AND l_returnflag IN ('A', 'R')
  AND l_linestatus IS NOT NULL
""")

_add("sql_like", """
SELECT p_partkey, p_name, p_brand
FROM part
WHERE (p_name LIKE '%ring%' OR p_name ILIKE 'RED %' OR p_brand RLIKE '^Brand#1[0-9]$')
  AND p_type NOT LIKE 'SMALL%' AND p_size IS NOT NULL
""", """
SELECT p_partkey, p_name, p_brand
FROM part
WHERE (p_name LIKE '%ring%' OR p_name ILIKE 'RED %' OR regexp_matches(p_brand, '^Brand#1[0-9]$'))
  AND p_type NOT LIKE 'SMALL%' AND p_size IS NOT NULL
""")

# P02 inner equi-join
_add("sql_join", """
SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name
""", """
SELECT r.r_name, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name
""")

# P03 outer joins
_add("sql_outer", """
WITH cu AS (SELECT c_nationkey AS nk, count(*) AS customers FROM customer
            WHERE c_acctbal > 9500 GROUP BY c_nationkey),
     su AS (SELECT s_nationkey AS nk, count(*) AS suppliers FROM supplier
            WHERE s_acctbal > 5000 GROUP BY s_nationkey)
SELECT coalesce(cu.nk, su.nk) AS nationkey,
       coalesce(cu.customers, 0) AS customers,
       coalesce(su.suppliers, 0) AS suppliers
FROM cu FULL OUTER JOIN su ON cu.nk = su.nk
""", """
WITH cu AS (SELECT c_nationkey AS nk, count(*) AS customers FROM customer
            WHERE c_acctbal > 9500 GROUP BY c_nationkey),
     su AS (SELECT s_nationkey AS nk, count(*) AS suppliers FROM supplier
            WHERE s_acctbal > 5000 GROUP BY s_nationkey)
SELECT coalesce(cu.nk, su.nk) AS nationkey,
       coalesce(cu.customers, 0) AS customers,
       coalesce(su.suppliers, 0) AS suppliers
FROM cu FULL OUTER JOIN su ON cu.nk = su.nk
""")

_add("sql_left_join", """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS urgent_failed
FROM customer c
LEFT JOIN orders o
  ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
GROUP BY c.c_custkey, c.c_name
""", """
SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS urgent_failed
FROM customer c
LEFT JOIN orders o
  ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F'
GROUP BY c.c_custkey, c.c_name
""")

_add("sql_right_join", """
SELECT n.n_name, s.s_suppkey
FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) s
RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey
""", """
SELECT n.n_name, s.s_suppkey
FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) s
RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey
""")

# P04 semi / anti
_add("sql_semi_anti", """
SELECT p_partkey, 'semi' AS kind FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)
UNION ALL
SELECT p_partkey, 'anti' AS kind FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)
UNION ALL
SELECT s_suppkey AS p_partkey, 'in' AS kind FROM supplier
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 50)
""", """
SELECT p_partkey, 'semi' AS kind FROM part p
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)
UNION ALL
SELECT p_partkey, 'anti' AS kind FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)
UNION ALL
SELECT s_suppkey AS p_partkey, 'in' AS kind FROM supplier
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_quantity = 50)
""")

# P05 range join (equi key + range condition) and lateral top-1
_add("sql_range_join", """
SELECT o.o_orderkey, count(*) AS late_lines
FROM orders o
JOIN lineitem l
  ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate + INTERVAL 400 DAYS
GROUP BY o.o_orderkey
""", """
SELECT o.o_orderkey, count(*) AS late_lines
FROM orders o
JOIN lineitem l
  ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate + INTERVAL 400 DAY
GROUP BY o.o_orderkey
""")

_add("sql_lateral", """
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice
FROM customer c,
LATERAL (SELECT o.o_orderkey, o.o_totalprice FROM orders o
         WHERE o.o_custkey = c.c_custkey
         ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) t
""", """
SELECT c.c_custkey, t.o_orderkey, t.o_totalprice
FROM customer c,
LATERAL (SELECT o.o_orderkey, o.o_totalprice FROM orders o
         WHERE o.o_custkey = c.c_custkey
         ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) t
""")

# P06 group by, having, count distinct, FILTER
_add("sql_agg", """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))
            AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
                * (1 + CAST(l_tax AS DECIMAL(15,2)))) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_extendedprice), 6) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order,
       count(DISTINCT l_orderkey) AS n_orders,
       count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted
FROM lineitem
WHERE l_shipdate <= TIMESTAMP_NTZ '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
HAVING count(*) > 100
""", """
SELECT l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))
            AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))
                * (1 + CAST(l_tax AS DECIMAL(15,2)))) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_extendedprice), 6) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order,
       count(DISTINCT l_orderkey) AS n_orders,
       count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
HAVING count(*) > 100
""")

# P07 grouping sets, cube, rollup
_add("sql_grouping", """
SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid,
       count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""", """
SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS gid,
       count(*) AS n, round(sum(l_quantity), 2) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")

_add("sql_rollup", """
SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS gid,
       count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""", """
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS gid,
       count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")

_add("sql_grouping_sets", """
SELECT c_mktsegment, c_nationkey, grouping_id(c_mktsegment, c_nationkey) AS gid,
       count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal
FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())
""", """
SELECT c_mktsegment, c_nationkey, grouping(c_mktsegment, c_nationkey) AS gid,
       count(*) AS n, round(avg(c_acctbal), 6) AS avg_bal
FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())
""")

# P08 ranking windows
_add("sql_rank", """
SELECT o_custkey, o_orderkey, o_totalprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rnk,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS drnk,
       ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quartile
FROM orders
""", """
SELECT o_custkey, o_orderkey, o_totalprice,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rnk,
       dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS drnk,
       ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quartile
FROM orders
""")

# P09 analytic windows and frames
_add("sql_frame", """
SELECT o_custkey, o_orderkey, o_orderdate,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order,
       lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order,
       first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_order,
       round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
             RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS orders_last_year
FROM orders
""", """
SELECT o_custkey, o_orderkey, o_orderdate,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order,
       lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order,
       first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_order,
       round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
             RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS orders_last_year
FROM orders
""")

# P10 sort, limit, offset
_add("sql_topn", """
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST
LIMIT 20 OFFSET 5
""", """
SELECT o_orderkey, o_custkey, o_totalprice
FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST
LIMIT 20 OFFSET 5
""")

# P11 set operations
_SETOPS = """
SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') a
UNION ALL
SELECT 'union_all' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') b
UNION ALL
SELECT 'intersect' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') c
UNION ALL
SELECT 'intersect_all' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') d
UNION ALL
SELECT 'except' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') e
UNION ALL
SELECT 'except_all' AS op, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') f
"""
_add("sql_setops", _SETOPS, _SETOPS)

# P12 CTE, scalar and correlated subqueries, recursive CTE
_add("sql_subquery", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, round(s.total, 2) AS total
FROM customer c JOIN spend s ON s.o_custkey = c.c_custkey
WHERE s.total > (SELECT avg(total) * 1.5 FROM spend)
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
""", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, round(s.total, 2) AS total
FROM customer c JOIN spend s ON s.o_custkey = c.c_custkey
WHERE s.total > (SELECT avg(total) * 1.5 FROM spend)
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
""")

_add("sql_recursive", """
WITH RECURSIVE nxt AS (
  SELECT o_custkey, o_orderkey,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders
), chain (o_custkey, o_orderkey, next_key, depth) AS (
  SELECT o_custkey, o_orderkey, next_key, 1 FROM nxt WHERE rn = 1
  UNION ALL
  SELECT n.o_custkey, n.o_orderkey, n.next_key, c.depth + 1
  FROM chain c JOIN nxt n ON n.o_orderkey = c.next_key
)
SELECT o_custkey, CAST(max(depth) AS BIGINT) AS chain_len, count(*) AS n FROM chain GROUP BY o_custkey
""", """
WITH RECURSIVE nxt AS (
  SELECT o_custkey, o_orderkey,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders
), chain (o_custkey, o_orderkey, next_key, depth) AS (
  SELECT o_custkey, o_orderkey, next_key, 1 FROM nxt WHERE rn = 1
  UNION ALL
  SELECT n.o_custkey, n.o_orderkey, n.next_key, c.depth + 1
  FROM chain c JOIN nxt n ON n.o_orderkey = c.next_key
)
SELECT o_custkey, CAST(max(depth) AS BIGINT) AS chain_len, count(*) AS n FROM chain GROUP BY o_custkey
""")

_BOUNDED = """
WITH RECURSIVE nxt AS (
  SELECT o_orderkey,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key
  FROM orders
), walk (start_key, o_orderkey, next_key, depth) AS (
  SELECT o_orderkey, o_orderkey, next_key, 0 FROM nxt
  UNION ALL
  SELECT w.start_key, n.o_orderkey, n.next_key, w.depth + 1
  FROM walk w JOIN nxt n ON n.o_orderkey = w.next_key
  WHERE w.depth < 3
)
SELECT start_key, CAST(max(depth) AS BIGINT) AS reach, count(*) AS n FROM walk GROUP BY start_key
"""
_add("sql_recursive_bounded", _BOUNDED, _BOUNDED)

# P13 string functions
_add("sql_string", """
SELECT c_custkey,
       upper(c_mktsegment) AS seg_upper,
       lower(c_name) AS name_lower,
       substring(c_name, 10, 9) AS name_num,
       regexp_replace(c_name, '#0+', '#') AS short_name,
       split_part(c_name, '#', 2) AS name_part,
       concat_ws('|', c_mktsegment, c_name) AS joined,
       CAST(length(c_name) AS BIGINT) AS name_len,
       lpad(CAST(c_nationkey AS STRING), 3, '0') AS nk_pad,
       replace(c_mktsegment, 'A', 'a') AS seg_repl,
       reverse(c_mktsegment) AS seg_rev,
       CAST(instr(c_mktsegment, 'U') AS BIGINT) AS pos_u,
       left(c_mktsegment, 3) AS seg3
FROM customer
""", """
SELECT c_custkey,
       upper(c_mktsegment) AS seg_upper,
       lower(c_name) AS name_lower,
       substring(c_name, 10, 9) AS name_num,
       regexp_replace(c_name, '#0+', '#', 'g') AS short_name,
       split_part(c_name, '#', 2) AS name_part,
       concat_ws('|', c_mktsegment, c_name) AS joined,
       CAST(length(c_name) AS BIGINT) AS name_len,
       lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nk_pad,
       replace(c_mktsegment, 'A', 'a') AS seg_repl,
       reverse(c_mktsegment) AS seg_rev,
       CAST(instr(c_mktsegment, 'U') AS BIGINT) AS pos_u,
       left(c_mktsegment, 3) AS seg3
FROM customer
""")

# P14 date / interval functions
_add("sql_date", """
SELECT o_orderkey,
       CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS month_start,
       CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr,
       CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS qtr,
       CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS dom,
       o_orderdate + INTERVAL 30 DAYS AS due,
       CAST(o_orderdate AS DATE) AS order_day,
       CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_to_2000
FROM orders
""", """
SELECT o_orderkey,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
       CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr,
       CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS qtr,
       CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS dom,
       o_orderdate + INTERVAL 30 DAY AS due,
       CAST(o_orderdate AS DATE) AS order_day,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS BIGINT) AS days_to_2000
FROM orders
""")

# P15 math, conditional, cast
_add("sql_math", """
SELECT p_partkey,
       round(p_retailprice * 1.07, 2) AS with_tax,
       CAST(floor(p_retailprice / 100) AS BIGINT) AS hundreds,
       CAST(ceil(p_retailprice / 100) AS BIGINT) AS hundreds_up,
       abs(p_size - 25) AS size_dist,
       p_size % 7 AS size_mod,
       CAST(p_size div 7 AS INT) AS size_div,
       CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size_class,
       coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand,
       CAST(p_retailprice AS BIGINT) AS price_int,
       round(sqrt(p_size), 6) AS size_sqrt,
       round(power(p_size, 2), 2) AS size_sq,
       round(ln(p_retailprice), 6) AS ln_price,
       CAST(sign(p_size - 25) AS INT) AS size_sign
FROM part
""", """
SELECT p_partkey,
       round(p_retailprice * 1.07, 2) AS with_tax,
       CAST(floor(p_retailprice / 100) AS BIGINT) AS hundreds,
       CAST(ceil(p_retailprice / 100) AS BIGINT) AS hundreds_up,
       abs(p_size - 25) AS size_dist,
       p_size % 7 AS size_mod,
       CAST(p_size // 7 AS INT) AS size_div,
       CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS size_class,
       coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand,
       CAST(trunc(p_retailprice) AS BIGINT) AS price_int,
       round(sqrt(p_size), 6) AS size_sqrt,
       round(power(p_size, 2), 2) AS size_sq,
       round(ln(p_retailprice), 6) AS ln_price,
       CAST(sign(p_size - 25) AS INT) AS size_sign
FROM part
""")

# P16 JSON and arrays
_add("sql_json", """
SELECT user_id,
       count(*) AS n,
       sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum,
       max(from_json(props, 'k BIGINT').k) AS k_max,
       array_join(array_sort(collect_set(event_type)), ',') AS types,
       size(collect_set(event_type)) AS n_types
FROM events
GROUP BY user_id
""", """
SELECT user_id,
       count(*) AS n,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum,
       max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max,
       array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') AS types,
       CAST(len(list_distinct(array_agg(event_type))) AS INT) AS n_types
FROM events
GROUP BY user_id
""")

_add("sql_explode", """
SELECT c_mktsegment, part, count(*) AS n
FROM (SELECT c_mktsegment, explode(split(c_name, '#')) AS part FROM customer)
GROUP BY c_mktsegment, part
""", """
SELECT c_mktsegment, part, count(*) AS n
FROM (SELECT c_mktsegment, unnest(string_split(c_name, '#')) AS part FROM customer)
GROUP BY c_mktsegment, part
""")

# P17 percentiles and statistics
_add("sql_stats", """
SELECT l_returnflag,
       round(percentile(l_quantity, 0.5), 6) AS median_qty,
       round(percentile(l_extendedprice, 0.9), 4) AS p90_price,
       round(stddev_samp(l_extendedprice), 4) AS sd_price,
       round(var_samp(l_discount), 8) AS var_disc,
       round(corr(l_quantity, l_extendedprice), 6) AS corr_qp
FROM lineitem GROUP BY l_returnflag
""", """
SELECT l_returnflag,
       round(quantile_cont(l_quantity, 0.5), 6) AS median_qty,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_price,
       round(stddev_samp(l_extendedprice), 4) AS sd_price,
       round(var_samp(l_discount), 8) AS var_disc,
       round(corr(l_quantity, l_extendedprice), 6) AS corr_qp
FROM lineitem GROUP BY l_returnflag
""")

# P18 DISTINCT ON (as row_number() = 1)
_add("sql_distinct_on", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT o_custkey, o_orderkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) t
WHERE rn = 1
""", """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate
FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC
""")

# P19 generate_series (as explode(sequence(..)))
_add("sql_series", """
WITH bounds AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events),
     days AS (SELECT explode(sequence(lo, hi, INTERVAL 1 DAY)) AS day FROM bounds),
     cnt AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase'
             GROUP BY CAST(ts AS DATE))
SELECT d.day, coalesce(c.n, 0) AS n FROM days d LEFT JOIN cnt c ON c.day = d.day
""", """
WITH bounds AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events),
     days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM bounds),
     cnt AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase'
             GROUP BY CAST(ts AS DATE))
SELECT d.day, coalesce(c.n, 0) AS n FROM days d LEFT JOIN cnt c ON c.day = d.day
""")

# P20 user SQL functions, scalar and table
_add("sql_udf", [
    """CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, disc DOUBLE)
       RETURNS DECIMAL(31,4)
       RETURN CAST(price AS DECIMAL(15,2)) * (1 - CAST(disc AS DECIMAL(15,2)))""",
    """SELECT l_orderkey, CAST(sum(net_price(l_extendedprice, l_discount)) AS DOUBLE) AS net
       FROM lineitem GROUP BY l_orderkey"""
], """
SELECT l_orderkey,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))))
            AS DOUBLE) AS net
FROM lineitem GROUP BY l_orderkey
""")

_add("sql_udtf", [
    """CREATE OR REPLACE TEMPORARY FUNCTION orders_in(status STRING)
       RETURNS TABLE (o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE)
       RETURN SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = status""",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders_in('F') GROUP BY o_custkey"""
], """
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
""")


def _runner(key):
    stmts = SQL[key][0]

    def run(spark, sf_dir):
        return run_sql(spark, stmts, sf_dir=sf_dir)
    run.__name__ = key
    return run


LEVEL_LIMIT = "spark.sql.cteRecursionLevelLimit"


def _recursive(spark, sf_dir):
    """Runs with a level for each order of the longest chain (100 at least), and writes the result, as the limit holds for this statement only."""
    longest = load(spark, sf_dir, "orders").groupBy("o_custkey").count().agg({"count": "max"}).first()[0] or 0
    path = work_path(spark, "recursive")
    own = prepare(spark.newSession())  # the limit is this statement's: other threads of the session keep theirs
    own.conf.set(LEVEL_LIMIT, str(max(100, longest + 2)))
    run_sql(own, SQL["sql_recursive"][0], sf_dir=sf_dir).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = {k: _runner(k) for k in SQL} | {"sql_recursive": _recursive}
ORACLE = {k: v[1] for k, v in SQL.items()}
