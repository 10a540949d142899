"""Registered queries of the dialect: name -> text, and the SQL of the check where it isn't the same text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name: (text, text for DuckDB or None if the same)
Q: dict[str, tuple[str, str | None]] = {
    "scan_full": ("SELECT * FROM nation", None),
    "project_expr": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", None),
    "project_wildcard_qualified": ("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "filter_cmp": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45", None),
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderkey > 10", None),
    "filter_not": ("SELECT c_custkey FROM customer WHERE NOT c_mktsegment = 'BUILDING'", None),
    "filter_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", None),
    "filter_not_between": ("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 150000", None),
    "filter_in_list": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5)", None),
    "filter_not_in_list": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 3, 5)", None),
    "filter_like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%BRASS%'", None),
    "filter_not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL%'", None),
    "filter_ilike": ("SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%'", None),
    "filter_is_null": ("SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL", None),
    "filter_is_not_null": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 WHERE o.o_orderkey IS NOT NULL", None),
    "pk_lookup": ("SELECT * FROM orders WHERE o_orderkey = 1", None),
    "range_scan": ("SELECT * FROM orders WHERE o_orderkey > 100 AND o_orderkey < 150", None),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F'", None),
    "join_left_residual": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 20", None),
    "join_multi": ("SELECT r.r_name, COUNT(*) AS n, COUNT(DISTINCT c.c_custkey) AS customers FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name HAVING COUNT(*) > 1", None),
    "join_self_alias": ("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_cross": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r"),
    "join_theta": ("SELECT a.n_nationkey, b.r_regionkey FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey", None),
    "join_on_expr": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey + 1 = r.r_regionkey + 1", None),
    "join_right_filter_pushdown": ("SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 2", None),
    "join_derived": ("SELECT c.c_name, t.total FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS total FROM orders GROUP BY o_custkey) AS t ON c.c_custkey = t.o_custkey", None),
    "join_series": ("SELECT s.N AS k, r.r_name FROM SERIES(3) AS s JOIN region r ON s.N = r.r_regionkey", "SELECT CAST(s.N AS BIGINT) AS k, r.r_name FROM range(1, 4) AS s(N) JOIN region r ON s.N = r.r_regionkey"),
    "join_on_null": ("SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON NULL", None),
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", None),
    "not_in_subquery": ("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.9 FROM orders)", None),
    "scalar_subquery_correlated": ("SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS best FROM customer c", None),
    "exists_in_projection": ("SELECT c.c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS has FROM customer c", None),
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem"),
    "agg_groupby": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS n FROM lineitem WHERE l_quantity > 24 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", None),
    "agg_groupby_expr": ("SELECT o_orderkey % 7 AS k, COUNT(*) AS n FROM orders GROUP BY o_orderkey % 7", None),
    "agg_count_expr_null": ("SELECT COUNT(NULLIF(l_discount, 0.0)) AS n, COUNT(*) AS m FROM lineitem", None),
    "agg_min_max_text_date": ("SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer", None),
    "agg_avg": ("SELECT o_orderstatus, ROUND(AVG(o_orderkey) * 100) AS a FROM orders GROUP BY o_orderstatus", None),
    "agg_variance": ("SELECT ROUND(VARIANCE(l_quantity) * 10000) AS v FROM lineitem", "SELECT ROUND(var_pop(l_quantity) * 10000) AS v FROM lineitem"),
    "agg_stdev": ("SELECT ROUND(STDEV(l_quantity) * 10000) AS v FROM lineitem", "SELECT ROUND(stddev_pop(l_quantity) * 10000) AS v FROM lineitem"),
    "agg_count_distinct": ("SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem", None),
    "agg_sum_distinct": ("SELECT SUM(DISTINCT l_linenumber) AS n FROM lineitem", "SELECT CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem"),
    "agg_avg_distinct": ("SELECT AVG(DISTINCT l_linenumber) AS n FROM lineitem", None),
    "agg_count_distinct_star": ("SELECT COUNT(DISTINCT *) AS n FROM nation", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT * FROM nation)"),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", None),
    "agg_having_only": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 1", None),
    "agg_empty_input": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MAX(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0", None),
    "agg_expr_of_agg": ("SELECT l_linestatus, SUM(l_linenumber + 1) * 2 AS s FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, CAST(SUM(l_linenumber + 1) * 2 AS BIGINT) AS s FROM lineitem GROUP BY l_linestatus"),
    "agg_bare_column": ("SELECT o.o_custkey, c.c_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey", "SELECT o.o_custkey, any_value(c.c_name) AS c_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey"),
    "distinct_one": ("SELECT DISTINCT c_mktsegment FROM customer", None),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "order_by_multi_nulls": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 ORDER BY o.o_orderkey DESC, c.c_custkey LIMIT 50", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 ORDER BY o.o_orderkey DESC NULLS FIRST, c.c_custkey LIMIT 50"),
    "order_by_position": ("SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 5", None),
    "order_by_expr": ("SELECT n_nationkey FROM nation ORDER BY 0 - n_nationkey LIMIT 5", None),
    "order_by_alias": ("SELECT n_nationkey * 2 AS k FROM nation ORDER BY k DESC LIMIT 5", None),
    "limit": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", None),
    "offset": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "distinct_order_limit": ("SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey LIMIT 5", None),
    "values_inline": ("SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, 'y')) AS v", "SELECT CAST(a AS BIGINT) AS a, b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b)"),
    "series": ("SELECT N AS k FROM SERIES(100)", "SELECT CAST(range AS BIGINT) AS k FROM range(1, 101)"),
    "from_less_select": ("SELECT 1 + 2 AS a, 'x' || 'y' AS b", "SELECT CAST(3 AS BIGINT) AS a, 'xy' AS b"),
    "derived_nested": ("SELECT t.k AS k FROM (SELECT s.o_orderkey AS k FROM (SELECT o_orderkey FROM orders WHERE o_orderkey < 100) AS s WHERE s.o_orderkey > 50) AS t", None),
    "column_alias_positional": ("SELECT t.a AS a, t.b AS b FROM (SELECT r_regionkey, r_name FROM region) AS t(a, b)", None),
    "arith_mixed": ("SELECT l_orderkey, l_linenumber, l_linenumber * 2 + 1 AS a, l_quantity - l_tax AS b FROM lineitem WHERE l_orderkey < 500", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 2 + 1 AS BIGINT) AS a, l_quantity - l_tax AS b FROM lineitem WHERE l_orderkey < 500"),
    "int_div": ("SELECT o_orderkey, o_orderkey / 7 AS q, (0 - o_orderkey) / 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, (0 - o_orderkey) // 7 AS r FROM orders"),
    "modulo": ("SELECT o_orderkey, (0 - o_orderkey) % 7 AS r FROM orders", None),
    "unary_minus": ("SELECT -o_orderkey AS k FROM orders", None),
    "bit_and": ("SELECT o_orderkey, o_orderkey & 5 AS b FROM orders", None),
    "bit_shift": ("SELECT n_nationkey, CAST(n_nationkey AS INTEGER) << 2 AS l, CAST(n_nationkey AS INTEGER) >> 1 AS r FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) << 2 AS l, CAST(n_nationkey AS BIGINT) >> 1 AS r FROM nation"),
    "bit_not": ("SELECT o_orderkey, ~o_orderkey AS b FROM orders", None),
    "factorial": ("SELECT n_nationkey, CAST((n_nationkey % 10)! AS INTEGER) AS f FROM nation", "SELECT n_nationkey, CAST(factorial(n_nationkey % 10) AS BIGINT) AS f FROM nation"),
    "xor": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' XOR o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 100000)"),
    "concat_op": ("SELECT n_name || '-' || n_nationkey AS t FROM nation", None),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS t FROM nation", None),
    "cast_matrix": ("SELECT CAST('12' AS INTEGER) AS a, CAST('1.5' AS FLOAT) AS b, CAST(7 AS TEXT) AS c, CAST('2020-02-03' AS DATE) AS d, TRUE::TEXT AS e", "SELECT CAST(12 AS BIGINT) AS a, CAST(1.5 AS DOUBLE) AS b, '7' AS c, DATE '2020-02-03' AS d, 'true' AS e"),
    "interval_add": ("SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS d FROM orders", None),
    "strict_null_logic": ("SELECT CASE WHEN 3 NOT IN (1, NULL) THEN 'yes' ELSE 'no' END AS a, CASE WHEN NULL IN (1, 2) IS NULL THEN 'null' ELSE 'set' END AS b", "SELECT 'yes' AS a, 'null' AS b"),
    "fn_case": ("SELECT p_partkey, LOWER(p_type) AS a, UPPER(p_name) AS b, REVERSE(p_brand) AS c, LENGTH(p_name) AS d FROM part", None),
    "fn_initcap": ("SELECT INITCAP('h/i jk') AS a", "SELECT 'H/I Jk' AS a"),
    "fn_left_right": ("SELECT p_partkey, LEFT(p_name, 3) AS a, RIGHT(p_name, 4) AS b FROM part", None),
    "fn_pad": ("SELECT p_partkey, LPAD(p_brand, 12, '*') AS a, RPAD(p_brand, 4, '*') AS b FROM part", None),
    "fn_trim": ("SELECT TRIM(BOTH 'x' FROM 'xxaxx') AS a, LTRIM('  b') AS b, RTRIM('cxy', 'xy') AS c, TRIM(LEADING '0' FROM '007') AS d", "SELECT 'a' AS a, 'b' AS b, 'c' AS c, '7' AS d"),
    "fn_repeat_replace": ("SELECT n_nationkey, REPEAT(n_name, 2) AS a, REPLACE(n_name, 'A', '_') AS b FROM nation", None),
    "fn_substr": ("SELECT p_partkey, SUBSTR(p_name, 0, 3) AS a, SUBSTR(p_name, -1, 3) AS b, SUBSTR(p_name, 3) AS c FROM part", "SELECT p_partkey, substring(p_name, 1, 2) AS a, substring(p_name, 1, 1) AS b, substring(p_name, 3) AS c FROM part"),
    "fn_concat": ("SELECT n_nationkey, CONCAT(n_name, '/', n_nationkey) AS a, CONCAT_WS('-', n_name, NULL, 'z') AS b FROM nation", "SELECT n_nationkey, n_name || '/' || n_nationkey AS a, n_name || '-z' AS b FROM nation"),
    "fn_chars": ("SELECT CAST(ASCII('A') AS INTEGER) AS a, CHR(66) AS b, MD5('x') AS c, HEX(255) AS d, HEX('az') AS e", "SELECT CAST(65 AS BIGINT) AS a, 'B' AS b, md5('x') AS c, 'FF' AS d, '617A' AS e"),
    "fn_position": ("SELECT n_nationkey, CAST(POSITION('A' IN n_name) AS INTEGER) AS a, CAST(FIND_IDX(n_name, 'A', 2) AS INTEGER) AS b, CAST(POSITION('' IN n_name) AS INTEGER) AS c FROM nation", "SELECT n_nationkey, CAST(position('A' IN n_name) AS BIGINT) AS a, CASE WHEN position('A' IN substring(n_name, 2)) > 0 THEN CAST(position('A' IN substring(n_name, 2)) + 1 AS BIGINT) ELSE 0 END AS b, CAST(0 AS BIGINT) AS c FROM nation"),
    "fn_rounding": ("SELECT o_orderkey, ABS(0 - o_totalprice) AS a, CEIL(o_totalprice) AS b, FLOOR(o_totalprice) AS c, ROUND(o_totalprice) AS d, TRUNC(0 - o_totalprice) AS e, SIGN(o_totalprice) AS f FROM orders", "SELECT o_orderkey, abs(o_totalprice) AS a, ceil(o_totalprice) AS b, floor(o_totalprice) AS c, round(o_totalprice) AS d, trunc(-o_totalprice) AS e, sign(o_totalprice) AS f FROM orders"),
    "fn_logs": ("SELECT o_orderkey, ROUND(LN(o_orderkey) * 1000000) AS a, ROUND(LOG2(o_orderkey) * 1000000) AS b, ROUND(LOG10(o_orderkey) * 1000000) AS c, ROUND(LOG(o_orderkey, 3) * 1000000) AS d, ROUND(SQRT(o_orderkey) * 1000) AS e, ROUND(POWER(o_orderkey, 2)) AS f, ROUND(EXP(1) * 1000000) AS g FROM orders WHERE o_orderkey > 0", "SELECT o_orderkey, round(ln(o_orderkey) * 1000000) AS a, round(log2(o_orderkey) * 1000000) AS b, round(log10(o_orderkey) * 1000000) AS c, round(ln(o_orderkey) / ln(3) * 1000000) AS d, round(sqrt(o_orderkey) * 1000) AS e, round(power(CAST(o_orderkey AS DOUBLE), 2)) AS f, round(exp(1) * 1000000) AS g FROM orders WHERE o_orderkey > 0"),
    "fn_trig": ("SELECT n_nationkey, ROUND(SIN(n_nationkey) * 1000000) AS a, ROUND(COS(n_nationkey) * 1000000) AS b, ROUND(TAN(n_nationkey) * 1000) AS c, ROUND(ATAN(n_nationkey) * 1000000) AS d, ROUND(ASIN(n_nationkey / 100.0) * 1000000) AS e, ROUND(ACOS(n_nationkey / 100.0) * 1000000) AS f, ROUND(RADIANS(n_nationkey) * 1000000) AS g, ROUND(DEGREES(n_nationkey) * 1000) AS h, ROUND(PI() * 1000000) AS i FROM nation", "SELECT n_nationkey, round(sin(n_nationkey) * 1000000) AS a, round(cos(n_nationkey) * 1000000) AS b, round(tan(n_nationkey) * 1000) AS c, round(atan(n_nationkey) * 1000000) AS d, round(asin(n_nationkey / 100.0) * 1000000) AS e, round(acos(n_nationkey / 100.0) * 1000000) AS f, round(radians(n_nationkey) * 1000000) AS g, round(degrees(n_nationkey) * 1000) AS h, round(pi() * 1000000) AS i FROM nation"),
    "fn_integers": ("SELECT o_orderkey, DIV(o_orderkey, 4) AS a, MOD(o_orderkey, 4) AS b, GCD(o_orderkey, 12) AS c, LCM(o_orderkey, 12) AS d FROM orders", "SELECT o_orderkey, o_orderkey // 4 AS a, o_orderkey % 4 AS b, gcd(o_orderkey, 12) AS c, lcm(o_orderkey, 12) AS d FROM orders"),
    "fn_extract": ("SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d FROM orders", None),
    "fn_format_date": ("SELECT o_orderkey, FORMAT(o_orderdate, '%Y-%m-%d') AS a, LAST_DAY(o_orderdate) AS b FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, last_day(o_orderdate) AS b FROM orders"),
    "fn_parse_date": ("SELECT TO_DATE('2021/03/04', '%Y/%m/%d') AS a, ADD_MONTH('2021-01-31', 1) AS b", "SELECT DATE '2021-03-04' AS a, DATE '2021-02-28' AS b"),
    "fn_nulls": ("SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_discount, 0.0), -1.0) AS a, IFNULL(NULLIF(l_tax, 0.0), 9.0) AS b, GREATEST(l_discount, l_tax) AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0.0), -1.0) AS a, ifnull(nullif(l_tax, 0.0), 9.0) AS b, greatest(l_discount, l_tax) AS c FROM lineitem"),
    "fn_point": ("SELECT l_orderkey, l_linenumber, GET_X(POINT(l_quantity, l_tax)) AS x, GET_Y(POINT(l_quantity, l_tax)) AS y, ROUND(CALC_DISTANCE(POINT(l_quantity, 0.0), POINT(0.0, l_linenumber)) * 1000) AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_tax AS y, round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) * 1000) AS d FROM lineitem"),
    "fn_lists": ("SELECT p_partkey, CONCAT_WS(',', SORT(SPLIT(p_type, ' '))) AS a, CONCAT_WS(',', TAKE(SPLIT(p_type, ' '), 2)) AS b, CONCAT_WS(',', SKIP(SPLIT(p_type, ' '), 1)) AS c, SPLIT(p_type, ' ')[0] AS d, IS_EMPTY(SPLIT(p_type, ' ')) AS e, CONCAT_WS(',', APPEND(SPLIT(p_type, ' '), 'Z')) AS f, CONCAT_WS(',', PREPEND(SPLIT(p_type, ' '), 'A')) AS g FROM part", "SELECT p_partkey, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS a, array_to_string(string_split(p_type, ' ')[1:2], ',') AS b, array_to_string(string_split(p_type, ' ')[2:], ',') AS c, string_split(p_type, ' ')[1] AS d, false AS e, replace(p_type, ' ', ',') || ',Z' AS f, 'A,' || replace(p_type, ' ', ',') AS g FROM part"),
    "fn_list_edit": ("SELECT CONCAT_WS(',', DEDUP(ARRAY['1', '1', '2', '1'])) AS a, CONCAT_WS(',', SPLICE(ARRAY['a', 'b', 'c', 'd'], 1, 3, ARRAY['x'])) AS b, CONCAT_WS(',', SLICE(ARRAY['a', 'b', 'c', 'd'], -2, 2)) AS c, CONCAT_WS(',', SORT(ARRAY['b', 'a'], 'DESC')) AS d", "SELECT '1,2,1' AS a, 'a,x,d' AS b, 'c,d' AS c, 'b,a' AS d"),
    "fn_maps": ("SELECT event_id, MAP_OF_JSON(props)['k'] AS k, CONCAT_WS(',', KEYS(MAP_OF_JSON(props))) AS ks, CONCAT_WS(',', VALUES(MAP_OF_JSON(props))) AS vs, MAP_OF_JSON(props) -> 'zz' AS none FROM events", "SELECT event_id, props::JSON ->> 'k' AS k, 'k' AS ks, props::JSON ->> 'k' AS vs, CAST(NULL AS VARCHAR) AS none FROM events"),
    "strict_null_rows": ("SELECT l_orderkey, l_linenumber, (NULLIF(l_discount, 0.0) > 0.05 OR l_quantity > 25) IS NULL AS a, (NULLIF(l_discount, 0.0) > 0.05 AND l_quantity > 25) IS NULL AS b, l_quantity BETWEEN 10 AND NULLIF(l_linenumber, 1) IS NULL AS c FROM lineitem", "SELECT l_orderkey, l_linenumber, l_discount = 0.0 AS a, l_discount = 0.0 AS b, l_linenumber = 1 AS c FROM lineitem"),
    "strict_null_filter": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_discount, 0.0) > 0.05 OR l_quantity > 25", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0.0 AND (l_discount > 0.05 OR l_quantity > 25)"),
    "fn_list_type": ("SELECT o_orderkey, CONCAT_WS(',', APPEND(CAST('[3,1,' || o_orderkey || ']' AS LIST), 'z')) AS a, CONCAT_WS(',', TAKE(CAST('[3,1,' || o_orderkey || ']' AS LIST), 2)) AS b, LENGTH(CAST('[3,1,' || o_orderkey || ']' AS LIST)) AS c, IS_EMPTY(CAST('[]' AS LIST)) AS d, UNWRAP(CAST('{\"a\":[{\"b\":' || o_orderkey || '}]}' AS MAP), 'a.0.b') AS e FROM orders", "SELECT o_orderkey, '3,1,' || o_orderkey || ',z' AS a, '3,1' AS b, CAST(3 AS BIGINT) AS c, true AS d, CAST(o_orderkey AS VARCHAR) AS e FROM orders"),
    "fn_map_type": ("SELECT event_id, CONCAT_WS(',', KEYS(CAST(props AS MAP))) AS ks, CONCAT_WS(',', VALUES(CAST(props AS MAP))) AS vs, IS_EMPTY(CAST(props AS MAP)) AS e FROM events", "SELECT event_id, 'k' AS ks, props::JSON ->> 'k' AS vs, false AS e FROM events"),
    "distinct_map": ("SELECT UNWRAP(t.m, 'k') AS k FROM (SELECT DISTINCT CAST(props AS MAP) AS m FROM events) AS t", "SELECT DISTINCT props::JSON ->> 'k' AS k FROM events"),
    "fn_unwrap": ("SELECT event_id, UNWRAP(CAST(props AS MAP), 'k') AS k FROM events", "SELECT event_id, props::JSON ->> 'k' AS k FROM events"),
}


def text_query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).folder(sf_dir, *TABLES).query(text)

    return run


def params_bound(spark, sf_dir):
    return Engine(spark).folder(sf_dir, "orders").query("SELECT o_orderkey FROM orders WHERE o_orderkey < $1 AND o_orderstatus = $2", (500, "F"))


def schemaless_fields(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.parse_json("props").alias("_doc"))
    return Engine(spark).register("docs", docs).query("SELECT k AS k, missing AS missing FROM docs WHERE k IS NOT NULL")


def custom_function(spark, sf_dir):
    e = Engine(spark).folder(sf_dir, "orders")
    e.sql("CREATE FUNCTION net(p FLOAT, r FLOAT DEFAULT 0.5) RETURN p * (1.0 - r)")
    return e.query("SELECT o_orderkey, net(o_totalprice) AS a, net(o_totalprice, 0.25) AS b FROM orders")


def dml_round(spark, sf_dir):
    """CREATE TABLE AS, INSERT, UPDATE, DELETE and a rolled-back change over nation."""
    e = Engine(spark).folder(sf_dir, "nation")
    e.sql("CREATE TABLE copy AS SELECT * FROM nation; INSERT INTO copy SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1; UPDATE copy SET n_name = LOWER(n_name) WHERE n_regionkey = 2; DELETE FROM copy WHERE n_regionkey = 3; BEGIN; DELETE FROM copy; ROLLBACK")
    return e.query("SELECT * FROM copy")


QUERIES = {name: text_query(text) for name, (text, _) in Q.items()} | {f.__name__: f for f in (params_bound, schemaless_fields, custom_function, dml_round)}
ORACLE_SQL = {name: other or text for name, (text, other) in Q.items()} | {
    "params_bound": "SELECT o_orderkey FROM orders WHERE o_orderkey < 500 AND o_orderstatus = 'F'",
    "schemaless_fields": "SELECT props::JSON ->> 'k' AS k, CAST(NULL AS VARCHAR) AS missing FROM events WHERE props::JSON ->> 'k' IS NOT NULL",
    "custom_function": "SELECT o_orderkey, o_totalprice * (1.0 - 0.5) AS a, o_totalprice * (1.0 - 0.25) AS b FROM orders",
    "dml_round": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM (SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1) WHERE n_regionkey <> 3",
}
