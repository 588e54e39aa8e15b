"""Queries of the dialect with the SQL that checks them: name -> statements, checking SQL.

Each runs through the engine over whole tables; a LIMIT stands only where it is the feature. Where several
statements are given, the last one's result counts, and tables that they create live in a database of their own.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quern.engine import Database, connect
from quern.errors import QuernError

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@dataclass(frozen=True)
class Query:
    statements: tuple[str, ...]
    check: str
    params: tuple = ()


CATALOGUE: dict[str, Query] = {}


def _add(name: str, *statements: str, check: str | None = None, params: tuple = ()) -> None:
    """``check`` may be left out where the statement means the same in the checking dialect."""
    CATALOGUE[name] = Query(statements, check or statements[-1], params)


# Scans and projection.
_add("q_scan_project", "SELECT n_nationkey, n_name FROM nation", check="SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
_add("q_star_join_names", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
     check="SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_regionkey::BIGINT AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("q_star_qualified", "SELECT r.*, n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
     check="SELECT r_regionkey::BIGINT AS r_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_add("q_const_row", "SELECT 7 AS a, 'x' AS b, 2.5 AS d", check="SELECT CAST(7 AS BIGINT) AS a, 'x' AS b, 2.5::DOUBLE AS d")
_add("q_output_names", "SELECT n_name, COUNT(*), n_regionkey + 1, UPPER(n_name), n_name LIKE 'N%', CASE WHEN 1 THEN 2 END FROM nation n GROUP BY n_name, n_regionkey",
     check="""SELECT n_name, 1::BIGINT AS "COUNT(*)", n_regionkey::BIGINT + 1 AS "n_regionkey + 1", upper(n_name) AS "UPPER(n_name)", 1::BIGINT AS "n_name LIKE 'N%'", 2::BIGINT AS "CASE" FROM nation""")
_add("q_rowid_lookup", "CREATE TABLE t (x INTEGER, y TEXT)", "INSERT INTO t VALUES (10, 'a'), (20, 'b'), (30, 'c')", "DELETE FROM t WHERE x = 10", "SELECT rowid AS id, t.rowid + 0 AS same, x, y FROM t WHERE rowid = 2",
     check="SELECT 2::BIGINT AS id, 2::BIGINT AS same, 20::BIGINT AS x, 'b' AS y")
_add("q_params", "SELECT o_orderkey, ? AS mark FROM orders WHERE o_custkey < ? AND o_orderstatus = ?", check="SELECT o_orderkey, 'it''s' AS mark FROM orders WHERE o_custkey < 40 AND o_orderstatus = 'F'", params=("it's", 40, "F"))
_add("q_distinct", "SELECT DISTINCT p_brand, p_size FROM part", check="SELECT DISTINCT p_brand, p_size::BIGINT AS p_size FROM part")
_add("q_distinct_order_hidden", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 3", check="SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 3")

# Predicates. Every fifth size is made a NULL.
_X = "NULLIF(p_size % 5, 0)"
_add("q_filter_compare", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 30 AND p_brand <> 'Brand#11'")
_add("q_filter_kleene", f"SELECT p_partkey FROM part WHERE {_X} > 2 OR NOT ({_X} = 1 AND p_size > 20)")
_add("q_filter_truth", "SELECT p_partkey FROM part WHERE p_size % 5 AND NOT '0 parts'", check="SELECT p_partkey FROM part WHERE p_size % 5 <> 0")
_add("q_is_null", f"SELECT p_partkey, {_X} IS NULL AS none, {_X} IS NOT NULL AS some FROM part", check=f"SELECT p_partkey, ({_X} IS NULL)::BIGINT AS none, ({_X} IS NOT NULL)::BIGINT AS some FROM part")
_add("q_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("q_not_in_null", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
_add("q_in_empty", f"SELECT p_partkey, {_X} IN () AS a, {_X} NOT IN () AS b, p_size IN ({_X}, 7) AS c FROM part",
     check=f"SELECT p_partkey, CASE WHEN {_X} IS NOT NULL THEN 0 END::BIGINT AS a, CASE WHEN {_X} IS NOT NULL THEN 1 END::BIGINT AS b, (p_size IN ({_X}, 7))::BIGINT AS c FROM part")
_add("q_between", "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 1000 AND 1200")
_add("q_not_between_null", f"SELECT p_partkey FROM part WHERE p_size NOT BETWEEN {_X} AND 25", check=f"SELECT p_partkey FROM part WHERE NOT CASE WHEN {_X} IS NOT NULL THEN p_size BETWEEN {_X} AND 25 END")
_add("q_like_ci", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A_E%'", check="SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A_E%'")
_add("q_not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%STEEL%'", check="SELECT p_partkey FROM part WHERE p_type NOT ILIKE '%steel%'")
_add("q_like_column", "SELECT p_partkey, p_name LIKE '%' || SUBSTR(p_type, 1, 2) || '%' AS a, p_size LIKE '1%' AS b, '50%\\x' LIKE '50_\\X' AS c FROM part",
     check="SELECT p_partkey, contains(lower(p_name), lower(substr(p_type, 1, 2)))::BIGINT AS a, (p_size::VARCHAR LIKE '1%')::BIGINT AS b, 1::BIGINT AS c FROM part")
_add("q_is_distinct", f"SELECT p_partkey, {_X} IS 3 AS a, {_X} IS NOT NULLIF(p_size % 3, 0) AS b, p_size IS p_retailprice AS c, p_size IS p_size * 1.0 AS d FROM part",
     check=f"SELECT p_partkey, ({_X} IS NOT DISTINCT FROM 3)::BIGINT AS a, ({_X} IS DISTINCT FROM NULLIF(p_size % 3, 0))::BIGINT AS b, 0::BIGINT AS c, 0::BIGINT AS d FROM part")
_add("q_case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_add("q_case_simple_null", f"SELECT p_partkey, CASE {_X} WHEN NULL THEN 'none' WHEN 1 THEN 'one' ELSE 'more' END AS word FROM part",
     check=f"SELECT p_partkey, CASE WHEN {_X} IS NULL THEN 'none' WHEN {_X} = 1 THEN 'one' ELSE 'more' END AS word FROM part")
_add("q_cross_class_compare", f"SELECT p_partkey, {_X} = p_brand AS equal, {_X} < p_brand AS below, p_brand > 5 AS over, p_name = x'41' AS blob, p_name < x'00' AS low FROM part",
     check=f"SELECT p_partkey, CASE WHEN {_X} IS NOT NULL THEN 0 END::BIGINT AS equal, CASE WHEN {_X} IS NOT NULL THEN 1 END::BIGINT AS below, 1::BIGINT AS over, 0::BIGINT AS blob, 1::BIGINT AS low FROM part")
_add("q_chained_comparison", "SELECT p_partkey, 10 < p_size < 30 AS a, p_size = p_size = 1 AS b, 5 < 3 < 1 AS c FROM part",
     check="SELECT p_partkey, ((10 < p_size)::INT < 30)::BIGINT AS a, 1::BIGINT AS b, 1::BIGINT AS c FROM part")

# Joins.
_add("q_inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
_add("q_three_way_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_add("q_four_way_join", """SELECT r_name, COUNT(*) AS n, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, SUM(o_custkey) AS keys
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
     check="""SELECT r_name, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_custkey)::BIGINT AS keys
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")  # fmt: skip
_add("q_theta_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("q_theta_join", "SELECT a.n_name AS a, r_name AS b FROM nation a INNER JOIN region ON a.n_nationkey % 7 < r_regionkey")
_add("q_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("q_join_without_on", "SELECT r_name, n_name FROM region JOIN nation", check="SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("q_cross_join_on", "SELECT r_name, n_name FROM region CROSS JOIN nation ON r_regionkey = n_regionkey", check="SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
_add("q_left_join_count", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
_add("q_left_join_where_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL")
_add("q_left_join_true", "CREATE TABLE none (x INTEGER)", "SELECT r_name, x FROM region LEFT JOIN none", check="SELECT r_name, NULL::BIGINT AS x FROM region")

# Aggregates. Prices have two decimals: they are summed as whole cents, so that no order of summation shows.
_CENTS = "ROUND(l_extendedprice * 100)"
_AGGS = f"COUNT(*) AS n, SUM({_CENTS}) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, TOTAL(l_quantity) AS t, AVG(l_linenumber) AS a"
_AGGS_CHECK = "count(*) AS n, sum(round(l_extendedprice * 100)) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, coalesce(sum(l_quantity), 0.0)::DOUBLE AS t, avg(l_linenumber) AS a"
_add("q_agg_global", f"SELECT {_AGGS} FROM lineitem", check=f"SELECT {_AGGS_CHECK} FROM lineitem")
_add("q_agg_global_empty", f"SELECT {_AGGS}, l_returnflag AS bare FROM lineitem WHERE 1 = 0", check=f"SELECT {_AGGS_CHECK}, min(l_returnflag) AS bare FROM lineitem WHERE 1 = 0")
_add("q_agg_group_sum", f"SELECT l_returnflag, l_linestatus, {_AGGS} FROM lineitem GROUP BY l_returnflag, l_linestatus", check=f"SELECT l_returnflag, l_linestatus, {_AGGS_CHECK} FROM lineitem GROUP BY 1, 2")
_add("q_group_by_expr", "SELECT l_linenumber % 3 AS k, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber % 3", check="SELECT (l_linenumber % 3)::BIGINT AS k, count(*) AS n FROM lineitem GROUP BY 1")
_add("q_group_by_constant", "SELECT COUNT(*) AS n, MIN(n_name) AS lo FROM nation GROUP BY 1", check="SELECT count(*) AS n, min(n_name) AS lo FROM nation")
_add("q_group_null_key", f"SELECT {_X} AS x, COUNT(*) AS n FROM part GROUP BY {_X}", check=f"SELECT ({_X})::BIGINT AS x, count(*) AS n FROM part GROUP BY 1")
_add("q_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_add("q_having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 440000 AND o_custkey % 2 = 0")
_add("q_order_by_agg", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
_add("q_order_by_hidden_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY SUM(o_orderkey) DESC, o_custkey LIMIT 10")
_add("q_bare_column", "SELECT o_custkey, o_orderpriority AS first_priority FROM orders GROUP BY o_custkey", check="SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey")
_add("q_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
_add("q_sum_distinct", "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", check="SELECT l_returnflag, sum(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem GROUP BY 1")
_add("q_avg_distinct", "SELECT l_returnflag, AVG(DISTINCT l_linenumber) AS a, TOTAL(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY l_returnflag",
     check="SELECT l_returnflag, avg(DISTINCT l_linenumber) AS a, sum(DISTINCT l_linenumber)::DOUBLE AS t FROM lineitem GROUP BY 1")
_add("q_avg", "SELECT o_orderstatus, AVG(o_custkey) AS a, AVG(NULLIF(o_custkey % 3, 0)) AS b FROM orders GROUP BY o_orderstatus", check="SELECT o_orderstatus, avg(o_custkey) AS a, avg(NULLIF(o_custkey % 3, 0)) AS b FROM orders GROUP BY 1")
_add("q_total", "SELECT TOTAL(p_size) AS t, TOTAL(CASE WHEN p_size < 0 THEN p_size END) AS none FROM part", check="SELECT coalesce(sum(p_size::DOUBLE), 0.0) AS t, coalesce(sum(p_size::DOUBLE) FILTER (p_size < 0), 0.0) AS none FROM part")
_add("q_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name) AS names, GROUP_CONCAT(n_nationkey / 2.0, '; ') AS halves FROM nation GROUP BY n_regionkey",
     check="SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(format('{:g}', n_nationkey / 2.0), '; ' ORDER BY n_nationkey) AS halves FROM nation GROUP BY 1")
_add("q_group_concat_distinct", "SELECT GROUP_CONCAT(DISTINCT n_regionkey) AS keys, GROUP_CONCAT(DISTINCT 'k') AS one FROM nation",
     check="SELECT string_agg(k, ',' ORDER BY o) AS keys, 'k' AS one FROM (SELECT n_regionkey::VARCHAR AS k, min(n_nationkey) AS o FROM nation GROUP BY 1)")

# Order and limits.
_add("q_sort_nulls", f"SELECT p_partkey, {_X} AS x FROM part ORDER BY x, p_partkey LIMIT 20", check=f"SELECT p_partkey, ({_X})::BIGINT AS x FROM part ORDER BY x NULLS FIRST, p_partkey LIMIT 20")
_add("q_sort_nulls_last", f"SELECT p_partkey, {_X} AS x FROM part ORDER BY x DESC, p_partkey LIMIT 20 OFFSET 300", check=f"SELECT p_partkey, ({_X})::BIGINT AS x FROM part ORDER BY x DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 300")
_add("q_sort_stable", "SELECT p_partkey FROM part ORDER BY p_size LIMIT 50", check="SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 50")
_add("q_sort_ordinal", "SELECT p_brand, p_partkey FROM part ORDER BY 1 DESC, 2 LIMIT 20")
_add("q_sort_alias_shadow", "SELECT -p_size AS p_size, p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 20", check="SELECT -part.p_size::BIGINT AS p_size, p_partkey FROM part ORDER BY part.p_size, p_partkey LIMIT 20")
_add("q_sort_alias", "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, -p_partkey LIMIT 20", check="SELECT p_partkey, p_size::BIGINT * 2 AS twice FROM part ORDER BY twice DESC, -p_partkey LIMIT 20")
_add("q_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_add("q_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11")
_add("q_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 11, 3 + 4", check="SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 11")
_add("q_limit_scan_order", "SELECT o_orderkey FROM orders LIMIT 5", check="SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
_add("q_limit_null", "SELECT n_name FROM nation LIMIT NULL", check="SELECT n_name FROM nation")
_add("q_limit_negative", "SELECT n_name FROM nation ORDER BY n_name LIMIT -1 OFFSET 20", check="SELECT n_name FROM nation ORDER BY n_name OFFSET 20")

# Arithmetic, text forms, literals.
_add("q_arithmetic", f"SELECT p_partkey, p_size + 1.5 AS a, p_size - {_X} AS b, p_size * p_size AS c, '7' + p_size AS d, '2.5x' * p_size AS e, p_name + 1 AS f, 1 + (p_size > 20) AS g FROM part",
     check=f"SELECT p_partkey, p_size + 1.5::DOUBLE AS a, (p_size - {_X})::BIGINT AS b, (p_size * p_size)::BIGINT AS c, (7 + p_size)::DOUBLE AS d, (2 * p_size)::DOUBLE AS e, 1::DOUBLE AS f, CASE WHEN p_size > 20 THEN 2 ELSE 1 END::BIGINT AS g FROM part")
_add("q_int_div", "SELECT p_partkey, (p_size - 25) / (p_size % 4) AS q FROM part", check="SELECT p_partkey, ((p_size - 25) // NULLIF(p_size % 4, 0))::BIGINT AS q FROM part")
_add("q_mod", "SELECT p_partkey, (p_size - 25) % (p_size % 4) AS m, (p_size - 25.5) % 4 AS r FROM part", check="SELECT p_partkey, ((p_size - 25) % NULLIF(p_size % 4, 0))::BIGINT AS m, (p_size - 25.5::DOUBLE) % 4 AS r FROM part")
_add("q_div_zero", "SELECT p_partkey, p_retailprice / (p_size % 2) AS d FROM part", check="SELECT p_partkey, p_retailprice / NULLIF(p_size % 2, 0) AS d FROM part")
_add("q_unary", "SELECT p_partkey, -p_size AS a, - -p_size AS b, +p_brand AS c, -'12 apples' AS d FROM part", check="SELECT p_partkey, -p_size::BIGINT AS a, p_size::BIGINT AS b, p_brand AS c, -12::DOUBLE AS d FROM part")
_add("q_precedence", "SELECT 2 + 3 * 4 AS a, 'n' || 1 + 2 AS b, NOT 1 = 2 AS c, 1 OR 0 AND 0 AS d, -2 * 3 AS e, 7 - 3 - 2 AS f, 1 < 2 = 1 AS g, 2 BETWEEN 1 AND 3 AND 0 AS h",
     check="SELECT 14::BIGINT AS a, 'n3' AS b, 1::BIGINT AS c, 1::BIGINT AS d, -6::BIGINT AS e, 2::BIGINT AS f, 1::BIGINT AS g, 0::BIGINT AS h")
_add("q_literals", "SELECT 1.5e2 AS a, .5 AS b, 5. AS c, 'it''s' AS d, HEX(x'00fF') AS e, NULL AS f, 42 AS g, 'a\\tb' AS h",
     check="SELECT 150.0::DOUBLE AS a, 0.5::DOUBLE AS b, 5.0::DOUBLE AS c, 'it''s' AS d, '00FF' AS e, NULL::VARCHAR AS f, 42::BIGINT AS g, 'a\\tb' AS h")
_add("q_quoting", 'SELECT "n_name" AS [the name], `n_regionkey` AS "key" -- a comment\nFROM "nation" /* another ; one */ WHERE [n_nationkey] < 3', check='SELECT n_name AS "the name", n_regionkey::BIGINT AS "key" FROM nation WHERE n_nationkey < 3')
_add("q_concat_format", "SELECT p_partkey, p_brand || ':' || p_retailprice AS s, p_size || x'41' || (p_size > 20) AS t FROM part",
     check="SELECT p_partkey, p_brand || ':' || CASE WHEN p_retailprice = trunc(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS s, p_size || 'A' || (p_size > 20)::INT AS t FROM part")
# Sizes of which no power of ten is lost in a double.
_add("q_text_of_reals", "SELECT p_partkey, (p_size + 0.5) * 1000000.0 + 0.25 || '' AS big, (p_size + 0.5) / 1024 / 1024 || '' AS small, p_size * 1e15 || '' AS whole, p_size * 1e16 || '' AS wide FROM part WHERE p_size > 0",
     check="""SELECT p_partkey, ((p_size + 0.5::DOUBLE) * 1000000 + 0.25)::VARCHAR AS big, CASE WHEN v >= 1e-4 THEN v::VARCHAR ELSE regexp_replace(regexp_replace(format('{:.17e}', v), '^.*$', v::VARCHAR), 'e-([0-9])$', 'e-0\\1') END AS small,
CASE WHEN p_size * 1e15::DOUBLE < 1e16::DOUBLE THEN (p_size * 1e15::DOUBLE)::BIGINT::VARCHAR ELSE w15 END AS whole, w16 AS wide
FROM (SELECT *, (p_size + 0.5::DOUBLE) / 1024 / 1024 AS v, mant(p_size) || 'e+' || (15 + length(p_size::VARCHAR) - 1) AS w15, mant(p_size) || 'e+' || (16 + length(p_size::VARCHAR) - 1) AS w16 FROM part WHERE p_size > 0)""".replace(
         "mant(p_size)", "regexp_replace(left(p_size::VARCHAR, 1) || '.' || rtrim(substr(p_size::VARCHAR, 2), '0'), '\\.$', '')"))
_add("q_scalar_min_max", f"SELECT p_partkey, MIN({_X}, p_size, 3) AS lo, MAX({_X}, p_size, 3) AS hi, MAX('a', 7) AS t FROM part",
     check=f"SELECT p_partkey, CASE WHEN {_X} IS NOT NULL THEN least({_X}, p_size, 3) END::BIGINT AS lo, CASE WHEN {_X} IS NOT NULL THEN greatest({_X}, p_size, 3) END::BIGINT AS hi, 'a' AS t FROM part")
_add("q_round_half_away", "SELECT p_partkey, ROUND(p_size / 8.0, 2) AS a, ROUND((p_size - 25) / 2.0) AS b, ROUND(p_size, -2) AS c FROM part",
     check="SELECT p_partkey, round(p_size / 8.0::DOUBLE, 2) AS a, round((p_size - 25) / 2.0::DOUBLE) AS b, p_size::DOUBLE AS c FROM part")
# Exact decimals of a double round half to even in format(); only true ties, odd eighths and quarters, are moved up before.
_add("q_round_half_away_real", "SELECT p_partkey, ROUND(p_retailprice / 1000.0, 2) AS a, ROUND(p_retailprice, 1) AS b, ROUND(65.205, 2) AS c, ROUND(2.675, 2) AS d FROM part",
     check="""SELECT p_partkey, format('{:.2f}', x + CASE WHEN (x * 8) % 2 = 1 THEN 0.001 ELSE 0 END)::DOUBLE AS a, format('{:.1f}', y + CASE WHEN (y * 4) % 2 = 1 THEN 0.01 ELSE 0 END)::DOUBLE AS b, 65.2::DOUBLE AS c, 2.67::DOUBLE AS d
FROM (SELECT p_partkey, p_retailprice / 1000.0::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part)""")  # fmt: skip

# Scalar functions.
_FUNCTIONS = {
    "abs": ("part", "p_partkey", "ABS(p_size - 25)", "abs(p_size - 25)::BIGINT"),
    "length": ("part", "p_partkey", "LENGTH(p_name)", "length(p_name)::BIGINT"),
    "length_other": ("part", "p_partkey", "LENGTH(p_size) || LENGTH(x'00ff41')", "length(p_size::VARCHAR) || '3'"),
    "upper": ("part", "p_partkey", "UPPER(p_name)", "upper(p_name)"),
    "lower": ("part", "p_partkey", "LOWER(p_brand)", "lower(p_brand)"),
    "substr": ("part", "p_partkey", "SUBSTR(p_name, 3, 4)", "substr(p_name, 3, 4)"),
    "substr_end": ("part", "p_partkey", "SUBSTRING(p_name, -3)", "right(p_name, 3)"),
    "substr_edges": ("part", "p_partkey", "SUBSTR('abc', -5, 3) || SUBSTR('abcdef', 3, -2) || SUBSTR(p_brand, 0, 2) || SUBSTR(p_brand, p_size % 3, 1)", "'abcab' || left(p_brand, 2) || substr(p_brand, greatest(p_size % 3, 1), 1)"),
    "coalesce": ("part", "p_partkey", f"COALESCE({_X}, p_size)", f"coalesce({_X}, p_size)::BIGINT"),
    "ifnull": ("part", "p_partkey", f"IFNULL({_X}, -1)", f"ifnull({_X}, -1)::BIGINT"),
    "nullif": ("part", "p_partkey", "NULLIF(p_size, 7)", "nullif(p_size, 7)::BIGINT"),
    "trim": ("nation", "n_nationkey", "TRIM('  ' || n_name || ' ') || TRIM('xyx' || n_name || 'y', 'xy')", "n_name || n_name"),
    "ltrim": ("nation", "n_nationkey", "LTRIM(n_name, 'AEN')", "ltrim(n_name, 'AEN')"),
    "rtrim": ("nation", "n_nationkey", "RTRIM(n_name, '0123456789')", "rtrim(n_name, '0123456789')"),
    "replace": ("part", "p_partkey", "REPLACE(p_brand, 'Brand', 'B')", "replace(p_brand, 'Brand', 'B')"),
    "instr": ("part", "p_partkey", "INSTR(p_name, 'a')", "instr(p_name, 'a')::BIGINT"),
    "typeof": ("part", "p_partkey", f"TYPEOF({_X}) || TYPEOF(1.0) || TYPEOF(p_name) || TYPEOF(x'00') || TYPEOF(p_size > 3)", f"CASE WHEN {_X} IS NULL THEN 'null' ELSE 'integer' END || 'realtextblobinteger'"),
    "hex": ("nation", "n_nationkey", "HEX(n_name)", "hex(n_name)"),
    "hex_number": ("part", "p_partkey", "HEX(p_size)", "hex(p_size::VARCHAR)"),
}
for _name, (_table, _key, _value, _check) in _FUNCTIONS.items():
    _add(f"q_fn_{_name}", f"SELECT {_key}, {_value} AS v FROM {_table}", check=f"SELECT {_key}{'::BIGINT AS n_nationkey' if _table == 'nation' else ''}, {_check} AS v FROM {_table}")

# Columns without a type.
_ANY = ("CREATE TABLE m (k INTEGER, v)", "INSERT INTO m VALUES (1, 2), (2, 'b'), (3, NULL), (4, 1.5), (5, 'a'), (6, x'00'), (7, 2.0), (8, '10')")
_add("q_any_order", *_ANY, "SELECT k, TYPEOF(v) AS kind FROM m WHERE v < 'b' OR v IS NULL OR v >= 'b' ORDER BY v LIMIT 7", check="SELECT * FROM (VALUES (3::BIGINT, 'null'), (4, 'real'), (1, 'integer'), (7, 'real'), (8, 'text'), (5, 'text'), (2, 'text')) t(k, kind)")
_add("q_any_group", *_ANY, "SELECT TYPEOF(v) AS kind, COUNT(*) AS n, COUNT(DISTINCT v) AS d, TOTAL(v) AS t FROM m WHERE v = 2 OR TYPEOF(v) = 'text' GROUP BY TYPEOF(v)",
     check="SELECT * FROM (VALUES ('integer', 1::BIGINT, 1::BIGINT, 2.0::DOUBLE), ('text', 3, 3, 10.0), ('real', 1, 1, 2.0)) t(kind, n, d, t)")
_add("q_any_mixed_case", "SELECT p_partkey, TYPEOF(CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 1.5 ELSE 'x' END) AS kind, COALESCE(NULLIF(p_size % 3, 0), p_retailprice) > 2.5 AS over FROM part",
     check="SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'real' ELSE 'text' END AS kind, (p_size % 3 = 0)::BIGINT AS over FROM part")

# Statements that change tables.
_ORDERS = ("CREATE TABLE o (id INTEGER PRIMARY KEY, status TEXT NOT NULL, price REAL, day TEXT)", "CREATE INDEX o_price ON o (price)", "INSERT INTO o SELECT o_orderkey, o_orderstatus, o_totalprice, NULL FROM orders")
_add("q_pk_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100")
_add("q_index_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
_add("q_index_seek", *_ORDERS, "CREATE INDEX o_status ON o (status, id)", "SELECT id, price FROM o WHERE status = 'F' AND id = 100 OR price BETWEEN 100000 AND 110000", check="SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = 100 OR o_totalprice BETWEEN 100000 AND 110000")
_add("q_insert_values", "CREATE TABLE t (a INTEGER, b TEXT DEFAULT 'none', c REAL DEFAULT 1.5, d BLOB)", "INSERT INTO t VALUES ('42', 19, 7, 'bytes'), (1.0, 1.5, '2.5', x'00')", "INSERT INTO t (d, a) VALUES (NULL, 3 + 4)",
     "SELECT a, b, c, HEX(d) AS d FROM t", check="SELECT * FROM (VALUES (42::BIGINT, '19', 7.0::DOUBLE, '6279746573'), (1, '1.5', 2.5, '00'), (7, 'none', 1.5, NULL)) t(a, b, c, d)")
_add("q_insert_select", *_ORDERS, "INSERT INTO o (id, status) SELECT id + 1000000, status FROM o WHERE status = 'O'", "SELECT id, price FROM o",
     check="SELECT o_orderkey AS id, o_totalprice AS price FROM orders UNION ALL SELECT o_orderkey + 1000000, NULL FROM orders WHERE o_orderstatus = 'O'")
_add("q_update_effect", *_ORDERS, "UPDATE o SET price = price + 1, day = status || id WHERE status = 'F'", "UPDATE o SET id = id + 1", "SELECT id, price, day FROM o",
     check="SELECT o_orderkey + 1 AS id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || o_orderkey END AS day FROM orders")
_add("q_delete_effect", *_ORDERS, "DELETE FROM o WHERE NULLIF(id % 5, 0) = 1 OR price > 300000", "SELECT id FROM o", check="SELECT o_orderkey AS id FROM orders WHERE NOT (coalesce(NULLIF(o_orderkey % 5, 0) = 1, FALSE) OR o_totalprice > 300000)")
_add("q_rollback", *_ORDERS, "BEGIN", "DELETE FROM o", "DROP TABLE o", "CREATE TABLE p (x)", "ROLLBACK TRANSACTION", "BEGIN", "UPDATE o SET day = 'x' WHERE id < 100", "INSERT INTO o VALUES (-1, 'N', 0, 'y')", "COMMIT", "SELECT id, day FROM o",
     check="SELECT o_orderkey AS id, CASE WHEN o_orderkey < 100 THEN 'x' END AS day FROM orders UNION ALL SELECT -1, 'y'")
_add("q_unique_violations", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
     check="SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
_add("q_drop_and_create", "CREATE TABLE t (a)", "CREATE TABLE IF NOT EXISTS t (b)", "CREATE UNIQUE INDEX i ON t (a)", "DROP INDEX i", "DROP INDEX IF EXISTS i", "DROP TABLE t", "DROP TABLE IF EXISTS t",
     "CREATE TABLE t (b INTEGER, c INTEGER, PRIMARY KEY (b, c))", "INSERT INTO t VALUES (1, 1), (1, 2)", "SELECT b, c FROM t", check="SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (1, 2)) t(b, c)")
_add("q_explain", "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)", "EXPLAIN SELECT DISTINCT x.b FROM t x LEFT JOIN nation n ON n_nationkey = x.a WHERE x.a = 1 ORDER BY 1 LIMIT 1",
     check="SELECT unnest(['SCAN t USING INDEX t_pkey (a=?)', 'LEFT JOIN nation (full table scan)', 'DISTINCT (hash)', 'ORDER BY (sort)', 'LIMIT']) AS detail")

#: Statements that must fail, on tables that q_errors makes: (statement, the error's class).
FAILURES = (
    ("SELECT 1 +", "ParseError"), ("SELECT 'open", "ParseError"), ("SELECT * FROM nothing", "SchemaError"), ("SELECT nope FROM t", "SchemaError"), ("SELECT a FROM t JOIN t u ON 1", "SchemaError"),
    ("SELECT a FROM t JOIN t ON 1", "SchemaError"), ("SELECT z.* FROM t", "SchemaError"), ("SELECT t.a FROM t JOIN t u ON u.a = v.a JOIN t v ON 1", "SchemaError"), ("SELECT SUM(*) FROM t", "SchemaError"),
    ("SELECT a FROM t WHERE COUNT(*) > 1", "SchemaError"), ("SELECT SUM(MAX(a)) FROM t", "SchemaError"), ("SELECT NOSUCH(1)", "QuernError"), ("SELECT ABS(1, 2)", "QuernError"), ("SELECT ?", "QuernError"),
    ("SELECT a FROM t ORDER BY 2", "SchemaError"), ("SELECT a FROM t HAVING 1", "ParseError"), ("SELECT a FROM t OFFSET 1", "ParseError"), ("CREATE TABLE t (a)", "SchemaError"), ("CREATE TABLE u (a, A)", "SchemaError"),
    ("CREATE TABLE u (rowid INTEGER)", "SchemaError"), ("CREATE TABLE u (a DATE)", "TypeMismatchError"), ("CREATE INDEX i ON t (nope)", "SchemaError"), ("DROP INDEX t_pkey", "SchemaError"), ("DROP TABLE nothing", "SchemaError"),
    ("INSERT INTO t VALUES (1)", "QuernError"), ("INSERT INTO t (a, a) VALUES (2, 3)", "SchemaError"), ("INSERT INTO t VALUES (1, 'again')", "IntegrityError"), ("INSERT INTO t VALUES (NULL, 'x')", "IntegrityError"),
    ("INSERT INTO t VALUES ('two', 'x')", "TypeMismatchError"), ("INSERT INTO t VALUES (2, x'00')", "TypeMismatchError"), ("UPDATE t SET a = 'x'", "TypeMismatchError"), ("UPDATE t SET a = 5", "IntegrityError"),
    ("INSERT INTO t SELECT a, b FROM t", "IntegrityError"), ("INSERT INTO nation VALUES (1)", "SchemaError"), ("COMMIT", "TransactionError"), ("ROLLBACK", "TransactionError"), ("BEGIN; BEGIN", "TransactionError"),
)


def database(spark: SparkSession, sf_dir: str) -> Database:
    """A database of its own with the tables of ``sf_dir``; deleted at exit, for results are read later."""
    db = connect(":memory:", spark)
    atexit.register(_close, db)
    for name in TABLES:
        db.register(name, f"{sf_dir}/{name}.parquet")
    return db


def _close(db: Database) -> None:
    try:
        db.close()
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


_open: dict[tuple[str, str], Database] = {}


def _shared(spark: SparkSession, sf_dir: str) -> Database:
    """The open database of a folder for queries that change nothing: its tables' footers are read once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open.clear()
        _open[key] = database(spark, sf_dir)
    return _open[key]


def _run(query: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir) if len(query.statements) > 1 else _shared(spark, sf_dir)
    for statement in query.statements[:-1]:
        db.execute(statement)
    result = db.execute(query.statements[-1], query.params)
    return spark.createDataFrame(result.rows, result.columns) if result.df is None else result.df


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of FAILURES with the class of the error that each raises, and what the table holds after them."""
    db = database(spark, sf_dir)
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT); INSERT INTO t VALUES (1, 'one'), (3, 'three')")
    rows = []
    for statement, _ in FAILURES:
        try:
            db.execute(statement)
            rows.append((statement, "none"))
        except QuernError as error:
            rows.append((statement, type(error).__name__))
    if db.in_transaction:
        db.rollback()
    return spark.createDataFrame([*rows, ("rows", str(db.query("SELECT a, b FROM t ORDER BY a")))], "statement string, error string")


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a table as ``schema()`` describes them."""
    db = database(spark, sf_dir)
    db.execute("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10) NOT NULL DEFAULT 'x', c, UNIQUE (b, c)); CREATE INDEX i ON t (c)")
    described = db.schema()[0]
    rows = [(c["name"], c["type"], c["not_null"], c["primary_key"], c["default"]) for c in described["columns"]]
    rows += [(i["name"], ", ".join(i["columns"]), i["unique"], i["origin"] == "PRIMARY KEY", i["origin"]) for i in described["indexes"]]
    return spark.createDataFrame(rows, "name string, type string, strict boolean, primary_key boolean, note string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, query) for name, query in CATALOGUE.items()} | {"q_errors": errors, "q_schema": schema}


def oracle_sql() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    failures = ", ".join(f"({quoted(s)}, {quoted(e)})" for s, e in [*FAILURES, ("rows", "[(1, 'one'), (3, 'three')]")])
    described = "('a', 'INTEGER', true, true, NULL), ('b', 'TEXT', true, false, 'x'), ('c', 'ANY', false, false, NULL), ('sqlite_autoindex_t_1', 'b, c', true, false, 'UNIQUE'), ('t_pkey', 'a', true, true, 'PRIMARY KEY'), ('i', 'c', false, false, 'CREATE INDEX')"
    return {name: query.check for name, query in CATALOGUE.items()} | {
        "q_errors": f"SELECT * FROM (VALUES {failures}) t(statement, error)",
        "q_schema": f"SELECT * FROM (VALUES {described}) t(name, type, strict, primary_key, note)",
    }
