"""The relational surface: joins, grouping sets, windows, set operations, subqueries and function families.

A text names its tables in braces; ``folioframe.plans.sqltools.run`` binds them to Parquet scans, so Catalyst sees plain
relations and pushes filters and columns into them. Where both engines read the same text it is written once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioframe.plans.sqltools import run
from folioframe.session import table

_BOTH = {
    # joins
    "rel_join_inner": "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM {customer} JOIN {orders} ON c_custkey = o_custkey WHERE o_totalprice > 300000",
    "rel_join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "rel_join_right": "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "rel_join_full": """SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_nationkey < 15 GROUP BY c_nationkey) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.k = b.k""",
    "rel_join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation} WHERE n_nationkey < 5",
    "rel_join_theta": """SELECT a.p_partkey AS part, count(*) AS cheaper FROM (SELECT * FROM {part} WHERE p_size = 1) a
JOIN (SELECT * FROM {part} WHERE p_size = 2) b ON a.p_brand = b.p_brand AND a.p_retailprice > b.p_retailprice GROUP BY a.p_partkey""",
    "rel_join_null_safe": """SELECT count(*) AS n FROM {entities} e JOIN (SELECT DISTINCT chunk_id FROM {entities} WHERE entity_type = 'Person' OR chunk_id IS NULL) k
ON e.chunk_id IS NOT DISTINCT FROM k.chunk_id""",
    # aggregation
    "agg_group": """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(avg(l_discount), 6) AS avg_disc,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
    "agg_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT user_id, CAST(value AS INT)) AS pairs FROM {events} GROUP BY event_type",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_rollup": "SELECT p_brand, p_type, count(*) AS n, round(max(p_retailprice), 2) AS top FROM {part} GROUP BY ROLLUP (p_brand, p_type)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "agg_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 15",
    "agg_filter": "SELECT l_shipdate IS NULL AS unshipped, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_tax > 0.04) AS taxed FROM {lineitem} GROUP BY 1",
    "agg_moments": "SELECT p_brand, round(var_pop(p_retailprice), 4) AS vp, round(stddev_samp(p_retailprice), 4) AS ss, round(corr(p_retailprice, p_size), 6) AS c FROM {part} GROUP BY p_brand",
    "agg_median": "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m FROM {customer} GROUP BY c_mktsegment",
    "agg_bool": "SELECT o_orderpriority, bool_or(o_totalprice > 400000) AS any_big, bool_and(o_totalprice > 1000) AS all_big FROM {orders} GROUP BY o_orderpriority",
    "agg_arg": "SELECT o_orderpriority, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM {orders} GROUP BY o_orderpriority",
    # windows
    "win_rank": """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n
FROM {orders} WHERE o_orderstatus = 'P' WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)""",
    "win_lag_lead": """SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(value) OVER w AS first
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win_frame_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS s FROM {events}",
    "win_frame_range": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}""",
    "win_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 6) AS c FROM {customer}",
    "win_running_total": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM {orders}",
    # set operations
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_union_all": "SELECT o_orderstatus AS k, count(*) AS n FROM {orders} GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM {lineitem} GROUP BY 1",
    "set_intersect": "SELECT l_partkey AS k FROM {lineitem} WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A'",
    "set_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "set_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    # subqueries and common table expressions
    "sub_correlated": "SELECT p_partkey, p_retailprice FROM {part} p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)",
    "sub_exists": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)",
    "sub_not_in": "SELECT s_suppkey FROM {supplier} WHERE s_suppkey NOT IN (SELECT l_suppkey FROM {lineitem} WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07 AND l_suppkey IS NOT NULL)",
    "sub_scalar": "SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM {orders}), 6) AS relative FROM {orders} WHERE o_orderstatus = 'P'",
    "cte_recursive": """WITH RECURSIVE up(id, ancestor, d) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM {nation} UNION ALL SELECT id, ancestor - 3, d + 1 FROM up WHERE ancestor >= 3)
SELECT id, count(*) AS steps, max(d) AS depth FROM up GROUP BY id""",
    "sub_lateral": """SELECT r_name, x.n_name FROM {region} r CROSS JOIN LATERAL (SELECT n_name FROM {nation} n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_nationkey LIMIT 2) x""",
    "page_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    # scalar function families
    "fn_string": """SELECT p_partkey, concat_ws('|', p_brand, p_type) AS c, upper(left(p_name, 4)) AS l, right(p_type, 3) AS r, replace(p_brand, '#', '') AS rep, translate(p_type, 'AEIOU', 'aeiou') AS t,
split_part(p_name, ' ', 1) AS s, lpad(CAST(p_size AS STRING), 4, '0') AS lp, rpad(p_brand, 12, '.') AS rp, instr(p_name, 'a') AS i, length(p_name) AS n, reverse(p_brand) AS rev,
repeat('x', p_size % 4) AS x, p_name LIKE 'P%' AS sw, contains(p_type, 'EL') AS ct, levenshtein(p_brand, 'Brand#11') AS lev, trim(concat(' ', p_brand, ' ')) AS tr,
substring(p_name, 2, 3) AS sub, lower(p_type) AS low, ascii(p_name) AS a, ltrim(concat('  ', p_brand)) AS lt FROM {part}""",
    "fn_math": """SELECT p_partkey, round(p_retailprice, 1) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, abs(p_size - 25) AS a, round(power(p_size, 2), 4) AS p, round(sqrt(p_size), 8) AS s,
round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS l10, round(exp(p_size / 50.0), 8) AS e, p_size % 7 AS m, CAST(sign(p_size - 25) AS INT) AS sg, greatest(p_size, 20) AS g, least(p_size, 20) AS le,
round(sin(p_size), 8) AS si, round(atan2(p_size, 3), 8) AS at2, p_size & 6 AS band, p_size | 1 AS bor, round(degrees(radians(p_size)), 6) AS deg, round(cbrt(p_size), 8) AS cb FROM {part}""",
    "fn_null": "SELECT doc_id, coalesce(source, 'none') AS s, nullif(lang, 'en') AS l, CASE WHEN heading IS NULL THEN 0 WHEN length(heading) > 20 THEN 2 ELSE 1 END AS h, ifnull(file_path, '') AS f FROM {documents}",
    "fn_date": """SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(o_orderdate AS DATE) AS d, extract(YEAR FROM o_orderdate) AS y, extract(QUARTER FROM o_orderdate) AS q,
last_day(CAST(o_orderdate AS DATE)) AS ld, o_orderdate + INTERVAL '1' DAY AS nx, make_date(2024, 1, CAST(o_orderkey % 28 + 1 AS INT)) AS md, dayofyear(o_orderdate) AS doy FROM {orders}""",
}

#: (Spark text, DuckDB text) where the dialects differ.
_PAIRS = {
    "rel_join_semi": ("SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'",
                      "SELECT c_custkey FROM {customer} SEMI JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'"),
    "rel_join_anti": ("SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM {orders} ANTI JOIN {lineitem} ON o_orderkey = l_orderkey"),
    "agg_ordered_list": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM {nation} GROUP BY n_regionkey",
                         "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM {nation} GROUP BY n_regionkey"),
    "agg_percentile": ("SELECT o_orderstatus, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM {orders} GROUP BY o_orderstatus",
                       "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM {orders} GROUP BY o_orderstatus"),
    "win_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 2",
                    "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "win_ffill": ("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {events}""",
                  """SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {events}"""),
    "fn_array": ("""SELECT id, size(split(breadcrumbs, ' > ')) AS n, array_join(transform(split(breadcrumbs, ' > '), x -> upper(x)), '/') AS up, array_contains(split(breadcrumbs, ' > '), 'x') AS has,
array_join(array_sort(array_distinct(split(breadcrumbs, ' '))), ',') AS words, array_join(slice(split(breadcrumbs, ' '), 1, 2), ' ') AS head, aggregate(transform(split(breadcrumbs, ' > '), x -> length(x)), 0, (a, b) -> a + b) AS len,
size(filter(split(breadcrumbs, ' '), x -> length(x) > 6)) AS big, element_at(split(breadcrumbs, ' > '), -1) AS last FROM {chunks} WHERE breadcrumbs IS NOT NULL""",
                 """SELECT id, len(string_split(breadcrumbs, ' > ')) AS n, array_to_string(list_transform(string_split(breadcrumbs, ' > '), lambda x: upper(x)), '/') AS up, list_contains(string_split(breadcrumbs, ' > '), 'x') AS has,
array_to_string(list_sort(list_distinct(string_split(breadcrumbs, ' '))), ',') AS words, array_to_string(list_slice(string_split(breadcrumbs, ' '), 1, 2), ' ') AS head, CAST(list_sum(list_transform(string_split(breadcrumbs, ' > '), lambda x: length(x))) AS BIGINT) AS len,
len(list_filter(string_split(breadcrumbs, ' '), lambda x: length(x) > 6)) AS big, list_extract(string_split(breadcrumbs, ' > '), -1) AS last FROM {chunks} WHERE breadcrumbs IS NOT NULL"""),
    "fn_regex": (r"SELECT doc_id, regexp_replace(lower(heading), '[aeiou]+', '-') AS r, regexp_extract(text, '([0-9]+)', 1) AS n FROM {documents} WHERE heading IS NOT NULL",
                 r"SELECT doc_id, regexp_replace(lower(heading), '[aeiou]+', '-', 'g') AS r, regexp_extract(text, '([0-9]+)', 1) AS n FROM {documents} WHERE heading IS NOT NULL"),
    "fn_map_struct": ("SELECT n_nationkey, element_at(map_from_entries(array(named_struct('k', 'name', 'v', n_name), named_struct('k', 'region', 'v', CAST(n_regionkey AS STRING)))), 'region') AS r, named_struct('a', n_nationkey, 'b', n_name).b AS b, array_join(map_keys(map('x', 1, 'y', 2)), ',') AS k FROM {nation}",
                      "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS r, struct_pack(a := n_nationkey, b := n_name).b AS b, 'x,y' AS k FROM {nation}"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS k2, try_variant_get(parse_json(props), '$.k', 'bigint') AS k3, to_json(named_struct('u', user_id)) AS j FROM {events}",
                "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k2, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k3, CAST(to_json({'u': user_id}) AS VARCHAR) AS j FROM {events}"),
    "fn_cast": ("SELECT id, try_cast(substr(id, 8) AS INT) AS a, try_cast(id AS DOUBLE) AS b, CAST(0.1 + 0.2 AS DECIMAL(10, 2)) AS d, typeof(1) = 'int' AS t FROM {chunks}",
                "SELECT id, try_cast(substr(id, 8) AS INT) AS a, try_cast(id AS DOUBLE) AS b, CAST(0.1 + 0.2 AS DECIMAL(10, 2)) AS d, true AS t FROM {chunks}"),
    "fn_pivot": ("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM {lineitem}) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
                 "SELECT l_returnflag, nullif(count(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS o, nullif(count(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS f FROM {lineitem} GROUP BY l_returnflag"),
    "fn_unpivot": ("SELECT * FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_custkey AS DOUBLE) AS cust FROM {orders}) UNPIVOT (v FOR k IN (price, cust))",
                   "SELECT o_orderkey, 'price' AS k, CAST(o_totalprice AS DOUBLE) AS v FROM {orders} UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS DOUBLE) FROM {orders}"),
    "fn_explode": ("SELECT doc_id, pos, word FROM {documents} LATERAL VIEW posexplode(split(heading, ' ')) t AS pos, word WHERE heading IS NOT NULL",
                   "SELECT doc_id, CAST(unnest(range(len(string_split(heading, ' ')))) AS BIGINT) AS pos, unnest(string_split(heading, ' ')) AS word FROM {documents} WHERE heading IS NOT NULL"),
}


def rel_join_range(spark: SparkSession, d: str) -> DataFrame:
    """Range join by day buckets: events within one hour after another event of the same user."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    a = e.where("event_type = 'purchase'").withColumn("b", F.explode(F.array(F.date_trunc("hour", "ts"), F.date_trunc("hour", F.col("ts") + F.expr("INTERVAL 1 HOUR")))))
    b = e.withColumn("b", F.date_trunc("hour", "ts")).select(F.col("event_id").alias("next_id"), "user_id", F.col("ts").alias("next_ts"), "b")
    j = a.join(b, ["user_id", "b"]).where((F.col("next_ts") > F.col("ts")) & (F.col("next_ts") <= F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return j.select("event_id", "next_id")


def rel_join_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of join without a join: union both sides and carry the last purchase forward, one shuffle on the user."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") != "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).where("event_type = 'click'").select("event_id", "purchase_id")


def agg_approx(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem")
    return e.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))


def _spark(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: run(spark, d, text)


def _duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _spark(t) for k, t in _BOTH.items()}
QUERIES |= {k: _spark(a) for k, (a, _) in _PAIRS.items()}
QUERIES |= {"rel_join_range": rel_join_range, "rel_join_asof": rel_join_asof, "agg_approx": agg_approx}

SQL = {k: _duck(t) for k, t in _BOTH.items()} | {k: _duck(b) for k, (_, b) in _PAIRS.items()}
SQL["agg_distinct"] = SQL["agg_distinct"].replace("count(DISTINCT user_id, CAST(value AS INT))", "count(DISTINCT (user_id, CAST(trunc(value) AS INT)))")
SQL["rel_join_range"] = """SELECT a.event_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase'"""
SQL["rel_join_asof"] = """SELECT c.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts <= c.ts) AS purchase_id
FROM events c WHERE c.event_type = 'click'"""
