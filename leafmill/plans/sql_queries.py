"""Queries over saved tables: the SQL surface and the table operations."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.registry import query
from leafmill.plans.views import table, view
from leafmill.session import scratch_path
from leafmill.sources.captures import read_captures
from leafmill.sources.tables import ResultTables, json_rows, shrink

# --------------------------------------------------- statements in both dialects alike

_STATEMENTS = {
    "sql_projection": "SELECT p_partkey AS id, p_name AS title, p_retailprice AS price FROM @part",
    "sql_filter": """SELECT o_orderkey, o_orderstatus, o_totalprice FROM @orders WHERE o_totalprice > 100000
 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL""",
    "sql_sort_limit": """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM @lineitem
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""",
    "sql_sort": "SELECT c_custkey, c_name, c_acctbal FROM @customer ORDER BY c_acctbal DESC, c_custkey",
    "sql_global_aggregates": """SELECT count(*) AS n, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, round(avg(l_discount), 6) AS discount FROM @lineitem""",
    "sql_group_by": """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
 round(avg(l_extendedprice), 2) AS price FROM @lineitem GROUP BY l_returnflag, l_linestatus""",
    "sql_distinct": "SELECT DISTINCT p_brand, p_type FROM @part",
    "sql_concat": """SELECT c_custkey, c_name || ', ' || c_mktsegment AS label, c_name || CAST(NULL AS STRING) AS nothing FROM @customer""",
    "sql_scalars": """SELECT o_orderkey, round(o_totalprice, 0) AS total, replace(o_orderpriority, '-', ' ') AS priority,
 CAST(length(o_orderpriority) AS BIGINT) AS width FROM @orders""",
    "sql_cte": """WITH spend AS (SELECT o_custkey, count(*) AS n FROM @orders GROUP BY o_custkey),
 busy AS (SELECT o_custkey, n FROM spend WHERE n > 12) SELECT c_name, n FROM busy JOIN @customer ON c_custkey = o_custkey""",
    "sql_inner_join": """SELECT n_name, count(*) AS orders FROM @orders JOIN @customer ON o_custkey = c_custkey
 JOIN @nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "sql_left_join": """SELECT c_custkey, count(o_orderkey) AS orders FROM @customer LEFT JOIN @orders ON o_custkey = c_custkey
 GROUP BY c_custkey""",
    "sql_cross_join": """SELECT r_name, count(*) AS customers, count(CASE WHEN n_regionkey = r_regionkey THEN 1 END) AS inside
 FROM @customer JOIN @nation ON c_nationkey = n_nationkey CROSS JOIN @region GROUP BY r_name""",
    "sql_subqueries": """SELECT s_suppkey, s_name FROM @supplier WHERE s_suppkey IN (SELECT l_suppkey FROM @lineitem
 WHERE l_quantity > 49) AND s_acctbal > (SELECT avg(s_acctbal) FROM @supplier)
 AND NOT EXISTS (SELECT 1 FROM @nation WHERE n_nationkey = s_nationkey AND n_regionkey = 0)""",
    "sql_union": """SELECT c_nationkey AS nation, 'customer' AS kind FROM @customer UNION SELECT s_nationkey, 'supplier' FROM @supplier""",
    "sql_intersect": "SELECT c_nationkey AS nation FROM @customer INTERSECT SELECT s_nationkey FROM @supplier",
    "sql_except": "SELECT p_partkey FROM @part EXCEPT SELECT l_partkey FROM @lineitem WHERE l_quantity > 49",
    "sql_windows": """SELECT event_type, event_id, value, CAST(n AS BIGINT) AS n FROM (SELECT event_type, event_id, value,
 row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM @events) t WHERE n <= 10""",
}


def _statement(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The statement over the tables it names, through the guard."""
    for name in set(re.findall(r"@(\w+)", sql)):
        table(spark, sf, name).createOrReplaceTempView(name)
    return _tables(spark).select(sql.replace("@", ""))


for _name, _sql in _STATEMENTS.items():
    query(_name, _sql.replace("@", "").replace("AS STRING", "AS VARCHAR"))(partial(_statement, sql=_sql))


@query(
    "sql_json",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total
 FROM events GROUP BY event_type""",
)
def sql_json(spark, sf):
    return _statement(spark, sf, "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total FROM @events GROUP BY event_type")


# -------------------------------------------------------------------- table operations


def _tables(spark: SparkSession) -> ResultTables:
    """A database of this application's own, as its saved tables need not outlive it."""
    return ResultTables(spark, "leafmill_" + re.sub(r"\W", "_", spark.sparkContext.applicationId))


@query(
    "read_captures",
    "SELECT page_id, url, 200 AS status_code, 'text/html' AS content_type, 'plain' AS via, false AS js_render FROM pages",
)
def captured_pages(spark, sf):
    return read_captures(spark, f"{sf}/pages.parquet").drop("html", "headers", "seen_at")


@query("save_table", "SELECT p_brand, count(*) AS parts, min(p_retailprice) AS cheapest FROM part GROUP BY p_brand")
def save_table(spark, sf):
    tables = _tables(spark)
    rows = table(spark, sf, "part").groupBy("p_brand").agg(
        F.count("*").alias("parts"), F.min("p_retailprice").alias("cheapest")
    )
    tables.save("brand_prices", rows)
    return tables.read("brand_prices")


@query(
    "append_table",
    """SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS balance FROM customer
 UNION ALL SELECT s_suppkey, s_name, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) FROM supplier""",
)
def append_table(spark, sf):
    tables = _tables(spark)
    tables.save("parties", table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    supplier = table(spark, sf, "supplier").select(
        F.round("s_acctbal").cast("bigint").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")
    )
    tables.append("parties", supplier)
    return tables.read("parties")


@query(
    "append_case",
    """SELECT c_custkey AS "Id", c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""",
)
def append_case(spark, sf):
    """Columns meet by name, whatever its case."""
    tables = _tables(spark)
    tables.save("cased", table(spark, sf, "customer").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("name")))
    tables.append("cased", table(spark, sf, "supplier").select(F.col("s_name").alias("NAME"), F.col("s_suppkey").alias("ID")))
    return tables.read("cased")


@query(
    "append_lossy",
    """SELECT CAST(p_size AS VARCHAR) AS size, p_partkey AS id, NULL AS "left" FROM part
 UNION ALL SELECT r_name, CAST(r_regionkey AS BIGINT), NULL FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 7, n_name FROM nation""",
)
def append_lossy(spark, sf):
    """Sizes turn to text by the table's view; the parts written before stay as they are."""
    tables = _tables(spark)
    tables.save("sized", table(spark, sf, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").cast("long").alias("id")))
    tables.append("sized", table(spark, sf, "region").select(F.col("r_name").alias("size"), F.col("r_regionkey").cast("long").alias("id")))
    tables.append("sized", table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("size"), F.lit(7).cast("long").alias("id"), F.col("n_name").alias("left")))
    return tables.read("sized")


@query(
    "wide_ragged",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN o_custkey END AS first_key,
 CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN NULL ELSE 'k' || CAST(o_orderkey AS VARCHAR) || '=' || CAST(o_custkey AS VARCHAR) END AS others
 FROM orders""",
)
def wide_ragged(spark, sf):
    """Every order has a key of its own: the first two keys are columns, all others go into the map."""
    keyed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.format_string('{"id":%d,"k%d":%d}', "o_orderkey", "o_orderkey", "o_custkey").alias("obj")
    )
    rows = json_rows(keyed, width=2)
    listed = F.array_join(F.transform(F.map_entries("other_keys"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("id", F.col(rows.columns[1]).alias("first_key"), F.when(listed != "", listed).alias("others"))


@query(
    "ragged_rows",
    """SELECT CASE WHEN p_partkey % 3 < 2 THEN p_partkey END AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name,
 CASE WHEN p_partkey % 3 = 1 THEN 1 END::BIGINT AS flag, CASE WHEN p_partkey % 3 = 1 THEN '["a","' || p_brand || '"]' END AS tags,
 CASE WHEN p_partkey % 3 = 2 THEN p_size END::BIGINT AS size, CASE WHEN p_partkey % 3 = 2 THEN 0.5 END::DOUBLE AS ratio FROM part""",
)
def ragged_rows(spark, sf):
    return json_rows(view(spark, sf, "ragged"))


@query(
    "list_tables",
    """SELECT 'customers' AS name, count(*) AS row_count, 'c_custkey,c_name' AS columns FROM customer
 UNION ALL SELECT 'suppliers', count(*), 's_suppkey,s_name' FROM supplier""",
)
def list_tables(spark, sf):
    tables = _tables(spark)
    tables.save("customers", table(spark, sf, "customer").select("c_custkey", "c_name"))
    tables.save("suppliers", table(spark, sf, "supplier").select("s_suppkey", "s_name"))
    listed = tables.list_tables().filter(F.col("name").isin("customers", "suppliers"))
    return listed.withColumn("columns", F.array_join("columns", ","))


@query(
    "table_preview",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '… (+' || CAST(length(text) - 200 AS VARCHAR) || ' chars)'
 ELSE text END AS text FROM documents""",
)
def table_preview(spark, sf):
    return shrink(table(spark, sf, "documents").select("doc_id", "text"))


@query("query_saved", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'drop' GROUP BY o_orderstatus")
def query_saved(spark, sf):
    tables = _tables(spark)
    tables.save("saved_orders", table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))
    return tables.select("SELECT o_orderstatus, count(*) AS n FROM saved_orders WHERE o_orderstatus <> 'drop' GROUP BY o_orderstatus")


@query("query_to_table", "SELECT DISTINCT p_brand || ' / ' || p_type AS label FROM part WHERE p_size > 10")
def query_to_table(spark, sf):
    """A query may be saved over the very table it reads."""
    tables = _tables(spark)
    tables.save("labels_of_parts", table(spark, sf, "part"))
    tables.query_to_table("SELECT DISTINCT p_brand || ' / ' || p_type AS label FROM labels_of_parts WHERE p_size > 10", "labels_of_parts")
    return tables.read("labels_of_parts")


def _exported(spark: SparkSession, sf: str, fmt: str, schema: str) -> DataFrame:
    tables = _tables(spark)
    tables.save(f"exported_{fmt}", table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))
    path = tables.export(f"exported_{fmt}", fmt, scratch_path(spark, "export"))
    options = {"header": "true"} if fmt == "csv" else {}
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


for _fmt in ("csv", "json"):
    query(f"export_{_fmt}", "SELECT c_custkey, c_name, c_acctbal FROM customer")(
        partial(_exported, fmt=_fmt, schema="c_custkey bigint, c_name string, c_acctbal double")
    )


@query("drop_table", "SELECT count(*) AS rows_deleted, false AS still_there FROM orders")
def drop_table(spark, sf):
    tables = _tables(spark)
    tables.save("short_lived", table(spark, sf, "orders"))
    deleted = tables.drop("short_lived")
    return table(spark, sf, "orders").agg(
        F.max(F.lit(deleted)).cast("bigint").alias("rows_deleted"), F.max(F.lit(tables.exists("short_lived"))).alias("still_there")
    )


@query("overflow_to_table", "SELECT p_partkey, p_name FROM part")
def overflow_to_table(spark, sf):
    tables = _tables(spark)
    for name in ("auto_parts", "auto_parts_2"):
        if tables.exists(name):
            tables.drop(name)
    return tables.read(tables.emit("parts", table(spark, sf, "part").select("p_partkey", "p_name")).name)
