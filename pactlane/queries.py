"""Every operator as a query over the shared tables, and the SQL that says what it should give."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import validate_data
from .config import ValidationConfig
from .contracts import Contract
from .operators.compare import holds_column
from .operators.guard import SQLSecurityError, validate_query_security
from .result import ValidationResult
from .sources.adapters import MultiSourceAdapter, SparkAdapter

Query = Callable[[SparkSession, str], DataFrame]

ORDERS_D = """orders_d AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
 CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE o_orderpriority END AS o_orderpriority,
 CASE WHEN o_orderkey % 101 = 0 THEN 'abc' WHEN o_orderkey % 7 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price_txt,
 CASE WHEN o_orderkey % 11 = 0 THEN 'not-a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_txt,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 14000 END AS key_d, o_totalprice, o_orderdate FROM orders)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table, or orders_d: orders with nulls, bad text and repeated keys."""
    if name != "orders_d":
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), F.when(k % 13 == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 101 == 0, "abc").when(k % 7 == 0, price.cast("string")).otherwise(F.floor(price).cast("bigint").cast("string")).alias("price_txt"),
        F.when(k % 11 == 0, "not-a-date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("date_txt"), F.when(k % 19 != 0, k % 14000).alias("key_d"), "o_totalprice", "o_orderdate",
    )


def contract(*schemas: dict[str, Any]) -> Contract:
    return Contract(dict(id="shared-tables", status="active", version="1.0.0", kind="DataContract", apiVersion="v3.1.0", schema=list(schemas)))


def validated(spark: SparkSession, sf_dir: str, schema: dict[str, Any], others: tuple[str, ...] = (), filters: dict[str, Any] | None = None, statistics: bool = False, cap: int = -1) -> ValidationResult:
    """Run one schema's checks; others are further tables that its SQL reads."""
    names = [schema["name"], *others]
    adapter = SparkAdapter(spark, {n: table(spark, sf_dir, n) for n in names}, filter_conditions=filters)
    full = contract(schema, *({"name": n} for n in others))
    return validate_data(full, adapters=MultiSourceAdapter(dict.fromkeys(names, adapter)), config=ValidationConfig(enable_additional_schema_statistics=statistics, max_rows_for_statistics=cap))


def _scalar(name: str, schema: dict[str, Any], check: str, kind: str = "bigint", digits: int | None = None, others: tuple[str, ...] = (), filters: dict[str, Any] | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = next(c for c in validated(spark, sf_dir, schema, others, filters).check_results if c.check_name == check)
        value = r.actual_value if r.actual_value is None else float(r.actual_value) if kind == "double" else int(r.actual_value)
        row = (name, round(value, digits) if digits is not None and value is not None else value, r.status)
        return spark.createDataFrame([row], f"check_name string, actual_value {kind}, status string")

    return query


def _sql(name: str, core: str, kind: str = "BIGINT") -> str:
    lead = f"WITH {ORDERS_D}, " if "orders_d" in core else "WITH "
    return f"{lead}core AS (SELECT ({core}) AS v) SELECT '{name}' AS check_name, CAST(v AS {kind}) AS actual_value, CASE WHEN v = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM core"


def _prop(table_: str, column: str, **spec: Any) -> dict[str, Any]:
    return {"name": table_, "properties": [{"name": column, **spec}]}


def _lib(table_: str, column: str | None, metric: str, **spec: Any) -> dict[str, Any]:
    entry = dict(name="c", mustBe=0, type="library", metric=metric) | spec
    return {"name": table_, "properties": [{"name": column, "quality": [entry]}]} if column else {"name": table_, "quality": [entry]}


def _metric(metric: str, **spec: Any) -> dict[str, Any]:
    return dict(type="library", metric=metric, **spec)


def _rule(table_: str, sql: str) -> dict[str, Any]:
    return dict(name=table_, quality=[dict(name="c", type="sql", query=sql, mustBe=0)])


def _option(table_: str, column: str, option: str, value: Any) -> dict[str, Any]:
    return _prop(table_, column, logicalTypeOptions={option: value})


_DUP = "SELECT count(*) FROM (SELECT {0} FROM {1} WHERE {2} GROUP BY {0} HAVING count(*) > 1)"

#: name: (contract schema, name of the check, DuckDB core) and, where they differ from a bigint count, (type, digits, further tables, filters).
CHECKS: dict[str, tuple] = {
    "chk_column_exists": (_prop("orders", "o_orderkey"), "o_orderkey_column_exists_check", "SELECT count(*) FROM (SELECT o_orderkey FROM orders LIMIT 0)"),
    "chk_type_integer": (_prop("orders_d", "price_txt", logicalType="integer"), "price_txt_logical_type_check", "SELECT count(*) FROM orders_d WHERE price_txt IS NOT NULL AND (TRY_CAST(price_txt AS DOUBLE) IS NULL OR TRY_CAST(price_txt AS DOUBLE) <> TRY_CAST(price_txt AS BIGINT))"),
    "chk_type_number": (_prop("orders_d", "price_txt", logicalType="number"), "price_txt_logical_type_check", "SELECT count(*) FROM orders_d WHERE price_txt IS NOT NULL AND TRY_CAST(price_txt AS DOUBLE) IS NULL"),
    "chk_type_date": (_prop("orders_d", "date_txt", logicalType="date"), "date_txt_logical_type_check", "SELECT count(*) FROM orders_d WHERE date_txt IS NOT NULL AND TRY_CAST(date_txt AS DATE) IS NULL"),
    "chk_type_timestamp": (_prop("orders_d", "date_txt", logicalType="timestamp"), "date_txt_logical_type_check", "SELECT count(*) FROM orders_d WHERE date_txt IS NOT NULL AND TRY_CAST(date_txt AS TIMESTAMP) IS NULL"),
    "chk_type_time": (_prop("orders_d", "o_orderstatus", logicalType="time"), "o_orderstatus_logical_type_check", "SELECT count(*) FROM orders_d WHERE o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS TIME) IS NULL"),
    "chk_type_boolean": (_prop("customer", "c_mktsegment", logicalType="boolean"), "c_mktsegment_logical_type_check", "SELECT count(*) FROM customer WHERE c_mktsegment IS NOT NULL AND TRY_CAST(c_mktsegment AS BOOLEAN) IS NULL"),
    "chk_type_string": (_prop("customer", "c_name", logicalType="string"), "c_name_logical_type_check", "SELECT count(*) FROM customer WHERE c_name IS NOT NULL AND TRY_CAST(c_name AS VARCHAR) IS NULL"),
    "chk_min_length": (_option("part", "p_name", "minLength", 10), "p_name_logical_type_options_minLength_check", "SELECT count(*) FROM part WHERE p_name IS NOT NULL AND length(p_name) < 10"),
    "chk_max_length": (_option("documents", "text", "maxLength", 5000), "text_logical_type_options_maxLength_check", "SELECT count(*) FROM documents WHERE text IS NOT NULL AND length(text) > 5000"),
    "chk_pattern": (_option("part", "p_brand", "pattern", "^Brand#[0-9]$"), "p_brand_logical_type_options_pattern_check", "SELECT count(*) FROM part WHERE p_brand IS NOT NULL AND NOT regexp_matches(p_brand, '^Brand#[0-9]$')"),
    "chk_minimum": (_option("customer", "c_acctbal", "minimum", 0), "c_acctbal_logical_type_options_minimum_check", "SELECT count(*) FROM customer WHERE c_acctbal IS NOT NULL AND TRY_CAST(c_acctbal AS DOUBLE) < 0"),
    "chk_maximum": (_option("lineitem", "l_quantity", "maximum", 45), "l_quantity_logical_type_options_maximum_check", "SELECT count(*) FROM lineitem WHERE l_quantity > 45"),
    "chk_exclusive_minimum": (_option("lineitem", "l_discount", "exclusiveMinimum", 0), "l_discount_logical_type_options_exclusiveMinimum_check", "SELECT count(*) FROM lineitem WHERE l_discount <= 0"),
    "chk_exclusive_maximum": (_option("lineitem", "l_quantity", "exclusiveMaximum", 50), "l_quantity_logical_type_options_exclusiveMaximum_check", "SELECT count(*) FROM lineitem WHERE l_quantity >= 50"),
    "chk_multiple_of": (_option("lineitem", "l_quantity", "multipleOf", 5), "l_quantity_logical_type_options_multipleOf_check", "SELECT count(*) FROM lineitem WHERE CAST(l_quantity AS DOUBLE) % 5 <> 0"),
    "chk_required": (_prop("orders_d", "o_orderstatus", required=True), "o_orderstatus_required_check", "SELECT count(*) FROM orders_d WHERE o_orderstatus IS NULL"),
    "chk_unique": (_prop("orders_d", "key_d", unique=True), "key_d_unique_check", _DUP.format("key_d", "orders_d", "key_d IS NOT NULL")),
    "chk_primary_key": (_prop("orders_d", "key_d", primaryKey=True), "key_d_primary_key_check", "SELECT (SELECT count(*) FROM orders_d WHERE key_d IS NULL) + (" + _DUP.format("key_d", "orders_d", "key_d IS NOT NULL") + ")"),
    "lib_null_values": (_lib("orders_d", "key_d", "nullValues"), "c", "SELECT count(*) FROM orders_d WHERE key_d IS NULL"),
    "lib_missing_values": (_lib("orders_d", "o_orderpriority", "missingValues", arguments={"missingValues": [None, "N/A", ""]}), "c", "SELECT count(*) FROM orders_d WHERE o_orderpriority IS NULL OR o_orderpriority IN ('N/A', '')"),
    "lib_invalid_set": (_lib("orders_d", "o_orderpriority", "invalidValues", arguments={"validValues": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}), "c", "SELECT count(*) FROM orders_d WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"),
    "lib_invalid_pattern": (_lib("orders_d", "o_orderpriority", "invalidValues", arguments={"pattern": "^[0-9]-"}), "c", "SELECT count(*) FROM orders_d WHERE o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[0-9]-')"),
    "lib_invalid_both": (_lib("orders_d", "o_orderpriority", "invalidValues", arguments={"validValues": ["N/A"], "pattern": "^[1-3]-"}), "c", "SELECT count(*) FROM orders_d WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('N/A') AND NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
    "lib_duplicate_column": (_lib("lineitem", "l_orderkey", "duplicateValues"), "c", _DUP.format("l_orderkey", "lineitem", "l_orderkey IS NOT NULL")),
    "lib_row_count": (_lib("lineitem", None, "rowCount"), "c", "SELECT count(*) FROM lineitem"),
    "lib_duplicate_table": (_lib("lineitem", None, "duplicateValues", arguments={"properties": ["l_orderkey", "l_linenumber"]}), "c", _DUP.format("l_orderkey, l_linenumber", "lineitem", "l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")),
    "lib_null_percent": (_lib("orders_d", "o_orderstatus", "nullValues", unit="percent"), "c", "SELECT round(CAST(count(*) FILTER (WHERE o_orderstatus IS NULL) AS DOUBLE) * 100.0 / nullif(count(*), 0), 9) FROM orders_d", "double", 9),
    "lib_duplicate_percent": (_lib("orders_d", "key_d", "duplicateValues", unit="percent"), "c", "SELECT round(CAST((" + _DUP.format("key_d", "orders_d", "key_d IS NOT NULL") + ") AS DOUBLE) * 100.0 / nullif((SELECT count(*) FROM orders_d), 0), 9)", "double", 9),
    "sql_count": (_rule("lineitem", "SELECT COUNT(*) FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24"), "c", "SELECT count(*) FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24"),
    "sql_plain_select": (_rule("supplier", "SELECT * FROM supplier WHERE s_acctbal < 0"), "c", "SELECT count(*) FROM (SELECT * FROM supplier WHERE s_acctbal < 0)"),
    "sql_count_distinct": (_rule("orders", "SELECT COUNT(DISTINCT o_custkey) FROM orders"), "c", "SELECT count(DISTINCT o_custkey) FROM orders"),
    "sql_sum": (_rule("lineitem", "SELECT SUM(l_quantity) FROM lineitem"), "c", "SELECT round(sum(l_quantity), 2) FROM lineitem", "double", 2),
    "sql_avg": (_rule("orders", "SELECT AVG(o_totalprice) FROM orders"), "c", "SELECT round(avg(o_totalprice), 4) FROM orders", "double", 4),
    "sql_min": (_rule("orders", "SELECT MIN(o_totalprice) FROM orders"), "c", "SELECT min(o_totalprice) FROM orders", "double"),
    "sql_max": (_rule("orders", "SELECT MAX(o_totalprice) FROM orders"), "c", "SELECT max(o_totalprice) FROM orders", "double"),
    "sql_arithmetic": (_rule("lineitem", "SELECT COUNT(*) * 2 + COUNT(DISTINCT l_returnflag) FROM lineitem"), "c", "SELECT count(*) * 2 + count(DISTINCT l_returnflag) FROM lineitem"),
    "sql_postgres_flavour": (_rule("orders_d", """SELECT COUNT(*) FROM orders_d WHERE "o_orderpriority"::text !~ '^[0-9]-' OR CAST(price_txt AS VARCHAR) ~* '^ABC$';"""), "c", "SELECT count(*) FROM orders_d WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-') OR price_txt = 'abc'"),
    "sql_referential": (_rule("orders", "SELECT COUNT(*) FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL"), "c", "SELECT count(*) FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY') c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL", "bigint", None, ("customer",)),
    "sql_join_theta": (_rule("nation", "SELECT COUNT(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"), "c", "SELECT count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "sql_cte": (_rule("orders", "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) SELECT COUNT(*) FROM t WHERE n > 15"), "c", "SELECT count(*) FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) WHERE n > 15"),
    "sql_window": (_rule("orders", "SELECT COUNT(*) FROM (SELECT ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1"), "c", "SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 1"),
    "sql_group_having": (_rule("orders", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15"), "c", "SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)"),
    "sql_grouping_sets": (_rule("lineitem", "SELECT COUNT(*) FROM (SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))"), "c", "SELECT count(*) FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))"),
    "sql_setop_subquery": (_rule("customer", "SELECT COUNT(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)"), "c", "SELECT count(*) FROM (SELECT c_nationkey k FROM customer INTERSECT SELECT s_nationkey FROM supplier)", "bigint", None, ("supplier",)),
    "sql_top_k": (_rule("orders", "SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) AS t WHERE o_orderkey > 5000"), "c", "SELECT count(*) FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) WHERE o_orderkey > 5000"),
    "trycast_literal": (_rule("orders_d", "SELECT COUNT(*) FROM orders_d WHERE price_txt >= 250000"), "c", "SELECT count(*) FROM orders_d WHERE TRY_CAST(price_txt AS DOUBLE) >= 250000"),
    "trycast_date_literal": (_rule("orders_d", "SELECT COUNT(*) FROM orders_d WHERE date_txt < '1995-01-01'"), "c", "SELECT count(*) FROM orders_d WHERE TRY_CAST(date_txt AS DATE) < DATE '1995-01-01'"),
    "filter_comparisons": (
        _lib("orders", None, "rowCount"), "c", "SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 400000 AND o_orderkey > 10 AND o_orderkey <= 14000 AND o_orderpriority <> '5-LOW'", "bigint", None, (),
        {"orders": [{"field": "o_orderstatus", "operator": "=", "value": "F"}, {"field": "o_totalprice", "operator": ">=", "value": 1000}, {"field": "o_totalprice", "operator": "<", "value": 400000}, {"field": "o_orderkey", "operator": ">", "value": 10}, {"field": "o_orderkey", "operator": "<=", "value": 14000}, {"field": "o_orderpriority", "operator": "!=", "value": "5-LOW"}]},
    ),
    "filter_in_like_null": (
        _lib("orders_d", None, "rowCount"), "c", "SELECT count(*) FROM orders_d WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority NOT IN ('3-MEDIUM') AND o_orderpriority LIKE '%U%' AND NOT (o_orderpriority LIKE '%X%') AND o_orderstatus IS NOT NULL", "bigint", None, (),
        {"orders_d": [{"field": "o_orderpriority", "operator": "IN", "value": ["1-URGENT", "2-HIGH"]}, {"field": "o_orderpriority", "operator": "NOT IN", "value": "3-MEDIUM"}, {"field": "o_orderpriority", "operator": "LIKE", "value": "%U%"}, {"field": "o_orderpriority", "operator": "NOT LIKE", "value": "%X%"}, {"field": "o_orderstatus", "operator": "IS NOT NULL"}]},
    ),
    "filter_is_null": (_lib("orders_d", None, "rowCount"), "c", "SELECT count(*) FROM orders_d WHERE o_orderstatus IS NULL", "bigint", None, (), {"orders_d": {"field": "o_orderstatus", "operator": "IS NULL"}}),
    "filter_glob_multi": (
        _rule("orders", "SELECT COUNT(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"), "c", "SELECT count(*) FROM (SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'O') o JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey", "bigint", None, ("customer",),
        {"ord*": {"field": "o_orderkey", "operator": ">=", "value": 100}, "orders": {"field": "o_orderstatus", "operator": "=", "value": "O"}, "cust?mer": dict(field="c_acctbal", operator=">", value=0)},
    ),
    "filter_text_as_number": (_lib("orders_d", None, "rowCount"), "c", "SELECT count(*) FROM orders_d WHERE TRY_CAST(price_txt AS DOUBLE) >= 100", "bigint", None, (), {"orders_d": {"field": "price_txt", "operator": ">=", "value": 100}}),
}

_TWO = dict(name="orders_d", properties=[dict(name="o_orderstatus", required=True), dict(name="o_orderpriority", quality=[_metric("missingValues", name="no_priority", mustBe=0, arguments={"missingValues": [None, "N/A"]})])])
_BAD = "o_orderstatus IS NULL OR o_orderpriority = 'N/A'"
_NAMES = "concat_ws(', ', CASE WHEN o_orderpriority = 'N/A' THEN 'no_priority' END, CASE WHEN o_orderstatus IS NULL THEN 'o_orderstatus_required_check' END)"

_WHOLE = dict(logicalType="integer", required=True)
_NUMBER = dict(logicalType="number")
FLAGSHIP = dict(
    name="lineitem",
    properties=[
        dict(name="l_orderkey", **_WHOLE), dict(name="l_partkey", **_WHOLE), dict(name="l_suppkey", **_WHOLE), dict(name="l_linenumber", **_WHOLE),
        dict(name="l_quantity", **_NUMBER, logicalTypeOptions=dict(minimum=1, maximum=50, multipleOf=1)), dict(name="l_extendedprice", **_NUMBER), dict(name="l_discount", **_NUMBER, logicalTypeOptions=dict(maximum=0.1)), dict(name="l_tax", **_NUMBER),
        dict(name="l_returnflag", logicalType="string", quality=[_metric("invalidValues", mustBe=0, arguments={"validValues": ["A", "N", "R"]})]), dict(name="l_linestatus", logicalType="string"), dict(name="l_shipdate", logicalType="timestamp"),
    ],
    quality=[
        _metric("rowCount", mustBeGreaterThan=0), _metric("duplicateValues", mustBe=0, arguments={"properties": ["l_orderkey", "l_linenumber"]}),
        dict(type="sql", name="discount_of_small_lines", query="SELECT COUNT(*) FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24", mustBeLessThan=1000000000),
    ],
)


def check_results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, FLAGSHIP, statistics=True).get_check_results_df().select(*"check_name target status operator actual_value expected_value failed_rows_count".split())


def _flagship_sql() -> str:
    """DuckDB SQL of the flagship's table of checks: a count for each, and what follows from it."""
    rows: list[tuple[str, str, str]] = []
    breaks = {"minimum": "{0} < {1}", "maximum": "{0} > {1}", "multipleOf": "{0} % {1} <> 0"}
    for p in FLAGSHIP["properties"]:
        c = p["name"]
        rows += [(f"{c}_{k}_check", c, "0") for k in ("column_exists", "logical_type")]  # the columns are there and of these types
        rows += [(f"{c}_required_check", c, f"(SELECT count(*) FROM lineitem WHERE {c} IS NULL)")] if p.get("required") else []
        rows += [(f"{c}_logical_type_options_{o}_check", c, f"(SELECT count(*) FROM lineitem WHERE {breaks[o].format(c, v)})") for o, v in p.get("logicalTypeOptions", {}).items()]
    rows.append(("l_returnflag_invalidValues", "l_returnflag", "(SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R'))"))
    rows.append(("lineitem_duplicateValues", "", "(" + _DUP.format("l_orderkey, l_linenumber", "lineitem", "l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL") + ")"))
    counted = " UNION ALL ".join(f"SELECT '{n}' AS check_name, 'lineitem{'.' * bool(c)}{c}' AS target, CAST({q} AS BIGINT) AS n" for n, c, q in rows)
    more = [("lineitem_rowCount", "mustBeGreaterThan", "SELECT count(*) FROM lineitem", "0"), ("discount_of_small_lines", "mustBeLessThan", "SELECT count(*) FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 24", "1000000000")]
    others = " UNION ALL ".join(f"SELECT '{n}', 'lineitem', CASE WHEN n {'>' if 'Greater' in op else '<'} {e} THEN 'PASSED' ELSE 'FAILED' END, '{op}', CAST(n AS VARCHAR), '{e}', CAST(0 AS BIGINT) FROM (SELECT ({q}) AS n)" for n, op, q, e in more)
    return f"SELECT check_name, target, CASE WHEN n = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, 'mustBe' AS operator, CAST(n AS VARCHAR) AS actual_value, '0' AS expected_value, n AS failed_rows_count FROM ({counted}) UNION ALL {others}"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validated(spark, sf_dir, FLAGSHIP, statistics=True).summary["validation_summary"]
    return spark.createDataFrame([(s["total_checks"], s["passed"], s["failed"], s["errors"], s["total_rows_by_schema"]["lineitem"], s["failed_rows"])], "total_checks bigint, passed bigint, failed bigint, errors bigint, total_rows bigint, failed_rows bigint")


def failed_rows_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validated(spark, sf_dir, _TWO)
    return next(c for c in found.check_results if c.check_name == "o_orderstatus_required_check").failed_rows.drop("key_d")


def failed_rows_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, CHECKS["lib_duplicate_table"][0]).check_results[0].failed_rows


def failed_rows_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows of a self join: repeated column names are told apart."""
    rule = _rule("nation", "SELECT COUNT(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
    rows = validated(spark, sf_dir, rule).check_results[0].failed_rows
    return rows.toDF(*[c.replace(".", "_") for c in rows.columns])


def output_of_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, _TWO).get_output_dfs()["orders_d::no_priority"].select("o_orderkey", "check_id", "tables_in_query")


def consolidated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, _TWO).get_consolidated_output_dfs()["orders_d"].drop("key_d")


def row_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = validated(spark, sf_dir, _TWO, statistics=True).row_quality()["orders_d"]
    return spark.createDataFrame([(q.total_rows, q.records_with_issues, q.clean_records)], "total_rows bigint, records_with_issues bigint, clean_records bigint")


def schema_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {**_TWO, "quality": [dict(name="known_customer", type="sql", mustBe=0, query="SELECT COUNT(*) FROM orders_d o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL OR c.c_acctbal < 0")]}
    b = validated(spark, sf_dir, rule, ("customer",), statistics=True).schema_breakdown()["orders_d"]
    row = (b.overall.total_checks, b.overall.passed_checks, b.single_table.total_checks, b.single_table.failed_unique_rows, b.multi_table.total_checks, b.multi_table.failed_non_unique_rows)
    return spark.createDataFrame([row], "checks bigint, passed bigint, single_checks bigint, failed_unique_rows bigint, multi_checks bigint, failed_non_unique_rows bigint")


def row_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validated(spark, sf_dir, {"name": "lineitem"}, statistics=True, cap=1000).summary["validation_summary"]
    return spark.createDataFrame([("row_count_capped", s["total_rows_by_schema"]["lineitem"])], "check_name string, actual_value bigint")


def operator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparison of the number of lines of every order, on the cluster."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    wanted = {"mustBe": 4, "mustNotBe": 4, "mustBeGreaterThan": 4, "mustBeGreaterOrEqualTo": 4, "mustBeLessThan": 4, "mustBeLessOrEqualTo": 4, "mustBeBetween": [2, 4], "mustNotBeBetween": [2, 4]}
    met = lines.agg(*(F.count_if(holds_column(k, F.col("n"), v)).alias(k) for k, v in wanted.items()))
    return met.unpivot([], list(wanted), "operator", "orders_met")


def security_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's verdict on reads, writes and suspect text."""
    probes = [
        "SELECT COUNT(*) FROM orders", "WITH t AS (SELECT 1 AS a) SELECT COUNT(*) FROM t", "", "SELECT FROM WHERE", "DROP TABLE orders", "INSERT INTO orders SELECT * FROM orders", "SELECT 1; DROP TABLE orders", "SELECT 1 UNION SELECT 2",
        "SELECT a FROM t UNION SELECT NULL, NULL --", "SELECT SLEEP(10)", "SELECT * FROM information_schema.tables", "SELECT LOAD_FILE('/etc/passwd')", "SELECT * INTO copy FROM orders", "SELECT 1; SELECT 2",
    ]
    rows = []
    for k, q in enumerate(probes):
        try:
            validate_query_security(spark, q)
            rows.append((k, "accepted"))
        except SQLSecurityError as e:
            rows.append((k, e.violation_type))
    return spark.createDataFrame(rows, "probe int, verdict string")


def custom_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered engine that returns a value and its failing rows."""

    def few_parts(session: SparkSession, df: DataFrame, check: Any) -> tuple[int, DataFrame]:
        bad = df.where(F.col("p_size") > check.node.implementation["largest"])
        return bad.count(), bad

    adapter = SparkAdapter(spark, {"part": table(spark, sf_dir, "part")}, executors={"sizes": few_parts})
    schema = {"name": "part", "quality": [{"type": "custom", "engine": "sizes", "name": "largest_size", "implementation": {"largest": 45}, "mustBe": 0}]}
    r = validate_data(contract(schema), adapter=adapter).check_results[0]
    return spark.createDataFrame([(r.check_name, r.actual_value, r.status, r.failed_rows.count())], "check_name string, actual_value bigint, status string, rows bigint")


def streamed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a stream of events, batch by batch, added up."""
    from .streaming.microbatch import validate_stream

    found: list[tuple[str, int]] = []
    schema = {"name": "events", "properties": [{"name": "value", "logicalTypeOptions": {"maximum": 100}}, {"name": "event_type", "required": True}]}
    kind = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = validate_stream(stream, contract(schema), on_result=lambda r, _: found.extend((c.check_name, int(c.actual_value)) for c in r.check_results))
    query.awaitTermination()
    return spark.createDataFrame(found or [], T.StructType([T.StructField("check_name", T.StringType()), T.StructField("n", T.LongType())])).groupBy("check_name").agg(F.sum("n").alias("actual_value"))


COMPARED = [(k, v) for k in ("mustBe", "mustNotBe", "mustBeGreaterThan", "mustBeGreaterOrEqualTo", "mustBeLessThan", "mustBeLessOrEqualTo") for v in (4, 5, 6)] + [(k, v) for k in ("mustBeBetween", "mustNotBeBetween") for v in ([3, 4], [4, 5], [5, 5], [6, 9])]


def _met(k: str, v: Any) -> str:
    """DuckDB condition of a comparison over n."""
    sign = {"mustBe": "=", "mustNotBe": "<>", "mustBeGreaterThan": ">", "mustBeGreaterOrEqualTo": ">=", "mustBeLessThan": "<", "mustBeLessOrEqualTo": "<="}
    return f"n {sign[k]} {v}" if k in sign else f"n {'NOT ' * (k == 'mustNotBeBetween')}BETWEEN {v[0]} AND {v[1]}"


def comparison_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine makes of each comparison of the number of regions with values around it."""
    rules = [{"name": f"c{i:02d}_{k}", "type": "sql", "query": "SELECT COUNT(*) FROM region", k: v} for i, (k, v) in enumerate(COMPARED)]
    found = validated(spark, sf_dir, {"name": "region", "quality": rules}).check_results
    return spark.createDataFrame([(c.check_name, c.actual_value, c.status) for c in found], "check_name string, actual_value bigint, status string")


def sql_session_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A check that calls a function which the caller has registered in the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pactlane_twice(x BIGINT) RETURNS BIGINT RETURN 2 * x")
    return _scalar("sql_session_function", _rule("orders", "SELECT COUNT(*) FROM orders WHERE pactlane_twice(o_orderkey) > 1000"), "c")(spark, sf_dir)


def src_session_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session as the source: the table is a temporary view of the caller's."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("pactlane_supplier")
    r = validate_data(contract(_rule("pactlane_supplier", "SELECT COUNT(*) FROM pactlane_supplier WHERE s_acctbal < 0")), spark_session=spark).check_results[0]
    return spark.createDataFrame([("src_session_catalog", r.actual_value)], "check_name string, actual_value bigint")


def src_path_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path URI as the source of all schemas."""
    found = validate_data(contract(*(_rule(t, f"SELECT COUNT(*) FROM {t}") for t in ("nation", "supplier"))), connection_str=f"parquet:{sf_dir}/{{table}}.parquet").check_results
    return spark.createDataFrame([(c.metadata["schema_name"], c.actual_value) for c in found], "check_name string, actual_value bigint")


def src_local_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame as the source."""
    local = table(spark, sf_dir, "nation").toPandas()
    r = validate_data(contract(_rule("nation", "SELECT COUNT(*) FROM nation WHERE n_regionkey > 2")), df=local).check_results[0]
    return spark.createDataFrame([("src_local_frame", r.actual_value)], "check_name string, actual_value bigint")


def column_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQL rule of a column: the check's path and kind, and its count."""
    schema = {"name": "part", "properties": [{"name": "p_size", "quality": [{"name": "big", "type": "sql", "query": "SELECT COUNT(*) FROM part WHERE p_size > 40", "mustBe": 0}]}]}
    r = next(c for c in validated(spark, sf_dir, schema).check_results if c.check_name == "big")
    return spark.createDataFrame([(r.check_name, r.metadata["target"], r.actual_value, r.failed_rows_count)], "check_name string, target string, actual_value bigint, failed_rows bigint")


def error_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can't be run are errors, each by itself: unknown metric, type and function, missing column and table, writes."""
    bad = [
        dict(name="metric", type="library", metric="noSuchMetric", mustBe=0), dict(name="kind", type="noSuchType", mustBe=0), dict(name="function", type="sql", query="SELECT no_such_function(r_name) FROM region", mustBe=0),
        dict(name="table", type="sql", query="SELECT COUNT(*) FROM no_such_table", mustBe=0), dict(name="write", type="sql", query="DROP TABLE region", mustBe=0), dict(name="fine", type="sql", query="SELECT COUNT(*) FROM region", mustBe=5),
    ]
    schema = {"name": "region", "properties": [{"name": "no_such_column", "required": True}], "quality": bad}
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = validated(spark, sf_dir, schema)
    return spark.createDataFrame([(c.check_name, c.status) for c in found.check_results], "check_name string, status string")


def failed_rows_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_failed_rows caps the rows shown of a check, not its count."""
    adapter = SparkAdapter(spark, {"part": table(spark, sf_dir, "part")})
    r = validate_data(contract(_rule("part", "SELECT COUNT(*) FROM part WHERE p_size > 40")), adapter=adapter, config=ValidationConfig(max_failed_rows=7)).check_results[0]
    return spark.createDataFrame([(r.actual_value, r.failed_rows.count())], "actual_value bigint, rows_shown bigint")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks as reports show them (failed, errors, passed) with their marks in the summary."""
    rules = [dict(name=n, type="sql", query=q, mustBe=5) for n, q in (("b_fine", "SELECT COUNT(*) FROM region"), ("a_fine", "SELECT COUNT(*) FROM region"), ("error", "SELECT COUNT(*) FROM region WHERE nothing = 1"), ("wrong", "SELECT COUNT(*) FROM region WHERE r_regionkey > 0"))]
    found = validated(spark, sf_dir, {"name": "region", "quality": rules})
    return spark.createDataFrame([(k, c.check_name, c.status, found.passed, found.has_errors) for k, c in enumerate(found.sorted_checks())], "place int, check_name string, status string, passed boolean, has_errors boolean")


ROWS: dict[str, tuple[Query, str | None]] = {
    "check_results_table": (check_results_table, _flagship_sql()),
    "run_summary": (run_summary, "SELECT CAST(34 AS BIGINT) AS total_checks, CAST(34 - f AS BIGINT) AS passed, CAST(f AS BIGINT) AS failed, CAST(0 AS BIGINT) AS errors, n AS total_rows, CAST(d AS BIGINT) AS failed_rows FROM (SELECT (SELECT count(*) FROM lineitem) AS n, (" + _DUP.format("l_orderkey, l_linenumber", "lineitem", "TRUE") + ") AS d, (CASE WHEN (" + _DUP.format("l_orderkey, l_linenumber", "lineitem", "TRUE") + ") > 0 THEN 1 ELSE 0 END) AS f)"),
    "failed_rows_required": (failed_rows_required, f"WITH {ORDERS_D} SELECT * EXCLUDE (key_d) FROM orders_d WHERE o_orderstatus IS NULL"),
    "failed_rows_duplicates": (failed_rows_duplicates, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"),
    "failed_rows_of_join": (failed_rows_of_join, "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS n_nationkey_1, b.n_name AS n_name_1, b.n_regionkey AS n_regionkey_1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "output_of_check": (output_of_check, f"WITH {ORDERS_D} SELECT o_orderkey, 'no_priority' AS check_id, 'orders_d' AS tables_in_query FROM orders_d WHERE o_orderpriority IS NULL OR o_orderpriority = 'N/A'"),
    "consolidated_output": (consolidated_output, f"WITH {ORDERS_D} SELECT * EXCLUDE (key_d) FROM (SELECT DISTINCT *, {_NAMES} AS check_ids, 'orders_d' AS tables_in_query FROM orders_d WHERE {_BAD})"),
    "row_quality": (row_quality, f"WITH {ORDERS_D} SELECT n AS total_rows, b AS records_with_issues, n - b AS clean_records FROM (SELECT (SELECT count(*) FROM orders_d) AS n, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders_d WHERE {_BAD})) AS b)"),
    "schema_breakdown": (schema_breakdown, f"WITH {ORDERS_D} SELECT CAST(5 AS BIGINT) AS checks, CAST(2 AS BIGINT) AS passed, CAST(4 AS BIGINT) AS single_checks, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders_d WHERE {_BAD})) AS failed_unique_rows, CAST(1 AS BIGINT) AS multi_checks, (SELECT count(*) FROM orders_d o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL OR c.c_acctbal < 0) AS failed_non_unique_rows"),
    "row_count_capped": (row_count_capped, "SELECT 'row_count_capped' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM lineitem LIMIT 1000)) AS actual_value"),
    "operator_matrix": (operator_matrix, " UNION ALL ".join(f"SELECT '{k}' AS operator, count(*) FILTER (WHERE {c}) AS orders_met FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)" for k, c in {"mustBe": "n = 4", "mustNotBe": "n <> 4", "mustBeGreaterThan": "n > 4", "mustBeGreaterOrEqualTo": "n >= 4", "mustBeLessThan": "n < 4", "mustBeLessOrEqualTo": "n <= 4", "mustBeBetween": "n BETWEEN 2 AND 4", "mustNotBeBetween": "n NOT BETWEEN 2 AND 4"}.items())),
    "security_gate": (security_gate, "SELECT * FROM (VALUES (0, 'accepted'), (1, 'accepted'), (2, 'empty_query'), (3, 'accepted'), (4, 'write_operation'), (5, 'write_operation'), (6, 'injection_statement_stacking'), (7, 'injection_union_injection'), (8, 'injection_union_injection'), (9, 'injection_time_based_injection'), (10, 'injection_schema_probing'), (11, 'injection_file_operation'), (12, 'write_operation'), (13, 'accepted')) AS t(probe, verdict)"),
    "comparison_statuses": (comparison_statuses, " UNION ALL ".join(f"SELECT 'c{i:02d}_{k}' AS check_name, n AS actual_value, CASE WHEN {_met(k, v)} THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT count(*) AS n FROM region)" for i, (k, v) in enumerate(COMPARED))),
    "sql_session_function": (sql_session_function, _sql("sql_session_function", "SELECT count(*) FROM orders WHERE 2 * o_orderkey > 1000", "BIGINT")),
    "src_session_catalog": (src_session_catalog, "SELECT 'src_session_catalog' AS check_name, count(*) AS actual_value FROM supplier WHERE s_acctbal < 0"),
    "src_path_uri": (src_path_uri, "SELECT 'nation' AS check_name, count(*) AS actual_value FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier"),
    "src_local_frame": (src_local_frame, "SELECT 'src_local_frame' AS check_name, count(*) AS actual_value FROM nation WHERE n_regionkey > 2"),
    "column_sql": (column_sql, "SELECT 'big' AS check_name, 'part.p_size' AS target, count(*) AS actual_value, count(*) AS failed_rows FROM part WHERE p_size > 40"),
    "error_statuses": (error_statuses, "SELECT * FROM (VALUES ('kind', 'ERROR'), ('no_such_column_column_exists_check', 'ERROR'), ('no_such_column_required_check', 'ERROR'), ('metric', 'ERROR'), ('function', 'ERROR'), ('table', 'ERROR'), ('write', 'ERROR'), ('fine', 'PASSED')) AS t(check_name, status)"),
    "failed_rows_limited": (failed_rows_limited, "SELECT count(*) AS actual_value, least(count(*), 7) AS rows_shown FROM part WHERE p_size > 40"),
    "report_order": (report_order, "SELECT * FROM (VALUES (0, 'wrong', 'FAILED', FALSE, TRUE), (1, 'error', 'ERROR', FALSE, TRUE), (2, 'a_fine', 'PASSED', FALSE, TRUE), (3, 'b_fine', 'PASSED', FALSE, TRUE)) AS t(place, check_name, status, passed, has_errors)"),
    "custom_engine": (custom_engine, "SELECT 'largest_size' AS check_name, count(*) AS actual_value, CASE WHEN count(*) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, count(*) AS rows FROM part WHERE p_size > 45"),
    "streamed_batches": (streamed_batches, "SELECT 'value_column_exists_check' AS check_name, CAST(0 AS BIGINT) AS actual_value UNION ALL SELECT 'value_logical_type_options_maximum_check', (SELECT count(*) FROM events WHERE value > 100) UNION ALL SELECT 'event_type_column_exists_check', 0 UNION ALL SELECT 'event_type_required_check', (SELECT count(*) FROM events WHERE event_type IS NULL)"),
}


def queries() -> dict[str, Query]:
    out = {}
    for name, (schema, check, _, *more) in CHECKS.items():
        kind, digits, others, filters = (*more, *("bigint", None, (), None)[len(more) :])
        out[name] = _scalar(name, schema, check, kind, digits, others, filters)
    return out | {k: q for k, (q, _) in ROWS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: _sql(name, spec[2], "DOUBLE" if len(spec) > 3 and spec[3] == "double" else "BIGINT") for name, spec in CHECKS.items()}
    return out | {k: s for k, (_, s) in ROWS.items() if s}
