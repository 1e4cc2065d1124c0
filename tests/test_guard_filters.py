import pytest

from pactlane import FilterCondition, SQLSecurityError
from pactlane.operators import filters, guard


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("", "empty_query"), ("   ", "empty_query"), (";", "no_statements"), ("SELEKT 1", "parse_error"), ("SELECT ( FROM t", "parse_error"), ("DROP TABLE t", "write_operation"), ("INSERT INTO t VALUES (1)", "write_operation"), ("DELETE FROM t", "write_operation"),
        ("UPDATE t SET a = 1", "write_operation"), ("CREATE VIEW v AS SELECT 1", "write_operation"), ("SET a = 1", "write_operation"), ("EXPLAIN SELECT 1", "write_operation"), ("SELECT * INTO x FROM t", "write_operation"), ("SELECT 1 UNION SELECT 2 FROM t", "write_operation"),
        ("SELECT 1 EXCEPT SELECT 2", "write_operation"), ("SELECT 1; DROP TABLE t", "injection_statement_stacking"), ("SELECT a FROM t UNION ALL SELECT 1, 'x' --", "injection_union_injection"), ("SELECT pg_sleep(3)", "injection_time_based_injection"),
        ("SELECT extractvalue(1)", "injection_error_based_injection"), ("SELECT * FROM pg_catalog.x", "injection_schema_probing"), ("SELECT load_file('x')", "injection_file_operation"), ("xp_cmdshell", "injection_command_execution"),
    ],
)
def test_refused(spark, sql, kind):
    with pytest.raises(SQLSecurityError) as e:
        guard.validate_query_security(spark, sql)
    assert e.value.violation_type == kind and len(e.value.query) <= 500


@pytest.mark.parametrize("sql", ["SELECT 1", "SELECT a FROM t WHERE b = 'drop table; x'", "WITH x AS (SELECT 1 a) SELECT COUNT(*) FROM x", "SELECT 1; SELECT 2", "SELECT COUNT(*) FROM (SELECT a FROM t UNION SELECT b FROM u)", "SELECT a FROM t ORDER BY a LIMIT 3", "SELECT DISTINCT a FROM t", "SELECT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1"])
def test_accepted(spark, sql):
    guard.validate_query_security(spark, sql)


def test_parsing_has_no_effect(spark):
    with pytest.raises(SQLSecurityError):
        guard.validate_query_security(spark, "CREATE OR REPLACE TEMP VIEW never AS SELECT 1")
    assert not spark.catalog.tableExists("never")


def test_identifiers():
    assert guard.sanitize_identifier("a.b_1") == "a.b_1"
    for bad, kind in (("", "empty_identifier"), ("a b", "invalid_identifier"), ("1a", "invalid_identifier"), ("a;--", "invalid_identifier")):
        with pytest.raises(SQLSecurityError) as e:
            guard.sanitize_identifier(bad)
        assert e.value.violation_type == kind


@pytest.mark.parametrize(
    "operator, value, want",
    [
        ("=", 2, [2]), ("!=", 2, [1, 3]), (">", 1, [2, 3]), (">=", 3, [3]), ("<", 2, [1]), ("<=", 2, [1, 2]), ("in", [1, 3], [1, 3]), ("IN", 2, [2]), ("NOT IN", [1], [2, 3]), ("IS NULL", None, [None]), ("IS NOT NULL", None, [1, 2, 3]),
    ],
)
def test_operators(spark, operator, value, want):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "a int")
    assert [r.a for r in filters.apply(df, [FilterCondition("a", operator, value)]).collect()] == want


def test_like_text_numbers_and_unknown(spark):
    df = spark.createDataFrame([("5",), ("x1",), ("40.5",), (None,)], "s string")
    assert [r.s for r in filters.apply(df, [FilterCondition("s", "LIKE", "x%")]).collect()] == ["x1"]
    assert [r.s for r in filters.apply(df, [FilterCondition("s", "NOT LIKE", "x%")]).collect()] == ["5", "40.5"]
    assert [r.s for r in filters.apply(df, [FilterCondition("s", ">", 5)]).collect()] == ["40.5"]
    with pytest.raises(ValueError):
        FilterCondition("s", "~", 1).column()


def test_patterns_combine():
    given = {"us*": [{"field": "a", "operator": "=", "value": 1}], "users": FilterCondition("b", "=", 2), "u[x]*": {"field": "c", "operator": "=", "value": 3}}
    assert [c.field for c in filters.for_table(given, "users")] == ["a", "b"]
    assert filters.for_table(given, "orders") == [] and filters.for_table(None, "users") == []


def test_filter_reaches_the_scan(spark, sf_dir):
    df = filters.apply(spark.read.parquet(f"{sf_dir}/orders.parquet"), [FilterCondition("o_orderkey", ">=", 10)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,10)]" in plan
