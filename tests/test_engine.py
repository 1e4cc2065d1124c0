import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pactlane import BaseExecutor, CheckResult, MultiSourceAdapter, SparkAdapter, SparkExecutor, ValidationConfig, validate_data
from pactlane.execute import Engine
from pactlane.operators.compare import expectation, holds

from .test_contract import count, make, totals


def run(df, schema, **more):
    return {c.check_name: c for c in validate_data(make(schema=[{"name": "t", **schema}]), df=df, **more).check_results}


def values(df, schema, **more):
    return {k: (c.status, c.actual_value) for k, c in run(df, schema, **more).items()}


@pytest.mark.parametrize(
    "operator, expected, actual, want",
    [
        ("mustBe", 3, 3, True), ("mustBe", 3, None, False), ("mustNotBe", 3, 4, True), ("mustBeGreaterThan", 3, 3, False), ("mustBeGreaterOrEqualTo", 3, 3, True), ("mustBeLessThan", 3, 2, True), ("mustBeLessOrEqualTo", 3, 4, False),
        ("mustBeBetween", [1, 3], 3, True), ("mustNotBeBetween", [1, 3], 3, False), ("unknown", None, 0, False),
    ],
)
def test_comparisons(operator, expected, actual, want):
    assert holds(operator, actual, expected) is want


def test_expectation_order():
    assert expectation({"mustBeLessThan": 2, "mustNotBe": 0}) == ("mustNotBe", 0)
    assert expectation({"mustBe": 0}) == ("mustBe", 0)
    assert expectation({}) == ("unknown", None)
    with pytest.raises(TypeError):
        holds("mustBeLessThan", None, 3)


def test_integrality(spark):
    df = spark.createDataFrame([("44",), ("44.0",), ("44.5",), ("abc",), (None,)], "id string")
    r = run(df, {"properties": [{"logicalType": "integer", "name": "id"}]})["id_logical_type_check"]
    assert r.actual_value == 2 and sorted(x.id for x in r.failed_rows.collect()) == ["44.5", "abc"]


@pytest.mark.parametrize(
    "kind, texts, bad",
    [
        ("number", ["1", "1.5", "1e3", "1d", "x", "NaN", None], 2), ("boolean", ["true", "F", "1", "no", "maybe", "2"], 2), ("date", ["2020-01-02", "2020-1-2", "2020-01", "2020", "2020-13-01", "x"], 4),
        ("timestamp", ["2020-01-02 03:04:05", "2020-01-02", "2020-01", "x"], 2), ("time", ["03:04:05", "25:00:00", "x"], 2), ("string", ["a", None], 0),
    ],
)
def test_types_of_text(spark, kind, texts, bad):
    df = spark.createDataFrame([(x,) for x in texts], "c string")
    assert run(df, {"properties": [{"logicalType": kind, "name": "c"}]})["c_logical_type_check"].actual_value == bad


@pytest.mark.parametrize(
    "spark_type, kind, bad",
    [("int", "date", 1), ("date", "integer", 1), ("boolean", "date", 1), ("timestamp", "integer", 1), ("int", "timestamp", 1), ("int", "boolean", 0), ("double", "integer", 0), ("decimal(9,2)", "number", 0), ("date", "timestamp", 0), ("timestamp_ntz", "date", 0), ("array<int>", "number", 1), ("map<string,int>", "string", 0)],
)
def test_static_types(spark, spark_type, kind, bad):
    text = {"array<int>": "array(1)", "map<string,int>": "map('a', 1)"}.get(spark_type, f"CAST({'1' if spark_type in ('int', 'double', 'decimal(9,2)', 'boolean') else repr('2020-01-01')} AS {spark_type})")
    df = spark.sql(f"SELECT {text} AS c UNION ALL SELECT NULL")
    assert run(df, {"properties": [{"logicalType": kind, "name": "c"}]})["c_logical_type_check"].actual_value == bad


def test_options(spark):
    df = spark.createDataFrame([("héé", 1.0), ("a", 5.5), ("abcdef", 10.0), (None, None), ("x'y\\d", 0.3)], "s string, n double")
    options = {"minLength": 3, "maxLength": 5, "pattern": r"^[\w']+$"}
    numbers = {"minimum": 1, "maximum": 5.5, "exclusiveMinimum": 1, "exclusiveMaximum": 10, "multipleOf": 0.1}
    got = values(df, {"properties": [{"name": "s", "logicalTypeOptions": options}, {"name": "n", "logicalTypeOptions": numbers}]})
    want = {"s_minLength": 1, "s_maxLength": 1, "s_pattern": 2, "n_minimum": 1, "n_maximum": 1, "n_exclusiveMinimum": 2, "n_exclusiveMaximum": 1}
    for k, n in want.items():
        column, option = k.split("_")
        assert got[f"{column}_logical_type_options_{option}_check"][1] == n, k
    assert got["n_logical_type_options_multipleOf_check"][1] == sum(x % 0.1 != 0 for x in (1.0, 5.5, 10.0, 0.3))


def test_multiple_of_zero_is_an_error(spark):
    assert values(spark.range(1), {"properties": [{"name": "id", "logicalTypeOptions": {"multipleOf": 0}}]})["id_logical_type_options_multipleOf_check"][0] == "ERROR"


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (None, "b"), (None, "b"), (3, "c")], "k int, s string")
    spec = {"properties": [{"unique": True, "name": "k", "primaryKey": True, "quality": [{"metric": "duplicateValues", "type": "library", "mustBe": 0}, {"metric": "duplicateValues", "type": "library", "name": "p", "unit": "percent", "mustBe": 0}]}], "quality": [{"metric": "duplicateValues", "type": "library", "arguments": {"properties": ["k", "s"]}, "mustBe": 0}]}
    got = run(df, spec)
    assert (got["k_unique_check"].actual_value, got["k_primary_key_check"].actual_value, got["k_duplicateValues"].actual_value, got["t_duplicateValues"].actual_value) == (2, 4, 2, 1)
    assert got["p"].actual_value == pytest.approx(2 * 100 / 7)
    assert [tuple(r) for r in got["t_duplicateValues"].failed_rows.collect()] == [(1, "a")]
    assert got["k_primary_key_check"].failed_rows_count == 0 and not got["k_primary_key_check"].supports_row_level_output
    assert got["k_unique_check"].failed_rows_count == 2


def test_missing_column_is_an_error(spark):
    got = values(spark.range(2), {"properties": [dict(name="id"), {"required": True, "name": "email"}]})
    assert got == {"id_column_exists_check": ("PASSED", 0), "email_column_exists_check": ("ERROR", None), "email_required_check": ("ERROR", None)}


def test_case_and_odd_names(spark):
    df = spark.createDataFrame([(1, None)], "`Od d.c` int, `q``x` string")
    got = values(df, {"properties": [{"name": "od d.c", "required": True, "unique": True}, {"name": "q`x", "required": True}]})
    assert got["q`x_required_check"] == ("FAILED", 1) and got["od d.c_unique_check"] == ("PASSED", 0)


def test_percent_of_empty_table(spark):
    assert values(spark.range(0), {"properties": [{"name": "id", "quality": [{"metric": "nullValues", "unit": "percent", "mustBe": 0}]}]})["id_nullValues"] == ("FAILED", None)


def test_failing_row_count(spark):
    r = run(spark.range(200), {"quality": [{"metric": "rowCount", "type": "library", "mustBeLessThan": 10}]})["t_rowCount"]
    assert r.failed_rows_count == 200 and r.failed_rows.count() == 200


def test_sql_checks(spark):
    df = spark.createDataFrame([("215.0", "2017-jan"), ("44.5", "2017-01"), ("abc", None)], "n string, month string")
    rules = [
        {"name": "safe", "query": count("t WHERE n >= 200"), "mustBe": 0}, {"name": "regex", "query": count(r"t WHERE CAST(month AS TEXT) !~ '^\d{4}-\d{2}$';"), "mustBe": 0}, {"name": "rows", "query": "SELECT n FROM t WHERE n = 'abc'", "mustBe": 0},
        {"name": "alias", "query": "SELECT COUNT(*) AS c FROM t", "mustBe": 0}, {"name": "distinct", "query": "SELECT COUNT(DISTINCT n) FROM t", "mustBe": 0}, {"name": "none", "query": "SELECT n FROM t WHERE FALSE LIMIT 1", "mustBe": 0}, {"name": "typo", "query": count("t WHERE nope = 1"), "mustBe": 0},
        {"name": "percent", "query": count("t"), "mustBe": 0, "unit": "percent"}, {"name": "text", "query": "SELECT MAX(month) FROM t", "mustBeGreaterThan": 3}, {"name": "unknown", "query": count("t")},
    ]
    got = run(df, {"quality": [{"type": "sql", **r} for r in rules]})
    assert {k: (c.status, c.actual_value) for k, c in got.items()} == {
        "safe": ("FAILED", 1), "regex": ("FAILED", 1), "rows": ("FAILED", 1), "alias": ("FAILED", 3), "distinct": ("FAILED", 3), "none": ("PASSED", 0), "typo": ("ERROR", None), "percent": ("FAILED", 3), "text": ("ERROR", "2017-jan"), "unknown": ("FAILED", 3),
    }
    assert [r.n for r in got["safe"].failed_rows.collect()] == ["215.0"]
    assert got["alias"].failed_rows.columns == [] and got["alias"].failed_rows_count == 3
    assert got["distinct"].failed_rows.count() == 3 and got["distinct"].failed_rows_count == 0
    assert got["percent"].failed_rows_count == 0
    assert got["rows"].metadata["aggregation_type"] == "none" and "TRY_CAST" in got["safe"].metadata["rendered_implementation"]


def test_without_safe_casts(spark):
    df = spark.createDataFrame([("x",)], "n string")
    rule = {"quality": [{"name": "q", "type": "sql", "query": count("t WHERE n > 5"), "mustBe": 0}]}
    assert values(df, rule)["q"] == ("PASSED", 0)
    assert values(df, rule, config=ValidationConfig(use_try_cast=False))["q"][0] == "ERROR"


def test_one_bad_rule_is_one_error(spark):
    df = spark.createDataFrame([("1",), ("x",)], "n string")
    rules = [{"name": "bad", "type": "sql", "query": count("t WHERE assert_true(n = '1') IS NOT NULL"), "mustBe": 0}, {"name": "good", "type": "sql", "query": count("t WHERE n = 'x'"), "mustBe": 1}]
    got = values(df, {"quality": rules, "properties": [{"required": True, "name": "n"}]})
    assert got["bad"][0] == "ERROR" and got["good"] == ("PASSED", 1) and got["n_required_check"] == ("PASSED", 0)


def test_security_violation_is_an_error(spark):
    got = run(spark.range(1), {"quality": [{"name": "w", "type": "sql", "query": "DROP TABLE t", "mustBe": 0}]})["w"]
    assert got.status == "ERROR" and got.metadata["security_violation"] == "write_operation"


def test_unsupported_come_first(spark):
    r = validate_data(make(schema=[{"name": "t", "properties": [dict(name="id")], "quality": [{"type": "text", "name": "said"}]}]), df=spark.range(1))
    assert [c.check_name for c in r.check_results] == ["said", "id_column_exists_check"] and r.passed and r.has_errors


def test_custom_engines(spark):
    contract = make(schema=[{"name": "t", "quality": [{"type": "custom", "engine": e, "implementation": i, "name": e, "mustBe": 3} for e, i in (("mine", {"n": 3}), ("absent", "x"), ("sql", "SELECT COUNT(*) FROM t"))]}])
    a = SparkAdapter(spark, {"t": spark.range(3)}, executors={"mine": lambda s, df, check: (df.count(), df.where("id > 0"))})
    got = {c.check_name: c for c in validate_data(contract, adapter=a).check_results}
    assert got["mine"].status == "PASSED" and got["absent"].status == "ERROR" and got["absent"].metadata["schema_name"] == "t" and got["sql"].status == "PASSED"


def test_several_tables(spark):
    pay = spark.createDataFrame([("e1", "p1"), ("e2", "p2"), ("e9", "p9")], "id string, phone string")
    people = spark.createDataFrame([("e1", "p1"), ("e2", "x")], "id string, phone string")
    rule = lambda c: {"type": "sql", "name": f"{c}_known", "query": f"SELECT COUNT(*) FROM pay p LEFT JOIN people l ON p.{c} = l.{c} WHERE l.{c} IS NULL", "mustBe": 0}
    contract = make(schema=[{"name": "pay", "quality": [rule("id"), rule("phone")], "properties": [{"required": True, "name": "id"}]}, {"name": "people", "properties": [{"unique": True, "name": "id"}]}])
    r = validate_data(contract, adapters={"pay": pay, "people": people})
    got = {c.check_name: c for c in r.check_results}
    assert got["id_known"].actual_value == 1 and got["phone_known"].actual_value == 2 and got["id_known"].metadata["multi_source"]
    assert [c.check_name for c in r.check_results][-2:] == ["id_known", "phone_known"]
    rows = got["id_known"].failed_rows
    assert rows.columns == ["id", "phone", "id.1", "phone.1"] and rows.count() == 1
    both = r.get_consolidated_output_dfs(["id_known", "phone_known"])["pay, people"]
    assert {(x["id"], x["check_ids"]) for x in both.collect()} == {("e2", "phone_known"), ("e9", "id_known, phone_known")}
    assert r.schema_breakdown()["pay"].multi_table.failed_non_unique_rows == 3


def test_filters_apply_once_and_everywhere(spark):
    a = SparkAdapter(spark, {"t": spark.range(10), "u": spark.range(10)}, filter_conditions={"t": dict(field="id", operator="<", value=3)})
    contract = make(schema=[{"name": "t", "quality": [{"metric": "rowCount", "type": "library", "mustBe": 3}, {"name": "j", "type": "sql", "query": count("t JOIN u ON t.id = u.id"), "mustBe": 3}]}, {"name": "u"}])
    r = validate_data(contract, adapters=MultiSourceAdapter({"t": a, "u": a}))
    assert r.passed and totals(r) == {"t": 3, "u": 10}
    assert a.export_table_as_arrow("t").num_rows == 3


def test_the_callers_session_stays_as_it_is(spark):
    before = (spark.conf.get("spark.sql.parser.escapedStringLiterals"), [t.name for t in spark.catalog.listTables()])
    validate_data(make(schema=[{"name": "mine", "properties": [{"required": True, "name": "id"}]}]), df=spark.range(2))
    assert before == (spark.conf.get("spark.sql.parser.escapedStringLiterals"), [t.name for t in spark.catalog.listTables()])


def test_row_checks_share_one_scan(spark, monkeypatch):
    asked = []
    contract = make(schema=[{"name": "t", "properties": [{"required": True, "name": "id", "unique": True, "logicalTypeOptions": {"minimum": 0, "maximum": 5}}], "quality": [{"metric": "rowCount", "type": "library", "mustBe": 3}, {"name": "s", "type": "sql", "query": count("t WHERE id > 7"), "mustBe": 0}]}])
    scan, alone = Engine._scan, Engine._alone
    monkeypatch.setattr(Engine, "_scan", lambda self, t, found: (asked.append(len(found)), scan(self, t, found))[1])
    monkeypatch.setattr(Engine, "_alone", lambda self, c: (asked.append("alone"), alone(self, c))[1])
    assert validate_data(contract, df=spark.range(3)).passed and asked == [5]


text = st.one_of(st.none(), st.sampled_from(["", "a", "ab", "44", "44.0", "44.5", "1d", "2020-01-02", "é'\\", "true"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(text, text), max_size=6))
def test_fused_and_single_execution_agree(spark, rows):
    df = spark.createDataFrame(rows, "a string, b string")
    column = lambda c: {"name": c, "required": True, "primaryKey": True, "logicalType": "integer", "unique": True, "logicalTypeOptions": {"minLength": 2, "pattern": "^[a-z']*$", "minimum": 10}, "quality": [{"metric": "missingValues", "arguments": {"missingValues": [None, ""]}, "mustBe": 0}]}
    contract = make(schema=[{"name": "t", "properties": [column("a"), column("b")], "quality": [{"metric": "duplicateValues", "arguments": {"properties": ["a", "b"]}, "mustBe": 0}]}])
    engine = Engine(MultiSourceAdapter({"t": SparkAdapter(spark, {"t": df})}))
    fused = engine.run(contract.get_check_references_by_schema())
    single = []
    for check in contract.get_check_references_by_schema()["t"]:
        c = engine._compile(check)
        if not c.done:
            engine._alone(c)
        single.append((check.name, c.value, str(c.error or "")))
    assert [(r.check_name, r.actual_value) for r in fused] == [(n, v) for n, v, _ in single]


def test_pandas_mixed_column(spark):
    df = pd.DataFrame({"a": [1, "x", None], "b": [1.5, 2.0, None]})
    with pytest.warns(UserWarning, match="a"):
        got = values(df, {"properties": [{"logicalType": "integer", "name": "a"}, {"logicalType": "number", "name": "b", "required": True}]})
    assert got["a_logical_type_check"][1] == 1 and got["b_required_check"][1] == 1


def test_names_of_a_with_clause_are_no_tables(spark):
    engine = Engine(MultiSourceAdapter({"t": SparkAdapter(spark, {"t": spark.range(1)})}))
    assert engine.tables_of("WITH x AS (SELECT * FROM t), y AS (SELECT 1 AS a) SELECT COUNT(*) FROM x JOIN y ON 1 = 1 WHERE id IN (SELECT id FROM db.other)") == ["other", "t"]


def test_executor_interface(spark):
    class Mine(BaseExecutor):
        ended = 0

        def run_single_check(self, check):
            n = self.adapter.table(check.schema).count()
            return CheckResult(check.name, "PASSED" if n == 3 else "FAILED", "counted", n, 3)

        def cleanup(self):
            Mine.ended += 1

    contract = make(schema=[{"name": "t", "properties": [{"required": True, "name": "id", "unique": True}], "quality": [{"type": "custom", "engine": "mine", "implementation": "x", "name": "m", "mustBe": 3}]}])
    adapter = SparkAdapter(spark, {"t": spark.range(3)}, executors={"mine": Mine})
    r = validate_data(contract, adapter=adapter)
    assert r.passed and not r.has_errors and Mine.ended == 1 and r.check_results[-1].metadata["schema_name"] == "t"
    found = contract.get_check_references_by_schema()["t"]
    executor = SparkExecutor(adapter)
    assert [c.check_name for c in executor.run_batch_checks(found)] == [c.name for c in found]
    assert executor.run_single_check(found[1]).status == "PASSED"
    executor.cleanup()
    r.cleanup()


def test_tables_by_identifier(spark):
    from pactlane.operators.guard import to_table

    spark.range(2).createOrReplaceTempView("plain_name")
    assert to_table(spark, "plain_name").count() == 2
