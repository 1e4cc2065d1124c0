import json

import pandas as pd
import pyarrow as pa
import pytest

from pactlane import BaseAdapter, DataSourceMapper, MultiSourceAdapter, SparkAdapter, ValidationConfig, create_adapter, get_adapter, validate_data, validate_stream
from pactlane.report import ascii_table, percent, share
from pactlane.sources.adapters import jdbc_reader, path_reader

from .test_contract import count, make, totals

ONE = {"name": "t", "properties": [{"required": True, "name": "id"}]}


def test_exactly_one_source(spark):
    c = make(schema=[ONE])
    with pytest.raises(ValueError):
        validate_data(c)
    with pytest.raises(ValueError):
        validate_data(c, df=spark.range(1), spark_session=spark)
    with pytest.raises(TypeError):
        validate_data(c, adapter=MultiSourceAdapter({"t": SparkAdapter(spark)}))
    with pytest.raises(ValueError):
        validate_data(make(), df=spark.range(1))


def test_sources(spark, tmp_path):
    c = make(schema=[ONE])
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(3).write.option("header", True).csv(f"{tmp_path}/t.csv")
    spark.range(3).createOrReplaceTempView("t")
    arrow = pa.table({"id": list(range(1, 4))})
    for given in ({"df": spark.range(3)}, {"df": pd.DataFrame({"id": [1, 2, 3]})}, {"df": arrow}, {"df": arrow.to_batches()[0]}, {"spark_session": spark}, {"connection_str": f"{tmp_path}/{{table}}.parquet"}, {"connection_str": f"csv:{tmp_path}/t.csv"}, {"adapters": {"t": spark.range(3)}}, {"adapter": SparkAdapter(spark)}):
        r = validate_data(c, **given)
        assert totals(r) == {"t": 3} and r.passed and not r.has_errors
    spark.catalog.dropTempView("t")


def test_adapters(spark):
    a = SparkAdapter(spark, {"t": spark.range(3)})
    assert get_adapter(a) is a and DataSourceMapper().get_adapter(a) is a and create_adapter(spark.range(1)).table("source_data").count() == 1
    assert a.get_total_rows("t", 2) == 2 and a.get_total_rows("none") == 0 and a.test_connection("t") is None and a.test_connection("none")
    assert a.is_compatible_with(SparkAdapter(spark)) and a.get_sql_dialect() == "spark" and not a.has_filter_conditions
    a.filter_conditions["x"] = 1
    assert a.filter_conditions == {}

    class Other(BaseAdapter):
        pass

    for bad in (Other(), object(), 3):
        with pytest.raises(TypeError):
            get_adapter(bad)
    with pytest.raises(NotImplementedError):
        Other().table("t")
    with pytest.raises(ValueError):
        path_reader(spark, "/some/where")
    assert callable(jdbc_reader(spark, "postgresql://u:p@h:5432/d"))


def test_registry_rules(spark):
    c = make(schema=[ONE])
    with pytest.warns(UserWarning):
        validate_data(c, adapters={"t": spark.range(1), "other": spark.range(1)})
    with pytest.raises(ValueError):
        validate_data(c, adapters={"other": spark.range(1)})


def test_unreadable_and_undeclared_tables(spark):
    spark.range(1).createOrReplaceTempView("loose")
    c = make(schema=[{"name": "gone", "properties": [dict(name="id")], "quality": [{"name": "q", "type": "sql", "query": count("loose"), "mustBe": 1}]}])
    with pytest.warns(UserWarning):
        r = validate_data(c, spark_session=spark)
    assert {x.check_name: x.status for x in r.check_results} == {"gone_column_exists_check".replace("gone", "id"): "ERROR", "q": "PASSED"}
    connections = r.summary["validation_summary"]["connection_results"]["gone"]
    assert connections["loose"] == "success" and connections["gone"] != "success"
    spark.catalog.dropTempView("loose")


@pytest.fixture(scope="module")
def result(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (4, None), (5, "c")], "id int, s string")
    schema = {
        "name": "t", "properties": [{"required": True, "name": "id", "unique": True}, {"required": True, "name": "s"}, {"required": True, "name": "lost"}],
        "quality": [{"name": "large", "type": "sql", "query": count("t WHERE id > 3 OR id IS NULL"), "mustBe": 0, "severity": "high", "tags": ["x"]}],
    }
    return validate_data(make(schema=[schema]), df=df)


def test_summary(result):
    s = result.summary["validation_summary"]
    assert (s["total_checks"], s["passed"], s["failed"], s["errors"]) == (8, 2, 4, 2) and s["failed_rows"] == 1 + 1 + 1 + 3
    assert s["success_rate"] == 25 and not result.passed and result.contract_id == "c1" and result.api_version == "v3.1.0"
    json.dumps(result.summary, default=str)


def test_row_quality(result):
    q = result.row_quality()["t"]
    # rows (None, b), (4, null), (5, c) break a row rule; the repeated key 1 counts as a row of its own
    assert (q.total_rows, q.records_with_issues, q.clean_records, q.data_quality) == (5, 4, 1, 20.0)
    b = result.schema_breakdown()["t"]
    assert b.overall.total_checks == 8 and b.single_table.failed_unique_rows == 4 and b.multi_table.total_checks == 0


def test_outputs(result):
    each = result.get_output_dfs()
    assert list(each) == sorted(each) and "t::lost_required_check" not in each and each["t::large"].columns == ["id", "s", "check_id", "tables_in_query"]
    assert list(result.get_output_dfs(["large"])) == ["t::large"]
    both = result.get_consolidated_output_dfs()
    assert set(both) == {"t__1", "t__2"}
    rows = {(r["id"], r["s"]): r["check_ids"] for df in both.values() if "s" in df.columns for r in df.collect()}
    assert rows == {(None, "b"): "id_required_check, large", (4, None): "large, s_required_check", (5, "c"): "large"}


def test_table_of_checks(result):
    df = result.get_check_results_df()
    assert df.columns[:4] == "check_name target schema_name engine".split() and df.count() == 8
    row = df.where("check_name = 'large'").first()
    assert row.actual_value == "3" and row.severity == "high" and row.tags == "['x']" and row.failed_rows_count == 3


def test_sorting_and_reports(result, capsys):
    assert [c.status for c in result.sorted_checks()] == ["FAILED"] * 4 + ["ERROR"] * 2 + ["PASSED"] * 2
    assert result.display_full_report(2) is result and result.show_failed_checks() is result
    said = capsys.readouterr().out
    assert "checks in error 2" in said and "large" in said and "| id" in said
    assert percent(99.99) == "99.9%" and percent(None) == "-" and share(0, 0) == "0 / 0 (100.0%)"
    assert ascii_table(["a"], [["x" * 80], [None]], {1}).count("+") == 8


def test_save(result, tmp_path, spark):
    result.save(str(tmp_path), "run")
    assert {p.name for p in tmp_path.iterdir()} == {"run_check_results.csv", "run_summary.json", "run_t__1.csv", "run_t__2.csv"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/run_t__1.csv").count() + spark.read.option("header", True).csv(f"{tmp_path}/run_t__2.csv").count() == 4
    for kind in ("parquet", "json", "orc"):
        result.save_dataframe(spark.range(3), f"{tmp_path}/x_{kind}", kind)
        assert spark.read.format(kind).load(f"{tmp_path}/x_{kind}").count() == 3
    with pytest.raises(ValueError):
        result.save_dataframe(spark.range(3), f"{tmp_path}/y", "odd")


def test_limits(spark):
    c = make(schema=[ONE, {"name": "u"}])
    df = spark.createDataFrame([(None,)] * 9, "id int")
    r = validate_data(c, df=df, config=ValidationConfig(max_failed_rows=2, max_rows_for_statistics=4))
    failed = next(x for x in r.check_results if x.status == "FAILED")
    assert failed.failed_rows.count() == 2 and failed.failed_rows_count == 9 and totals(r) == {"t": 4, "u": 4}
    off = validate_data(c, df=df, config=ValidationConfig(enable_additional_schema_statistics=False))
    assert totals(off) == {} and off.row_quality() == {}


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k,), (None,)] if k == 1 else [(k,)], "id int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = validate_stream(stream, make(schema=[ONE]), on_result=lambda r, k: seen.append(r.passed), checkpoint=f"{tmp_path}/cp", good=f"{tmp_path}/good")
    q.awaitTermination()
    assert sorted(seen) == [False, True, True] and spark.read.parquet(f"{tmp_path}/good").count() == 2
