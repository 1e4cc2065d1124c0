"""The engine works as the caller's session would, and leaves it alone."""

import pytest

from pactlane import validate_data
from pactlane.contracts import Contract
from pactlane.execute import Engine
from pactlane.sources.adapters import MultiSourceAdapter, SparkAdapter


def make(query, must=0, table="t"):
    rule = dict(name="c", type="sql", query=query, mustBe=must)
    return Contract(dict(id="s", status="active", version="1", kind="DataContract", apiVersion="v3.1.0", schema=[dict(name=table, quality=[rule])]))


@pytest.fixture
def settings(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}
    yield spark.conf
    for k, v in before.items():
        spark.conf.set(k, v)


def test_time_zone_and_settings(spark, settings):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 20:00:00Z' AS ts")
    query = "SELECT COUNT(*) FROM t WHERE CAST(ts AS DATE) = DATE '2024-01-02'"
    for zone, n in (("Asia/Tokyo", 1), ("UTC", 0)):
        settings.set("spark.sql.session.timeZone", zone)
        settings.set("spark.sql.shuffle.partitions", "77")
        assert validate_data(make(query, n), df=df).passed
        engine = Engine(MultiSourceAdapter({"t": SparkAdapter(spark, {"t": df})}))
        assert engine.spark.conf.get("spark.sql.session.timeZone") == zone and engine.spark.conf.get("spark.sql.shuffle.partitions") == "77"
        assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_registered_functions(spark):
    spark.udf.register("plus1_of_test", lambda a: a + 1, "bigint")
    r = validate_data(make("SELECT COUNT(*) FROM t WHERE plus1_of_test(id) > 2"), df=spark.range(4)).check_results[0]
    assert r.actual_value == 2 and r.status == "FAILED" and r.failed_rows.count() == 2


def test_current_database_and_views(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pactlane_test")
    spark.sql("USE pactlane_test")
    try:
        spark.sql("CREATE TABLE IF NOT EXISTS pactlane_test.inner_t AS SELECT 7 AS a")
        spark.range(3).createOrReplaceTempView("view_of_test")
        assert validate_data(make("SELECT MAX(a) FROM inner_t", 7, "inner_t"), spark_session=spark).passed
        assert validate_data(make("SELECT COUNT(*) FROM view_of_test", 3, "view_of_test"), spark_session=spark).passed
        assert spark.table("view_of_test").count() == 3 and spark.catalog.currentDatabase() == "pactlane_test"
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE pactlane_test CASCADE")


def test_left_out_safe_casts_are_told(spark):
    results = validate_data(make("SELECT COUNT(*) FROM t WHERE no_such_column > 1"), df=spark.range(2)).check_results
    assert results[0].status == "ERROR" and "no_such_column" in results[0].metadata["safe_casts_left_out"]
