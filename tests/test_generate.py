import warnings

import pytest

from pactlane.plans import ir
from pactlane.plans.generate import checks_by_schema

from .test_contract import make


def checks(schema):
    return checks_by_schema(make(schema=[schema]))[schema["name"]]


def test_order_and_names():
    found = checks({
        "name": "t",
        "properties": [{"logicalType": "integer", "name": "a", "logicalTypeOptions": {"maximum": 3, "minimum": 1}, "required": True, "primaryKey": True, "unique": True, "quality": [{"metric": "nullValues", "type": "library", "mustBe": 0}]}],
        "quality": [{"metric": "rowCount", "type": "library", "mustBeGreaterThan": 0}],
    })
    assert [c.name for c in found] == [
        "a_column_exists_check", "a_logical_type_check", "a_logical_type_options_maximum_check", "a_logical_type_options_minimum_check", "a_required_check", "a_unique_check", "a_primary_key_check", "t_rowCount", "a_nullValues",
    ]
    assert found[0].path == "$.schema[0].properties[0]" and found[-1].path == found[0].path + ".quality[0]"
    assert found[-1].target == "t.a" and found[-2].target == "t"


def test_unchecked_types_and_options():
    with pytest.warns(UserWarning):
        assert [c.name for c in checks({"name": "t", "properties": [{"logicalType": "object", "name": "a", "logicalTypeOptions": {"odd": 1, "pattern": None}}]})] == ["a_column_exists_check"]


@pytest.mark.parametrize(
    "entry, node",
    [
        ({"metric": "odd", "type": "library"}, ir.Unusable), ({"metric": "invalidValues", "type": "library"}, ir.Unusable), ({"metric": "nullValues"}, ir.Nulls), ({"query": "SELECT 1", "type": "sql"}, ir.SqlQuery),
        ({"name": "n"}, ir.Unusable), ({"type": "text"}, ir.Unusable), ({"type": "custom", "engine": "e", "implementation": "i"}, ir.Custom), ({"metric": "nullValues", "type": "library", "unit": "Percent"}, ir.Percent), ({"metric": "missingValues", "type": "library"}, ir.Missing),
    ],
)
def test_listed(entry, node):
    assert isinstance(checks({"name": "t", "properties": [{"name": "a", "quality": [entry]}]})[-1].node, node)


def test_table_level():
    found = checks({"name": "t", "quality": [{"metric": "duplicateValues", "type": "library"}, {"metric": "nullValues", "type": "library"}, {"metric": "rowCount", "type": "library", "unit": "percent"}, {"query": "q", "type": "sql", "id": "i1"}, {"query": "q", "type": "sql", "dimension": "accuracy"}]})
    assert [type(c.node) for c in found] == [ir.Unusable, ir.Unusable, ir.RowCount, ir.SqlQuery, ir.SqlQuery]
    assert [c.name for c in found[3:]] == ["i1", "t_accuracy"]


def test_no_warning_for_plain():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        checks({"name": "t", "properties": [{"logicalType": "string", "name": "a"}]})
