import json

import pytest

from pactlane import Contract
from pactlane.contracts import ContractError
from pactlane.contracts.contract import _raw_address

BASE = dict(id="c1", status="active", version="1", kind="DataContract", apiVersion="v3.1.0")


def count(rest):
    return f"SELECT COUNT(*) FROM {rest}"


def totals(result):
    return result.summary["validation_summary"]["total_rows_by_schema"]


def make(**more):
    return Contract({**BASE, **more})


def test_load_yaml_and_json(tmp_path):
    (tmp_path / "a.yaml").write_text("\n".join(f"{k}: {v!r}" for k, v in BASE.items()))
    (tmp_path / "b.json").write_text(json.dumps(BASE))
    for name in ("a.yaml", "b.json"):
        c = Contract.load(tmp_path / name)
        assert c.get_metadata()["id"] == "c1" and c.get_api_version() == "v3.1.0" and c.get_version() == "1"


def test_load_problems(tmp_path):
    with pytest.raises(FileNotFoundError):
        Contract.load(tmp_path / "none.yaml")
    (tmp_path / "e.yaml").write_text("")
    with pytest.raises(ValueError, match="empty"):
        Contract.load(tmp_path / "e.yaml")
    import yaml

    (tmp_path / "m.yaml").write_text("a: [")
    with pytest.raises(yaml.YAMLError):
        Contract.load(tmp_path / "m.yaml")
    (tmp_path / "b.yaml").write_bytes(b"\xff\xfe\xfa")
    with pytest.raises(OSError):
        Contract.load(tmp_path / "b.yaml")


@pytest.mark.parametrize("change", [{"apiVersion": None}, {"apiVersion": "v9"}])
def test_versions(change):
    with pytest.raises(ValueError):
        make(**change)


@pytest.mark.parametrize(
    "change",
    [
        {"status": None}, {"kind": "Other"}, {"servers": [{"server": "x"}]}, {"schema": [{"properties": [{"logicalType": "string"}]}]}, {"schema": [{"properties": [{"logicalType": "text", "name": "a"}]}]},
        {"schema": [{"quality": [{"type": "sql"}]}]}, {"schema": [{"quality": [{"type": "custom", "engine": "x"}]}]}, {"schema": [{"quality": [{"type": "library"}]}]}, {"schema": [{"quality": [{"query": "q", "type": "sql", "dimension": "odd"}]}]},
        {"schema": [{"quality": [{"query": "q", "type": "sql", "mustBeBetween": [1]}]}]},
    ],
)
def test_structure(change):
    with pytest.raises(ContractError):
        make(**change)


def test_old_version_has_no_schemas():
    assert Contract({"apiVersion": "v2.2.2", "dataset": [{"table": "t"}]}).get_schema_names() == []


def test_paths():
    c = make(schema=[{"name": "t", "properties": [{"name": "a"}, {"name": "b"}]}])
    assert c.resolve("$.schema[0].properties[1].name") == "b"
    assert c.resolve("$.schema[4]") is None
    assert c.resolve_parent("$.a[0].b[1].c[0]", 2) == "$.a[0]"
    with pytest.warns(UserWarning):
        assert c.resolve("$.schema[0].properties[*].name") == "a"
    with pytest.warns(UserWarning):
        assert c.resolve("not a path") is None
    assert list(c.get_schema_properties()) == ["a", "b"]


def test_servers():
    c = make(servers=[{"server": "a", "type": "x"}, {"server": "b", "type": "x", "environment": "prod"}])
    assert c.get_server()["server"] == "a" and c.get_server("prod")["server"] == "b"
    with pytest.raises(ValueError):
        c.get_server("z")
    with pytest.raises(ValueError):
        make().get_server()


def test_raw_addresses():
    assert _raw_address("https://github.com/o/r/blob/main/c.yaml") == "https://raw.githubusercontent.com/o/r/main/c.yaml"
    assert _raw_address("https://git.example.org/o/r/-/blob/main/c.yaml") == "https://git.example.org/o/r/-/raw/main/c.yaml"
    with pytest.raises(OSError):
        Contract.load("http://127.0.0.1:9/none.yaml")
