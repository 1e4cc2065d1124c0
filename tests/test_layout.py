"""The library stands without its training-data subpackage."""

import ast
import importlib.util
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield "." * node.level + (node.module or "")


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "pactlane").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name.split(".") or name == "corpus_pipeline" for name in imported(path)), path


def test_entry_without_the_subpackage(monkeypatch):
    """As if the folders were deleted: the finder knows neither the subpackage nor the pipeline."""
    real = importlib.util.find_spec
    hidden = lambda name, *a: None if name.startswith(("pactlane.llm", "corpus_pipeline")) else real(name, *a)
    monkeypatch.setattr(importlib.util, "find_spec", hidden)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "find_spec", hidden)
    assert "chk_required" in entry.queries() and not any(k.startswith("op1_") or k == "pipeline" for k in entry.queries())
