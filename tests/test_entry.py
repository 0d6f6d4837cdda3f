from __future__ import annotations

import importlib
import os
import sys
from pathlib import Path

import pytest

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_named_once_and_has_its_oracle():
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).count() > 0


def test_library_works_without_the_training_subpackage():
    """Nothing outside the subpackage imports it, except the guarded entry point."""
    root = Path(__file__).resolve().parents[1]
    for path in (root / "pagewright").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "pagewright.llm" not in path.read_text(), path
    assert "pagewright" in sys.modules
