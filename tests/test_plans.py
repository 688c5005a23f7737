"""Plan modules: what a query calls must be what its module says under that name."""

import ast
from collections import Counter
from pathlib import Path

import pytest

import loomgrade.plans

MODULES = sorted(Path(loomgrade.plans.__file__).parent.glob("*.py"))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: p.stem)
def test_no_function_replaces_another(path):
    """contract_violations once called a helper that a later one of the same name had replaced."""
    names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef))
    assert [n for n, times in names.items() if times > 1] == []
