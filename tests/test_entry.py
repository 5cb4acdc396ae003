"""The entry point imports in a fresh process, with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", [[], ["casebook.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_entry_imports(hidden):
    code = f"""
import importlib.util, pyspark, sys
pyspark.__file__ = "/nowhere/__init__.py"
find, hidden = importlib.util.find_spec, {hidden!r}
importlib.util.find_spec = lambda name, *a: None if name in hidden else find(name, *a)
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names and len(names) >= 139
print(sum(n.startswith("op") and n[2:].split("_")[0].isdigit() for n in names), "pipeline" in names)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=100)
    assert out.returncode == 0, out.stderr[-800:]
    if "casebook.llm" in hidden:
        assert out.stdout.split() == ["0", "False"]
