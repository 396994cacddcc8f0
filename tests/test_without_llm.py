"""The library and its entry point without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), sorted(E.queries()) == sorted(E.catalog.QUERIES))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_llm(tmp_path, pipeline):
    tree = tmp_path / "tree"
    leave = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tree, ignore=leave)
    assert not (tree / "verdikt" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, oracles, same = out.stdout.split()
    assert int(n) >= 47 and int(oracles) >= 47 and same == "True"
