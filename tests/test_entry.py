"""The driver's contract with the training-data parts taken away."""

import os
import shutil
import subprocess
import sys

import pytest

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), sorted(k for k in [*q, *s] if k.startswith('op') or k == 'pipeline'))"


@pytest.mark.parametrize("without", [["strandloom/llm", "tests/llm"], ["strandloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_training_data_parts(tmp_path, without):
    tree = tmp_path / "tree"
    shutil.copytree(_ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = tree / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", _ASK], cwd=tree, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n_queries, n_sql, left = out.stdout.strip().split(" ", 2)
    assert int(n_queries) >= 60 and int(n_sql) >= 50 and left == "[]"
