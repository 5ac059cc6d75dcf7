"""The entry module works without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("cut", [("cairn/llm", "tests/llm"), ("cairn/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_subpackage(tmp_path, cut):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *[c.rsplit("/", 1)[-1] for c in cut]))
    (copy / "cairn/llm/__pycache__").mkdir(parents=True)  # what a deleted package may leave
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"], cwd=copy, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
