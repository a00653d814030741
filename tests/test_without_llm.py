"""The library stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from folio.plans.registry import QUERIES

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"


@pytest.mark.parametrize("gone", [["folio/llm", "tests/llm"], ["folio/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".*_cache", "spark-warehouse"))
    for name in gone:
        (shutil.rmtree if (copy / name).is_dir() else Path.unlink)(copy / name) if (copy / name).exists() else None
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES)), "0"], out.stderr
