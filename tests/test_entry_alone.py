"""The entry point and the library without the training-data folders and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_imports_without_training_data_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", *gone))
    code = ("import __spark_entry__ as E; names = set(E.queries()); assert 'map_orders' in names and 'pipeline' not in names; "
            "assert not any(n.startswith('op') and n[2].isdigit() for n in names); assert set(E.oracle_sql()) <= names")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stdout[-2000:]
