"""The driver's contract, also without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_contract(spark):
    assert entry.entry(spark).columns == ["vertex", "component"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    shutil.copytree(REPO / "wireloom", tmp_path / "wireloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'nets_cc' in q and not any(x.startswith('op') for x in q)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr


def test_nothing_outside_imports_llm():
    for path in (REPO / "wireloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_the_rest_is_collected_without_llm(tmp_path):
    shutil.copytree(REPO / "wireloom", tmp_path / "wireloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(REPO / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and "error" not in said.stdout.lower().splitlines()[-1], said.stdout[-2000:]
