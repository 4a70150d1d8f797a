"""The entry points, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'de_rank_sum' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_other_tests_pass_without_the_subpackage(tmp_path):
    """All of them are found, which imports what they test, and those of readers and sources are run."""
    for name in ("helixframe", "tests"):
        shutil.copytree(f"{REPO}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    for more in (["--collect-only", "tests"], ["tests/test_sources.py"]):
        subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", *more], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, stdout=subprocess.DEVNULL)


def test_nothing_else_names_the_subpackage():
    for root, _, names in os.walk(f"{REPO}/helixframe"):
        for name in names:
            if name.endswith(".py") and "/llm" not in root:
                with open(f"{root}/{name}") as f:
                    assert "helixframe.llm" not in f.read(), name


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
