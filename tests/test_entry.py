"""The contract without the operators for training data, and without what they import."""

import os
import shutil
import subprocess
import sys

import pytest

from panelforge.plans.catalog import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
WITHOUT = "import sys; sys.modules['{}'] = None; "


def names(folder, before=""):
    done = subprocess.run(
        [sys.executable, "-B", "-c", before + LIST],
        cwd=folder,
        env={**os.environ, "PYTHONPATH": str(folder)},
        capture_output=True,
        text=True,
        timeout=120,
    )
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.fixture
def copy(tmp_path):
    """A copy of what the contract imports, without the operators for training data."""
    for name in ("panelforge", "oracle"):
        shutil.copytree(
            os.path.join(ROOT, name),
            tmp_path / name,
            ignore=shutil.ignore_patterns("llm", "__pycache__"),
        )
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    return tmp_path


def test_without_the_folder(copy):
    assert names(copy) == sorted(QUERIES)


def test_with_an_empty_folder(copy):
    (copy / "panelforge" / "llm" / "__pycache__").mkdir(parents=True)
    assert names(copy) == sorted(QUERIES)


def test_without_a_library_that_they_need():
    assert names(ROOT, WITHOUT.format("regex")) == sorted(QUERIES)
