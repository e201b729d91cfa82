import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import odd  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return odd.odd_docs(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    return odd.empty_docs(spark)


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest table with their rows."""
    return spark.read.parquet(f"{odd.SF}/documents.parquet"), odd.corpus()
