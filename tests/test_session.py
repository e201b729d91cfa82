"""The shared folder."""

import os

import pytest

from panelforge import session


class Cluster:
    """Stands in for a session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "yarn"


def test_a_cluster_must_name_the_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_tables_go_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    df = session.materialize(spark.range(10), "ten")
    assert df.count() == 10
    assert all(named in path for path in df.inputFiles())
    assert os.path.isdir(f"{named}/panelforge/{spark.sparkContext.applicationId}")


def test_an_empty_table_keeps_its_columns(spark):
    df = session.materialize(spark.range(0).toDF("k"), "none")
    assert df.columns == ["k"]
    assert df.count() == 0
