"""Input tables and vocabulary files of the queries."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
WORD_BPE = "word_bpe_49k.json"
# Rows of long texts that go to Python at a time; Spark's default is for short rows.
BATCH_ROWS, DEFAULT_BATCH_ROWS = "1000", "10000"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a local session's workers get the import path of this package."""
    context = spark.sparkContext
    if context.master.startswith("local["):
        known = context.environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(path: str | None = None) -> str:
    """The path given, or that of the public word vocabulary, on whichever machine asks."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def bounded_batches(docs: DataFrame) -> None:
    """Have the session send fewer rows to Python at a time, unless its owner set a number.

    Spark reads this when a query runs, so it has to stay set; it changes no result.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if conf.get(key) == DEFAULT_BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that the document operators read."""
    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))


def schema(**columns: str) -> T.StructType:
    return T.StructType(
        [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in columns.items()]
    )
