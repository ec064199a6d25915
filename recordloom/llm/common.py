"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Texts may be long, so Arrow batches are kept small in rows and in bytes (one longer text is a batch of its own).
ARROW_ROWS = 256
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to Python workers and bound the rows and bytes of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_recordloom_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if context.master.startswith("local["):
            paths = [root] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != root]
            context.environment["PYTHONPATH"] = os.pathsep.join(paths)
        else:
            base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "recordloom")
            context.addPyFile(shutil.make_archive(base, "zip", root, "recordloom"))
        context._recordloom_shipped = True
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text (runs free of ASCII white space), null text as no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


