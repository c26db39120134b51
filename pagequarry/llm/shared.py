"""Helpers of the operators: written intermediate tables and bound expressions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pagequarry
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import work_dir

#: White space as the contracts define it, for regular expressions and trims.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Spark's own file server hands the archive to the executors.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(pagequarry.__file__).parent.parent
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/pagequarry.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.glob("pagequarry/**/*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(archive)


def fresh_name(base: str) -> str:
    """A column name that no table brings along."""
    return f"{base}_{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the folder that driver and executors share."""
    return f"{work_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut.

    A lost executor costs the tasks it ran, not the stages before the table.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
