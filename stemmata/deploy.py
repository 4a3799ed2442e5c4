"""Making the package importable where Python workers run."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path, for executors that share this file system. Others need --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HERE not in paths:
        env["PYTHONPATH"] = os.pathsep.join([HERE, *paths])


def deployed(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run
