"""Tables written in the middle of a job, to cut lineage or to be read more than once.

They live in the folder that the session names in ``spark.checkpoint.dir``, which every executor
shares, so a lost executor loses nothing. Only where that setting is absent and all work is done by one process (tests, a laptop) is a
folder of our own used; on a cluster without the setting nothing is written, since each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder; where none is configured, one temporary folder per process in local mode, and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="stemmata-"))
    return _OWN[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone; leftovers are only disk
        pass


class Scratch:
    """A family of written tables. ``put`` writes and reads back, ``drop`` removes one early.

    Whatever is not dropped is removed when the Python process ends, since lazily planned results
    may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/stemmata-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(_delete, spark, self.base)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._stemmata_keep = self  # the id above stays valid while the table is in use
        return back

    def folder(self) -> str:
        """A path of the family for tables in other formats."""
        self.count += 1
        return f"{self.base}/{self.count - 1}"

    def clear(self) -> None:
        """Remove all tables of the family."""
        self.paths.clear()
        _delete(self.spark, self.base)

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)
