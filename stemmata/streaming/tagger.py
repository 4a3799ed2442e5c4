"""Tagging match records as they arrive, against control ranges that are already known.

The batch tagger in ``operators.topos`` needs the whole record set for its reports; the tag of one record only needs the
control ranges, so records can be tagged in a stream. Nothing is kept between batches, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemmata.operators.topos import tag_global
from stemmata.sources.readers import RECORD


def arriving(spark: SparkSession, folder: str, schema: str = RECORD) -> DataFrame:
    """Records from JSON-lines files that are put into a folder."""
    return spark.readStream.schema(schema).json(folder)


def tag_stream(records: DataFrame, controls: DataFrame, out: str, checkpoint: str, least: float = 0.5) -> StreamingQuery:
    """Append tagged records to ``out``; each batch is tagged by the batch operator. ``controls`` are static records; ranges come from word_range_i and word_range_j."""

    def ranged(df: DataFrame) -> DataFrame:
        pattern = r"^\s*(\d+)\s*[–-]\s*(\d+)\s*$"
        for s in "ij":
            part = lambda n: F.when(F.col(f"word_range_{s}").rlike(pattern), F.regexp_extract(f"word_range_{s}", pattern, n).cast("int"))  # noqa: B023, E731
            df = df.withColumn(f"lo_{s}", part(1)).withColumn(f"hi_{s}", part(2))
        return df

    fixed = ranged(controls)

    def each(batch: DataFrame, _: int) -> None:
        rows = ranged(batch).withColumn("match_id", F.monotonically_increasing_id())
        rows = rows.persist()
        try:
            tag_global(rows, fixed, least).drop("match_id", "lo_i", "hi_i", "lo_j", "hi_j").write.mode("append").parquet(out)
        finally:
            rows.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
