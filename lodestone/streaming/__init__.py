"""Continuous extraction: source files that arrive in a folder, as a stream.

Every operator works on one file at a time up to resolution, so a stream of
files can be extracted as it comes; resolution needs all definitions and stays a
batch over what has been stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import extract
from ..sources.scan import is_wanted
from ..functions.names import language_of


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``path, lang, text`` of Parquet files of ``path, text`` as they arrive."""
    rows = spark.readStream.schema("path string, text string").parquet(folder)
    return rows.filter(is_wanted("path") & F.col("text").isNotNull()).select("path", language_of("path").alias("lang"), "text")


def extract_stream(sources: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Extract every file of a stream once and append the rows at ``path``."""
    trigger = trigger or {"availableNow": True}
    found = extract.extract(sources)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
