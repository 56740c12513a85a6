"""An index of usages (extension): call sites in the order of what they call.

Postings are range-partitioned and sorted by symbol, file, line and place, so the
sites of a common name fill several files of the index, and are read by as many
tasks.  A small table of ranges holds the first and last posting of each file; a
search reads the files whose range holds the symbol and no others, and passes over
row groups by their statistics.

Defined results: every call is one posting, repeated ones included; null targets
are under no symbol and left out.  An empty table gives an index without postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, hashed

#: Postings in a file of the index, about.
RANGE_ROWS = 1 << 20
ORDER = ["symbol", "file_path", "line", "caller", "ordinal"]
POSTINGS = "symbol string, file_path string, line int, caller string, ordinal int"


def write_usages(resolved: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write the postings of resolved calls, and their ranges, under ``path``."""
    # counted, sampled for its ranges and dealt out: resolved once
    with hashed(resolved.sparkSession):
        rows = cut(resolved.select(F.col("target").alias("symbol"), *ORDER[1:]).filter("symbol is not null"))
    parts = max(1, -(-rows.count() // range_rows))
    rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{path}/postings")
    place, ends = F.struct("symbol", "file_path"), ["symbol", "file_path"]
    written = rows.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings").select("*", F.col("_metadata.file_name").alias("part"))
    ranges = written.groupBy("part").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    ranges.select("part", "n", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("low", "high") for c in ends)).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def parts_of(spark: SparkSession, path: str, symbols: list[str], after: str | None = None) -> list[str]:
    """The files of the index that can hold a site of ``symbols`` (in or after the file ``after``)."""
    ranges = spark.read.parquet(f"{path}/ranges")
    hit = F.lit(False)
    for symbol in symbols:
        inside = (F.col("low_symbol") <= symbol) & (F.col("high_symbol") >= symbol)
        if after is not None:
            inside &= ~((F.col("high_symbol") == symbol) & (F.col("high_file_path") < after))
        hit |= inside
    return sorted(r.part for r in ranges.filter(hit).select("part").collect())


def find_usages(spark: SparkSession, path: str, symbols: list[str], after: str | None = None) -> DataFrame:
    """``symbol, file_path, line, caller, ordinal`` of every site of ``symbols``.

    With ``after`` only those in that file and later ones, by path.
    """
    parts = parts_of(spark, path, symbols, after)
    if not parts:
        return spark.createDataFrame([], POSTINGS)
    rows = spark.read.schema(POSTINGS).parquet(*(f"{path}/postings/{part}" for part in parts)).filter(F.col("symbol").isin(*symbols))
    return rows if after is None else rows.filter(F.col("file_path") >= after)


def usage_counts(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, n_sites, n_callers, n_files``, from the whole index."""
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    # Spark counts the two distinct columns by (symbol, caller) and (symbol, file) first, so a common symbol is split
    return rows.groupBy("symbol").agg(F.count("*").alias("n_sites"), F.countDistinct("caller").alias("n_callers"), F.countDistinct("file_path").alias("n_files"))
