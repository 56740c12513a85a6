"""A stored table in shards by key (extension): pruned reads, updates of touched shards.

Rows go to the shard of their key's hash.  A search for keys reads their shards
alone, by partition pruning; an update rewrites the shards of the keys that it
replaces alone, by dynamic partition overwrite.  Each shard holds one row that marks
it, all of its columns null, so a shard that an update empties is rewritten too.
Writing rebalances, so a shard that one key fills is cut into several files.

Defined results: rows with a null key are left out; repeated rows stay; an update
without keys changes nothing; keys that the table lacks are added by their rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, few

SHARD = "shard"


@dataclass(frozen=True)
class Shards:
    """A table at ``path`` in ``n`` shards by the text column ``key``."""

    path: str
    key: str
    n: int = 64

    def shard_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.n)).cast("int")

    def _stored(self, rows: DataFrame, shards: DataFrame) -> DataFrame:
        placed = rows.filter(F.col(self.key).isNotNull()).withColumn(SHARD, self.shard_of(F.col(self.key)))
        return placed.unionByName(shards, allowMissingColumns=True).hint("rebalance", SHARD)

    def write(self, rows: DataFrame) -> None:
        marks = rows.sparkSession.range(self.n).select(F.col("id").cast("int").alias(SHARD))
        self._stored(rows, marks).write.mode("overwrite").partitionBy(SHARD).parquet(self.path)

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).filter(F.col(self.key).isNotNull()).drop(SHARD)

    def lookup(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """The rows of ``keys``; their shards are constants of the plan."""
        inside = reduce(lambda a, b: a | b, (F.col(SHARD) == self.shard_of(F.lit(k)) for k in keys), F.lit(False))
        return self._all(spark).filter(inside).filter(F.col(self.key).isin(*keys)).drop(SHARD)

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Put ``rows`` in the place of all rows of ``keys`` (one column, the key's);
        returns the shards that were rewritten, some of ``n`` at most.

        Rows whose key isn't among ``keys`` are an error of the caller.
        """
        spark = rows.sparkSession
        keys = few(cut(keys.select(F.col(keys.columns[0]).alias(self.key)).filter(F.col(self.key).isNotNull()).distinct()))
        shards = sorted(r[0] for r in keys.select(self.shard_of(F.col(self.key))).distinct().collect())  # n at most
        if not shards:
            return []
        kept = self._all(spark).filter(F.col(SHARD).isin(*shards)).filter(F.col(self.key).isNotNull()).drop(SHARD).join(keys, self.key, "left_anti")
        marks = spark.range(self.n).select(F.col("id").cast("int").alias(SHARD)).filter(F.col(SHARD).isin(*shards))
        # written out first: what is read is about to be overwritten
        new = cut(kept.unionByName(rows.select(kept.columns)))
        self._stored(new, marks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(self.path)
        return shards


@dataclass(frozen=True)
class SymbolStore:
    """Functions in shards by file, and a directory of their names in shards by name."""

    path: str
    n: int = 64

    @property
    def functions(self) -> Shards:
        return Shards(f"{self.path}/functions", "file_path", self.n)

    @property
    def names(self) -> Shards:
        return Shards(f"{self.path}/names", "name", self.n)

    @staticmethod
    def _names(functions: DataFrame) -> DataFrame:
        """``name, file_path`` for simple and qualified names."""
        return functions.select(F.explode(F.array("name", "qualified_name")).alias("name"), "file_path").filter("name is not null").distinct()

    def write(self, functions: DataFrame) -> None:
        self.functions.write(functions)
        self.names.write(self._names(functions))

    def find(self, spark: SparkSession, name: str) -> DataFrame:
        """The functions of a simple or qualified name: one shard of the directory says
        which shards of functions are read."""
        files = cut(self.names.lookup(spark, [name]).select("file_path").distinct())
        rows, at = self.functions, self.functions.shard_of(F.col("file_path"))
        inside = [r[0] for r in files.select(at).distinct().collect()]  # n at most
        found = spark.read.parquet(rows.path).filter(F.col(SHARD).isin(*inside)).drop(SHARD)
        return found.join(few(files), "file_path", "left_semi").filter((F.col("name") == name) | (F.col("qualified_name") == name))

    def update(self, files: DataFrame, functions: DataFrame) -> tuple[list[int], list[int]]:
        """Put ``functions`` in the place of all those of ``files(file_path)``; returns the
        rewritten shards of functions and of names."""
        spark = functions.sparkSession
        files = few(cut(files.select("file_path").distinct()))
        old = self.functions.read(spark).join(files, "file_path", "left_semi")
        was, now = self._names(old), self._names(functions)
        moved = cut(was.exceptAll(now).unionByName(now.exceptAll(was)).select("name").distinct())
        others = self.names.read(spark).join(few(moved), "name", "left_semi").join(files, "file_path", "left_anti")
        names = cut(others.unionByName(now.join(few(moved), "name", "left_semi").select(others.columns)))
        return self.functions.replace(files, functions), self.names.replace(moved, names)
