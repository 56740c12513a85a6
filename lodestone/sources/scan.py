"""Source trees as a relation.

Names are listed on the driver, where whole subtrees are left out before they
are entered; contents are read by the tasks.  Driver and executors must see the
tree under the same path.  Spark's own file index isn't used: it would drop
names that begin with an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import language_of

#: Names of files and folders that are never entered.
IGNORED = ("vendor", "node_modules", "target")
FILES_EACH = 64
CONTENT = "path string, lang string, text string, error string"


def list_paths(root: str) -> Iterator[str]:
    """Files under ``root`` as ``./a/b``, without hidden and ignored names."""
    for folder, folders, names in os.walk(root, onerror=lambda _: None):
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in IGNORED)
        at = os.path.relpath(folder, root)
        for name in sorted(names):
            if not name.startswith(".") and name not in IGNORED:
                yield "./" + (name if at == "." else f"{at}/{name}".replace(os.sep, "/"))


def is_wanted(path: F.Column | str) -> F.Column:
    """Whether a path is of a known language and no Go test."""
    lang = language_of(path)
    return lang.isNotNull() & ~((lang == "go") & F.endswith(F.col(path) if isinstance(path, str) else path, F.lit("_test.go")))


def source_paths(spark: SparkSession, root: str) -> DataFrame:
    """``path, lang`` of the source files of a tree."""
    paths = spark.createDataFrame([(p,) for p in list_paths(root)], "path string")
    return paths.filter(is_wanted("path")).select("path", language_of("path").alias("lang"))


def read_contents(paths: DataFrame, root: str) -> DataFrame:
    """``path, lang, text, error``; a file that isn't UTF-8 or can't be read has
    an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_EACH):
                part = batch.slice(at, FILES_EACH)
                texts, errors = [], []
                for path in part.column(0).to_pylist():
                    text = error = None
                    try:
                        with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                            text = f.read()
                    except (OSError, UnicodeDecodeError) as e:
                        error = f"{type(e).__name__}: {e}"
                    texts.append(text)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "lang", "text", "error"])

    return paths.select("path", "lang").mapInArrow(run, CONTENT)


def scan_tree(spark: SparkSession, root: str = ".") -> tuple[DataFrame, DataFrame]:
    """``sources(path, lang, text)`` and ``rejects(path, error)`` of a tree."""
    contents = read_contents(source_paths(spark, root), root)
    return contents.filter("error IS NULL").select("path", "lang", "text"), contents.filter("error IS NOT NULL").select("path", "error")
