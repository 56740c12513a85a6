"""From a source tree to a stored index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import text_hash
from ..operators import graph, resolve, summarize
from ..session import cut
from ..sources import extract as ex
from ..sources import index_io


def build_index(
    spark: SparkSession,
    sources: DataFrame,
    old_functions: DataFrame | None = None,
    commit: str = "",
    call: Callable[[str], str] | None = None,
    batch_size: int = summarize.BATCH_SIZE,
    parallel: int = summarize.PARALLEL,
) -> dict[str, DataFrame]:
    """The tables of the index of ``sources``.

    In order: extraction, resolution, summaries of ``old_functions`` carried over
    by hash, and with ``call`` new summaries level by level.
    """
    extracted = cut(ex.extract(sources))
    functions = ex.functions(extracted)
    resolved = cut(resolve.resolve_calls(functions, ex.call_sites(extracted)))
    if old_functions is not None:
        functions = cut(summarize.preserve_summaries(functions, old_functions))
    if call is not None:
        ranks = cut(graph.rank(functions, graph.call_edges(resolved)))
        functions = summarize.summarize(functions, resolved, sources, ranks, call, batch_size, parallel)
    good = extracted.filter("error IS NULL").select("path")
    return {
        "files": sources.join(good, "path", "left_semi").select("path", "lang", text_hash("text").alias("ast_hash")),
        "functions": functions,
        "call_sites": resolved.select("file_path", "caller_ordinal", "caller", "ordinal", "raw", "line", "target"),
        "types": ex.types(extracted),
        "variables": ex.variables(extracted),
        "externals": resolve.externals(resolved),
        "index_meta": index_io.index_meta(spark, commit),
        "rejects": ex.rejects(extracted),
    }


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    return resolve.index_stats(tables["files"], tables["functions"], tables["types"], tables["call_sites"])


def ranks_of(tables: dict[str, DataFrame]) -> DataFrame:
    return graph.rank(tables["functions"].select(F.col("qualified_name")), graph.call_edges(tables["call_sites"]))
