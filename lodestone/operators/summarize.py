"""Function summaries: reuse by hash, and level-wise requests to a callable.

The callable takes a prompt and returns text.  It runs in Python workers, one
call for each batch of functions, and never sees a network unless it opens one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_internal, last_segment, line_slice
from ..session import cut
from .resolve import definitions

BATCH_SIZE = 10
PARALLEL = 4


def preserve_summaries(functions: DataFrame, old: DataFrame) -> DataFrame:
    """``functions`` with the summary that an old function of the same hash had.

    Name and file don't matter.  Empty hashes match nothing; of several old
    summaries the last by path and place is taken.
    """
    order = Window.partitionBy("ast_hash").orderBy(F.desc("file_path"), F.desc("ordinal"))
    kept = old.filter((F.length("ast_hash") > 0) & F.col("summary").isNotNull()).withColumn("__r", F.row_number().over(order)).filter("__r = 1")
    kept = kept.select(F.col("ast_hash").alias("__hash"), F.col("summary").alias("__old"))
    met = functions.join(kept, F.col("ast_hash") == F.col("__hash"), "left")
    return met.select(*(F.coalesce("__old", "summary").alias(c) if c == "summary" else F.col(c) for c in functions.columns))


def missing_summaries(functions: DataFrame) -> DataFrame:
    return functions.filter("summary IS NULL")


def callee_context(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``qualified_name, callee_context``: name and summary of every callee that
    has one, call by call."""
    said = definitions(functions).filter("summary IS NOT NULL").select(F.col("qualified_name").alias("target"), F.col("summary").alias("said"))
    met = resolved.filter(is_internal("target")).join(said, "target")
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", last_segment("target").alias("name"), F.col("said").alias("summary"))))
    found = met.groupBy(F.col("caller").alias("qualified_name")).agg(pairs.alias("p"))
    return found.select("qualified_name", F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["summary"].alias("summary"))).alias("callee_context"))


def numbered(requests: DataFrame, batch_size: int = BATCH_SIZE, parts: int = 64) -> DataFrame:
    """``requests`` with ``batch`` and ``position`` (from 1) in it.

    Names are dealt out over ``parts`` shards and numbered within each, so no task
    has to number all; a batch holds ``batch_size`` requests at most.
    """
    shard = F.pmod(F.xxhash64("qualified_name"), F.lit(parts))
    n = F.row_number().over(Window.partitionBy("__shard").orderBy("qualified_name")) - 1
    out = requests.withColumn("__shard", shard).withColumn("__n", n)
    batch = F.concat_ws("-", F.col("__shard").cast("string"), F.floor(F.col("__n") / batch_size).cast("string"))
    return out.select(*requests.columns, batch.alias("batch"), (F.col("__n") % batch_size + 1).cast("int").alias("position"))


def _context(callees: list[dict]) -> str:
    return "".join(["It calls:\n", *(f"- {c['name']}(): \"{c['summary']}\"\n" for c in callees), "\n"]) if callees else ""


def single_prompt(signature: str, body: str, callees: list[dict]) -> str:
    """The request for one function."""
    ask = "Say in one or two sentences what this function does, not how. Answer with the summary alone.\n\n"
    return f"{ask}{_context(callees)}Function: {signature}\nBody:\n{body}"


def batch_prompt(requests: list[dict]) -> str:
    """The request for several functions; answers are marked ``[N]:``."""
    ask = "Say in one or two sentences what each function does, not how.\nAnswer for each function in this form, N its number:\n[N]: <summary>\n\n"
    parts = [f"=== Function {i} ===\n{_context(r['callee_context'])}{r['signature']}\n{r['body']}\n\n" for i, r in enumerate(requests, 1)]
    return ask + "".join(parts)


def parse_batch_response(n: int, response: str) -> list[tuple[str, bool]]:
    """``(summary, found)`` of each of ``n`` functions: the first line of its mark;
    without one a placeholder, which counts as a summary."""
    out, lines = [], response.splitlines()
    for i in range(1, n + 1):
        mark = f"[{i}]:"
        line = next((x for x in lines if x.startswith(mark)), None)
        out.append((f"(failed to parse summary for function {i})", False) if line is None else (line[len(mark) :].strip(), True))
    return out


ANSWER = "qualified_name string, summary string, parsed boolean, error string"


def ask(requests: DataFrame, call: Callable[[str], str], parallel: int = PARALLEL) -> DataFrame:
    """``qualified_name, summary, parsed, error`` for ``requests(qualified_name,
    signature, body, callee_context, batch, position)``; ``parallel`` tasks at once.
    A call that raises gives its functions an error and no summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(group: list[dict]) -> list[tuple]:
            try:
                if len(group) == 1:
                    said = [(call(single_prompt(group[0]["signature"], group[0]["body"], group[0]["callee_context"] or [])).strip(), True)]
                else:
                    said = parse_batch_response(len(group), call(batch_prompt([g | {"callee_context": g["callee_context"] or []} for g in group])))
                return [(g["qualified_name"], s, ok, None) for g, (s, ok) in zip(group, said)]
            except Exception as e:  # the callable is the user's
                return [(g["qualified_name"], None, False, str(e)) for g in group]

        group: list[dict] = []
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[-1]["batch"] != row["batch"]:
                    rows += answer(group)
                    group = []
                group.append(row)
            if rows:
                yield _answers(rows)
                rows = []
        if group:
            yield _answers(answer(group))

    dealt = requests.repartition(parallel, "batch").sortWithinPartitions("batch", "position")
    return dealt.mapInArrow(run, ANSWER)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in ANSWER.split(", ")])


def level_requests(level_names: DataFrame, functions: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests for the functions of one level that have no summary but a body."""
    wanted = definitions(functions).filter("summary IS NULL").join(level_names.select("qualified_name"), "qualified_name", "left_semi")
    texts = sources.select(F.col("path").alias("file_path"), "text")
    body = wanted.join(texts, "file_path").select("qualified_name", "signature", line_slice("text", "line_start", "line_end").alias("body")).filter("body <> ''")
    return body.join(callee_context(functions, resolved), "qualified_name", "left")


def summarize(functions: DataFrame, resolved: DataFrame, sources: DataFrame, ranks: DataFrame, call: Callable[[str], str], batch_size: int = BATCH_SIZE, parallel: int = PARALLEL) -> DataFrame:
    """``functions`` with summaries, asked for from the lowest level up.

    A level's requests are made before any of its answers, so callees of lower
    levels stand in the context and members of one cycle don't see each other.
    """
    top = ranks.agg(F.max("level")).first()[0]
    for level in range((top if top is not None else -1) + 1):
        requests = level_requests(ranks.filter(F.col("level") == level), functions, resolved, sources)
        answers = cut(ask(numbered(requests, batch_size), call, parallel))
        new = answers.filter("summary IS NOT NULL").select(F.col("qualified_name").alias("__q"), F.col("summary").alias("__new"))
        met = functions.join(new, F.col("qualified_name") == F.col("__q"), "left")
        functions = cut(met.select(*(F.coalesce("summary", "__new").alias(c) if c == "summary" else F.col(c) for c in functions.columns)))
    return functions
