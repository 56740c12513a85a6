"""Four verbs over a source tree: index, source, trace, rank."""

from __future__ import annotations

import argparse
import shutil
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from .operators import resolve, search, trace
from .plans import pipeline
from .schemas import SYMBOL_KINDS
from .session import get_session
from .sources import config, index_io, scan


def _fail(message: str) -> int:
    print(message, file=sys.stderr)
    return 1


def index(spark, root: Path, call=None) -> int:
    state = config.init_state_dir(root)
    settings = config.load_config(state)
    sources, rejects = scan.scan_tree(spark, str(root))
    for row in rejects.toLocalIterator():
        print(f"warning: {row.path}: {row.error}", file=sys.stderr)
    path = f"{state}/index"
    old = index_io.load_old_index(spark, path)["functions"]
    wanted = call if settings.features.summaries else None
    tables = pipeline.build_index(spark, sources, old, config.git_head(root), wanted, settings.llm.batch_size, settings.llm.parallel)
    # the old tables are read while the new ones are written beside them
    index_io.write_index(tables, f"{path}.new")
    shutil.rmtree(path, ignore_errors=True)
    Path(f"{path}.new").rename(path)
    stored = index_io.load_index(spark, path)
    index_io.write_index_json(stored, state / "index.json")
    s = pipeline.stats(stored).first()
    print(f"Indexed {s.n_files} files, {s.n_functions} functions, {s.n_types} types, {s.n_calls} calls ({s.resolution_rate:.0f}% resolved)")
    return 0


def source(spark, root: Path, name: str, kind: str | None) -> int:
    try:
        tables = index_io.load_index(spark, f"{root / config.STATE}/index")
        found = search.find_symbols(tables["functions"], tables["types"], tables["variables"], name, kind)
    except (index_io.MissingIndex, ValueError) as e:
        return _fail(f"error: {e}")
    contents = scan.read_contents(found.select(F.col("file_path").alias("path"), F.lit("").alias("lang")).distinct(), str(root))
    rows = search.with_source(found, contents).orderBy("file_path", "line_start", "qualified_name").collect()
    if not rows:
        return _fail(f"No symbol found matching '{name}'")
    for i, r in enumerate(rows):
        if len(rows) > 1:
            print(("\n" if i else "") + f"--- {r.qualified_name} ({r.file_path}:{r.line_start}-{r.line_end}) ---")
        if r.source:
            print(r.source)
    return 0


def trace_lines(tables, name: str, forward: bool, backward: bool, depth: int) -> list[str]:
    """What ``trace`` prints; no lines without a match."""
    functions, resolved = tables["functions"], tables["call_sites"]
    roots = search.find_functions(functions, name)
    both = not (forward or backward)
    out: dict[tuple, list[str]] = {}
    order = [(r.qualified_name, r.file_path, r.line_start, r.line_end) for r in roots.orderBy("match_rank", "file_path", "ordinal").collect()]
    callers: dict[tuple, list[str]] = {}
    if backward or both:
        for r in trace.trace_backward(functions, resolved, roots, depth).orderBy("root", "root_file", "sort_path").collect():
            callers.setdefault((r.root, r.root_file), []).append(r.line_text)
    if forward or both:
        for r in trace.trace_forward(functions, resolved, roots, depth).orderBy("root", "root_file", "sort_path").collect():
            out.setdefault((r.root, r.root_file), []).append(r.line_text)
    lines: list[str] = []
    for i, (q, path, start, end) in enumerate(order):
        if len(order) > 1:
            lines += [""] * (i > 0) + [f"=== {q} ({path}:{start}-{end}) ==="]
        known = callers.get((q, path), [])
        if backward or both:
            lines += known[:1] + (["  called by:", *known[1:]] if len(known) > 1 else ["  (no callers found)"])
        if forward or both:
            lines += [""] * (len(known) > 1) + out.get((q, path), [])
    return lines


def show_trace(spark, root: Path, name: str, forward: bool, backward: bool, depth: int) -> int:
    try:
        tables = index_io.load_index(spark, f"{root / config.STATE}/index")
    except index_io.MissingIndex as e:
        return _fail(f"error: {e}")
    lines = trace_lines(tables, name, forward, backward, depth)
    if not lines:
        return _fail(f"No function found matching '{name}'")
    print("\n".join(lines))
    return 0


def rank(spark, root: Path) -> int:
    began = time.monotonic()
    try:
        tables = index_io.load_index(spark, f"{root / config.STATE}/index")
    except index_io.MissingIndex as e:
        return _fail(f"error: {e}")
    path = (root / config.STATE / "rank.json").resolve()
    n = index_io.write_rank_json(pipeline.ranks_of(tables), path)
    repeated = resolve.duplicate_definitions(tables["functions"]).count()
    print(f"{n} levels, {repeated} names defined more than once")
    print(f'Wrote "{path}" in {(time.monotonic() - began) * 1000:.2f} ms')
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("--root", default=".", type=Path)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("index")
    p = verbs.add_parser("source")
    p.add_argument("name")
    p.add_argument("-k", "--kind", help=", ".join(SYMBOL_KINDS))
    p = verbs.add_parser("trace")
    p.add_argument("name")
    p.add_argument("-f", "--forward", action="store_true")
    p.add_argument("-b", "--backward", action="store_true")
    p.add_argument("-d", "--depth", type=int, default=2, help="0: all levels")
    verbs.add_parser("rank")
    a = parser.parse_args(argv)
    spark = get_session()
    if a.verb == "index":
        return index(spark, a.root)
    if a.verb == "source":
        return source(spark, a.root, a.name, a.kind)
    if a.verb == "trace":
        return show_trace(spark, a.root, a.name, a.forward, a.backward, a.depth)
    return rank(spark, a.root)


if __name__ == "__main__":
    sys.exit(main())
