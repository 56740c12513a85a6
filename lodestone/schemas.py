"""Explicit schemas of the engine's relations, as DDL."""

SOURCES = "path string, lang string, text string"
FILES = "path string, lang string, ast_hash string"
FUNCTIONS = (
    "file_path string, ordinal int, name string, qualified_name string, ast_hash string, line_start int, line_end int, "
    "signature string, summary string, receiver string, scope string"
)
CALL_SITES = "file_path string, caller_ordinal int, caller string, ordinal int, raw string, line int, target string"
TYPES = (
    "file_path string, ordinal int, name string, qualified_name string, kind string, line_start int, line_end int, "
    "summary string, methods array<string>"
)
VARIABLES = "file_path string, ordinal int, name string, qualified_name string, type_name string, line_start int, line_end int, scope string"
EXTERNALS = "name string, kind string, summary string, references bigint"
EDGES = "src string, dst string"
RANKS = "qualified_name string, scc_id string, level bigint"
META = "version string, commit string, indexed_at timestamp"

#: The tables of a stored index.
INDEX_TABLES = {
    "files": FILES,
    "functions": FUNCTIONS,
    "call_sites": CALL_SITES,
    "types": TYPES,
    "variables": VARIABLES,
    "externals": EXTERNALS,
    "index_meta": META,
}

SCOPES = ("public", "static", "internal")
TYPE_KINDS = ("struct", "interface", "typedef", "enum")
EXTERNAL_KINDS = ("syscall", "libc", "macro", "external")
SYMBOL_KINDS = ("function", "struct", "enum", "typedef", "interface", "variable")
UNRESOLVED = "[unresolved]"
