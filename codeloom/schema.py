"""Table schemas and enumerated domains of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds and sources as stored in the tables.
SYMBOL_KINDS = (
    "function", "class", "interface", "type", "var", "const", "let", "method", "property", "enum", "namespace", "module",
    "arrowFunction", "decorator", "import", "export", "symbol_call",
)
CALLABLE_KINDS = ("function", "method", "arrowFunction")
CONTAINER_KINDS = ("class", "module", "namespace")
ENTRY_KINDS = ("function", "class", "const", "arrowFunction", "interface", "type")
ABSTRACT_KINDS = ("interface", "type")
CALL_KINDS = ("function_call", "method_call", "constructor_call", "decorator_call", "super_call", "dynamic_call", "unknown")
TARGET_KINDS = ("project_symbol", "import", "builtin", "dynamic", "unresolved")
RESOLVED_KINDS = ("source", "package", "builtin", "stdlib", "declaration", "asset", "unresolved")
RESOLUTION_SOURCES = ("bun", "typescript", "python-importlib", "python-static", "lsp", "manual", "unresolved")
IMPORT_KINDS = ("default", "named", "namespace", "side-effect", "type-only", "unresolved")
EDGE_KINDS = ("import", "re-export", "export-all")
INHERITANCE_TYPES = ("extends", "implements", "union", "intersection")
CONFIDENCE = {
    "dynamic_pattern": 100, "lsp_definition": 100, "source_import": 90, "same_file": 80, "builtin_list": 80, "same_class": 75,
    "same_class_property": 72, "external_import": 70, "lsp_hover": 60, "unresolved": 0,
}
MODULE = "<module>"

STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


INHERITANCE = _of(inherits_from_name=STRING, inherits_from_id=STRING, inherits_from_imports_id=STRING, inheritence_type=STRING)
FILES = _of(path=STRING, hash=STRING, indexed_at=LONG, language=STRING, estimated_tokens=LONG)
SYMBOLS = _of(
    id=STRING, name=STRING, kind=STRING, file_path=STRING, line=INT, column=INT, end_line=INT, end_column=INT, signature=STRING,
    parameters_json=STRING, return_type=STRING, docstring=STRING, parent_id=STRING, decorator=STRING, exported=BOOL, language=STRING,
    inheritence=T.ArrayType(INHERITANCE),
)
IMPORTS = _of(
    id=STRING, file_path=STRING, sourceModule=STRING, importedNames=T.ArrayType(STRING), resolvedPath=STRING, resolvedKind=STRING, isExternal=BOOL,
    importKind=STRING, resolutionSource=STRING, edgeKind=STRING, isRuntimeDependency=BOOL, confidence=INT, reason=STRING,
)
CALL_SITES = _of(
    id=STRING, caller_id=STRING, caller_file_path=STRING, language_name=STRING, call_text=STRING, callee_expression=STRING, callee_name=STRING,
    callee_base=STRING, callee_property=STRING, call_kind=STRING, call_line=INT, call_column=INT, end_line=INT, end_column=INT, docstring=STRING,
)
CALL_EDGES = _of(
    id=STRING, call_site_id=STRING, caller_id=STRING, target_kind=STRING, callee_id=STRING, imports_id=STRING, resolution_source=STRING, confidence=INT,
    reason=STRING,
)
EXCEPTIONS = _of(id=STRING, symbol_id=STRING, file_path=STRING, exception_type=STRING, line=INT, column=INT)
ENV_VARS = _of(id=STRING, symbol_id=STRING, file_path=STRING, name=STRING, line=INT, column=INT)
TOOL_USAGE = _of(id=STRING, tool_name=STRING, called_at=LONG, tokens_saved=LONG, source_tokens=LONG, response_tokens=LONG)
VEC_SYMBOLS = _of(symbol_id=STRING, embedding=T.ArrayType(T.FloatType()))

TABLES = {
    "files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "call_sites": CALL_SITES, "call_edges": CALL_EDGES, "exceptions": EXCEPTIONS,
    "env_vars": ENV_VARS, "tool_usage": TOOL_USAGE, "vec_symbols": VEC_SYMBOLS,
}
