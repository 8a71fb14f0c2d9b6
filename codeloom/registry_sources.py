"""Queries that extract, resolve and read generated source files, with SQL of the rows that they have to give.

The SQL knows nothing of sources: it repeats the rows that a reader of the
two templates in `sources.generated` expects for every nation.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .config import Config
from .extract.run import extract, inherited, resolve_imports
from .functions import parsers, scalars
from .functions.globs import IgnoreRules
from .operators import changes, graph, resolve
from .plans import modes
from .sources import generated
from .sources.projection import table
from .storage import Store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def indexed(spark: SparkSession, sf_dir: str) -> Catalog:
    """The generated sources as a catalog, with imports and bases resolved, but without call edges."""
    found, store = generated.sources(spark, sf_dir), Store(spark, "generated")
    files = found.select("path", scalars.content_hash(F.col("content")).alias("hash"), F.lit(0).cast("long").alias("indexed_at"), "language", scalars.token_estimate(F.col("content")).alias("estimated_tokens"))
    c = Catalog.empty(spark).with_(files=files, **extract(found, store))
    c = c.with_(imports=store.keep(resolve_imports(c.imports, files, Config()), "imports"))
    return c.with_(symbols=store.keep(inherited(c), "symbols"))


def _add(name: str, plan: Callable[..., DataFrame], sql: str, raw: bool = False) -> None:
    """`plan` takes the catalog of generated sources; or, raw, (spark, sf_dir)."""
    _QUERIES[name] = plan if raw else lambda spark, sf_dir: plan(indexed(spark, sf_dir))
    _SQL[name] = sql


def _rows(columns: str, python: list[tuple] = (), script: list[tuple] = ()) -> str:
    """Rows of both templates; values may be texts, numbers, truth values or null."""
    return " union all ".join(generated.expected(rows, columns, folder) for rows, folder in ((list(python), "py"), (list(script), "ts")) if rows)


def _owner(c: Catalog, column: str) -> DataFrame:
    return c.symbols.select(F.col("id").alias(column), F.col("name").alias("owner"))


# Extraction ------------------------------------------------------------------

_add(
    "e03_symbols",
    lambda c: c.symbols.join(_owner(c, "parent_id"), "parent_id", "left").select("file_path", "name", "kind", "line", "end_line", F.coalesce("owner", F.lit("")).alias("owner"), "exported"),
    _rows(
        "name, kind, line, end_line, owner, exported",
        [("<module>", "module", 0, 23, "", False), ("Base#", "class", 4, 13, "<module>", True), ("make", "method", 8, 9, "Base#", False), ("run", "method", 11, 13, "Base#", False), ("Child#", "class", 16, 17, "<module>", True), ("fn_#", "function", 20, 22, "<module>", True), ("made", "var", 21, 21, "fn_#", False)],
        [("<module>", "module", 0, 26, "", False), ("Shape#", "interface", 5, 7, "<module>", True), ("Box#", "class", 9, 17, "<module>", True), ("constructor", "method", 10, 12, "Box#", False), ("size", "property", 10, 10, "Box#", False), ("check", "method", 14, 16, "Box#", False), ("fn#", "function", 19, 23, "<module>", True), ("box", "const", 20, 20, "fn#", False), ("arrow#", "arrowFunction", 25, 25, "<module>", True)],
    ),
)
_add(
    "e13_signatures",
    lambda c: c.symbols.filter(F.col("signature").isNotNull()).select("file_path", "name", "signature", F.coalesce("return_type", F.lit("-")).alias("returns"), scalars.format_parameters(F.col("parameters_json")).alias("parameters")),
    _rows(
        "name, signature, returns, parameters",
        [("Base#", "class Base#", "-", "(none)"), ("make", 'def make(a: int, b="x") -> str', "str", "a: int, b?"), ("run", "def run(self)", "-", "(none)"), ("Child#", "class Child#(Base#)", "-", "(none)"), ("fn_#", "def fn_#(x)", "-", "x"), ("made", "made = Base#()", "-", "(none)")],
        [("Shape#", "export interface Shape# extends Shape@", "-", "(none)"), ("Box#", "export class Box# implements Shape#", "-", "(none)"), ("constructor", "constructor(private readonly size: number)", "-", "size: number"), ("size", "private readonly size: number", "-", "(none)"), ("check", "check(n: number): void", "void", "n: number"), ("fn#", "export function fn#(x: number): number", "number", "x: number"), ("box", "const box = new Box#(x)", "-", "(none)"), ("arrow#", "export const arrow# = (y: string)", "-", "y: string")],
    ),
)
_add(
    "e26_docstrings_decorators",
    lambda c: c.symbols.filter("docstring is not null or decorator is not null").select("file_path", "name", F.coalesce("docstring", F.lit("-")).alias("doc"), F.coalesce("decorator", F.lit("-")).alias("marked")),
    _rows("name, doc, marked", [("Base#", "Doc of #.", "-"), ("make", "-", "staticmethod")], [("Shape#", "Shape of #.", "-")]),
)
_add(
    "e10_imports",
    lambda c: c.imports.select("file_path", "sourceModule", F.array_join("importedNames", ",").alias("names"), "importKind", "edgeKind", "isRuntimeDependency"),
    _rows(
        '"sourceModule", names, "importKind", "edgeKind", "isRuntimeDependency"',
        [("os", "os", "default", "import", True), (".n@", "fn_@ as nxt", "named", "import", True)],
        [("./n@", "fn@", "named", "import", True), ("./n@", "Shape@", "type-only", "import", False), ("fs", "fs", "default", "import", True)],
    ),
)
_add("e11_exceptions", lambda c: c.exceptions.join(_owner(c, "symbol_id"), "symbol_id").select("file_path", "owner", "exception_type", "line"), _rows("owner, exception_type, line", [("run", "ValueError", 13)], [("check", "RangeError", 15)]))
_add("e12_env_vars", lambda c: c.env_vars.join(_owner(c, "symbol_id"), "symbol_id").select("file_path", "owner", "name", "line"), _rows("owner, name, line", [("make", "KEY_#", 9)], [("fn#", "KEY_#", 22)]))
_add(
    "c01_call_sites",
    lambda c: c.call_sites.join(_owner(c, "caller_id"), "caller_id").select(F.col("caller_file_path").alias("file_path"), "owner", "callee_name", "callee_expression", F.coalesce("callee_base", F.lit("-")).alias("base"), F.coalesce("callee_property", F.lit("-")).alias("prop"), "call_kind", "call_line", "call_text"),
    _rows(
        "owner, callee_name, callee_expression, base, prop, call_kind, call_line, call_text",
        [("run", "make", "self.make", "self", "make", "method_call", 13, "self.make(1)"), ("run", "ValueError", "ValueError", "-", "-", "function_call", 14, 'ValueError("no")'), ("fn_#", "Base#", "Base#", "-", "-", "constructor_call", 22, "Base#()"), ("fn_#", "nxt", "nxt", "-", "-", "function_call", 23, "nxt(x)"), ("fn_#", "len", "len", "-", "-", "function_call", 23, "len(made.run())"), ("fn_#", "run", "made.run", "made", "run", "method_call", 23, "made.run()")],
        [("constructor", "check", "this.check", "this", "check", "method_call", 12, "this.check(size)"), ("check", "RangeError", "RangeError", "-", "-", "constructor_call", 16, 'RangeError("low")'), ("fn#", "Box#", "Box#", "-", "-", "constructor_call", 21, "Box#(x)"), ("fn#", "check", "box.check", "box", "check", "method_call", 22, "box.check(1)"), ("fn#", "fn@", "fn@", "-", "-", "function_call", 23, "fn@(x)"), ("fn#", "Number", "Number", "-", "-", "function_call", 23, "Number(process.env.KEY_#)"), ("arrow#", "readFileSync", "fs.readFileSync", "fs", "readFileSync", "method_call", 26, "fs.readFileSync(y)")],
    ),
)

# Resolution ------------------------------------------------------------------

_add(
    "r03_resolved_imports",
    lambda c: c.imports.select("file_path", "sourceModule", F.coalesce("resolvedPath", F.lit("-")).alias("resolved"), "resolvedKind", "resolutionSource", "isExternal", "confidence"),
    _rows(
        '"sourceModule", resolved, "resolvedKind", "resolutionSource", "isExternal", confidence',
        [("os", "-", "stdlib", "python-importlib", True, 80), (".n@", "py/n@.py", "source", "python-static", False, 100)],
        [("./n@", "ts/n@.ts", "source", "typescript", False, 100), ("./n@", "ts/n@.ts", "source", "typescript", False, 100), ("fs", "-", "builtin", "typescript", True, 80)],
    ),
)
_add(
    "h03_inheritance",
    lambda c: c.symbols.select("file_path", "name", F.explode("inheritence").alias("b")).join(c.symbols.select(F.col("id").alias("bid"), F.col("file_path").alias("base_path")), F.col("b.inherits_from_id") == F.col("bid"), "left").select("file_path", "name", F.col("b.inherits_from_name").alias("base"), F.col("b.inheritence_type").alias("how"), F.coalesce("base_path", F.lit("-")).alias("base_path"), F.col("b.inherits_from_imports_id").isNotNull().alias("by_import")),
    _rows("name, base, how, base_path, by_import", [("Child#", "Base#", "extends", "py/n#.py", False)], [("Shape#", "Shape@", "extends", "ts/n@.ts", True), ("Box#", "Shape#", "implements", "ts/n#.ts", False)]),
)


def _edges(c: Catalog) -> DataFrame:
    sites = c.call_sites.select(F.col("id").alias("call_site_id"), F.col("caller_file_path").alias("file_path"), "callee_expression")
    callee = c.symbols.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"), F.col("file_path").alias("callee_path"))
    edges = resolve.resolve_calls(c).join(sites, "call_site_id").join(_owner(c, "caller_id"), "caller_id").join(callee, "callee_id", "left")
    return edges.select("file_path", "owner", "callee_expression", F.coalesce("callee", F.lit("-")).alias("callee"), F.coalesce("callee_path", F.lit("-")).alias("callee_path"), "target_kind", "resolution_source", "confidence", F.col("imports_id").isNotNull().alias("by_import"))


_add(
    "c08_edges_of_each_site",
    _edges,
    _rows(
        "owner, callee_expression, callee, callee_path, target_kind, resolution_source, confidence, by_import",
        [("run", "self.make", "make", "py/n#.py", "project_symbol", "same_class", 75, False), ("run", "ValueError", "-", "-", "builtin", "builtin_list", 80, False), ("fn_#", "Base#", "Base#", "py/n#.py", "project_symbol", "same_file", 80, False), ("fn_#", "nxt", "-", "-", "import", "source_import", 90, True), ("fn_#", "len", "-", "-", "builtin", "builtin_list", 80, False), ("fn_#", "made.run", "run", "py/n#.py", "project_symbol", "same_file", 80, False)],
        [("constructor", "this.check", "check", "ts/n#.ts", "project_symbol", "same_class", 75, False), ("check", "RangeError", "-", "-", "builtin", "builtin_list", 80, False), ("fn#", "Box#", "Box#", "ts/n#.ts", "project_symbol", "same_file", 80, False), ("fn#", "box.check", "check", "ts/n#.ts", "project_symbol", "same_file", 80, False), ("fn#", "fn@", "fn@", "ts/n@.ts", "project_symbol", "source_import", 90, True), ("fn#", "Number", "-", "-", "unresolved", "unresolved", 0, False), ("arrow#", "fs.readFileSync", "-", "-", "import", "external_import", 70, True)],
    ),
)


def _definitions(c: Catalog) -> DataFrame:
    """What a language server would say of `nxt`, which names a function of another file."""
    sites = c.call_sites.filter("callee_name = 'nxt'").select(F.col("id").alias("call_site_id"), F.regexp_replace("caller_file_path", r"^py/n|\.py$", "").cast("int").alias("k"))
    goal = c.symbols.filter("kind = 'function' and language = 'python'").select(F.col("id").alias("callee_id"), F.expr("(cast(substring(name, 4) as int) + 24) % 25").alias("k"))
    return sites.join(goal, "k").select("call_site_id", "callee_id")


_add(
    "c12_definitions",
    lambda c: resolve.resolve_calls(c, stages=(resolve.same_class, resolve.same_file, resolve.unresolved), definitions=_definitions(c)).filter("resolution_source = 'lsp_definition'").join(c.symbols.select(F.col("id").alias("callee_id"), F.col("name").alias("callee"), "file_path"), "callee_id").select("file_path", "callee", "confidence"),
    _rows("callee, confidence", [("fn_#", 100)]),
)
_add("r08_module_paths", lambda c: c.imports.filter("sourceModule like '.%'").select("file_path", parsers_resolved("file_path", "sourceModule").alias("target")).distinct(), _rows("target", [("py/n@",)], [("ts/n@",)]))


def parsers_resolved(path: str, module: str):
    """`parsers.resolve_module` as a Column."""
    def run(paths: pd.Series, modules: pd.Series) -> pd.Series:
        return pd.Series([parsers.resolve_module(p, m) for p, m in zip(paths, modules)], dtype=object)

    return F.pandas_udf(run, "string")(path, module)


# Reading and changing ----------------------------------------------------------

_add(
    "m05_definitions",
    lambda spark, d: (lambda c: modes.read_definition(generated.sources(spark, d), c.symbols.filter("name like 'Child%' or name like 'arrow%'")).join(c.symbols.select("id", "file_path", "name"), "id").select("file_path", "name", "text"))(indexed(spark, d)),
    _rows("name, text", [("Child#", "class Child#(Base#):\n    pass")], [("arrow#", "export const arrow# = (y: string) => fs.readFileSync(y);")]),
    raw=True,
)
_add("m06_snippet", lambda spark, d: modes.read_snippet(generated.sources(spark, d), "py/n3.py", 17, 18).select("path", "text"), "select 'py/n3.py' as path, 'class Child3(Base3):' || chr(10) || '    pass' as text", raw=True)
_add(
    "m07_summary",
    lambda c: modes.read_summary(c, "ts/n4.ts").select("part", "name", "kind", F.coalesce("line", F.lit(-1)).alias("line"), F.coalesce("detail", F.lit("-")).alias("detail")),
    """select * from (values ('symbol', '<module>', 'module', 0, '-'), ('symbol', 'Shape4', 'interface', 5, 'export interface Shape4 extends Shape5'), ('symbol', 'Box4', 'class', 9, 'export class Box4 implements Shape4'),
      ('symbol', 'constructor', 'method', 10, 'constructor(private readonly size: number)'), ('symbol', 'size', 'property', 10, 'private readonly size: number'), ('symbol', 'check', 'method', 14, 'check(n: number): void'),
      ('symbol', 'fn4', 'function', 19, 'export function fn4(x: number): number'), ('symbol', 'box', 'const', 20, 'const box = new Box4(x)'), ('symbol', 'arrow4', 'arrowFunction', 25, 'export const arrow4 = (y: string)'),
      ('import', './n5', 'named', -1, 'fn5'), ('import', './n5', 'type-only', -1, 'Shape5'), ('import', 'fs', 'default', -1, 'fs')) t(part, name, kind, line, detail)""",
)
_PATHS = "py/n1.py", "ts/n1.ts"


def _replaced(c: Catalog, name: str, column: str = "file_path") -> DataFrame:
    """Rows of two files replaced by those of one of them, moved a hundred lines down."""
    rows, line = getattr(c, name), "call_line" if name == "call_sites" else "line"
    paths = c.files.filter(F.col("path").isin(*_PATHS)).select("path")
    new = rows.filter(F.col(column) == _PATHS[0]).withColumn(line, F.col(line) + 100)
    return changes.replace_for_files(rows, new, paths, column).groupBy(F.col(column).alias("file_path")).agg(F.count("*").alias("n"), F.max(line).alias("last"))


for _name, _table, _column, _py, _ts in (("w04_upsert_call_sites", "call_sites", "caller_file_path", (6, 23), (7, 26)), ("w06_upsert_exceptions", "exceptions", "file_path", (1, 13), (1, 15)), ("w07_upsert_env_vars", "env_vars", "file_path", (1, 9), (1, 22))):
    _add(
        _name,
        lambda c, t=_table, f=_column: _replaced(c, t, f),
        f"""select 'py/n' || n_nationkey || '.py' as file_path, cast({_py[0]} as bigint) as n, {_py[1]} + case when n_nationkey = 1 then 100 else 0 end as last from nation
            union all select 'ts/n' || n_nationkey || '.ts', {_ts[0]}, {_ts[1]} from nation where n_nationkey <> 1""",
    )
_add(
    "w14_update_types",
    lambda c: changes.update_symbols(c, c.symbols.filter("name = 'run'").select("id", F.lit("int").alias("return_type"))).symbols.filter("kind = 'method'").select("file_path", "name", F.coalesce("return_type", F.lit("-")).alias("returns")),
    _rows("name, returns", [("make", "str"), ("run", "int")], [("constructor", "-"), ("check", "void")]),
)
_add(
    "g11_layers",
    lambda c: graph.layers(c.imports.filter("resolvedPath is not null").select(F.col("file_path").alias("src"), F.col("resolvedPath").alias("dst")).filter("cast(regexp_extract(src, '([0-9]+)', 1) as int) % 5 <> 4").distinct(), c.files.select(F.col("path").alias("node"))),
    "select 'py/n' || n_nationkey || '.py' as node, 4 - n_nationkey % 5 as layer from nation union all select 'ts/n' || n_nationkey || '.ts', 4 - n_nationkey % 5 from nation",
)
_add(
    "t06_unchanged_files",
    lambda spark, d: (lambda s: s.withColumn("hash", scalars.content_hash(F.col("content"))).join(s.select("path", F.when(F.col("path").like("ts/%"), scalars.content_hash(F.concat("content", F.lit(" ")))).otherwise(scalars.content_hash(F.col("content"))).alias("hash")), ["path", "hash"], "left_anti").select("path", "language"))(generated.sources(spark, d)),
    "select 'ts/n' || n_nationkey || '.ts' as path, 'typescript' as language from nation",
    raw=True,
)

# Scalars and parsers -------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("k"))


def _with(text: str):
    """A template with the nation's key."""
    return F.replace(F.lit(text), F.lit("#"), F.col("k"))


def _parsed(name: str, returns: str, text: str):
    value = parsers.udf_of(getattr(parsers, name), returns)(_with(text))
    return F.array_join(value, "|") if returns.startswith("array") else value


_add(
    "x05_parsers",
    lambda s, d: _nations(s, d).select("n_nationkey", _parsed("type_names", "array<string>", "A#<B, C>, D.E, F | G").alias("types"), _parsed("arguments", "array<string>", "(a#, f(b, c),  'x,y')").alias("args"), _parsed("strip_parentheses", "string", "((x#) + (y))").alias("bare"), _parsed("comment_text", "string", "/**\n * One #.\n * Two.\n */").alias("said")),
    "select n_nationkey, 'A' || n_nationkey || '|D.E' as types, 'a' || n_nationkey || '|f(b, c)|''x,y''' as args, '(x' || n_nationkey || ') + (y)' as bare, 'One ' || n_nationkey || '.' || chr(10) || 'Two.' as said from nation",
    raw=True,
)
_add(
    "x16_parameters",
    lambda s, d: _nations(s, d).select("n_nationkey", scalars.format_parameters(_with('[{"name":"a#","type":"int","optional":true},{"name":"b","type":null}]')).alias("shown"), F.size(scalars.parameters(_with('[{"name":"a#"}]'))).alias("n"), scalars.format_parameters(_with("no list #")).alias("odd")),
    "select n_nationkey, 'a' || n_nationkey || '?: int, b' as shown, 1 as n, '(none)' as odd from nation",
    raw=True,
)
_add("x18_inheritance_text", lambda c: c.symbols.select("file_path", "name", scalars.format_inheritance(F.col("inheritence")).alias("bases")).filter("bases <> ''"), _rows("name, bases", [("Child#", "extends Base#")], [("Shape#", "extends Shape@"), ("Box#", "implements Shape#")]))
_add(
    "x39_hover_signatures",
    lambda s, d: _nations(s, d).select("n_nationkey", scalars.hover_signature(_with("function f#(a: string, b?: number): Promise<T#>")).alias("h")).select("n_nationkey", "h.parameters", "h.returns"),
    "select n_nationkey, 'a: string, b?: number' as parameters, 'Promise<T' || n_nationkey || '>' as returns from nation",
    raw=True,
)
_add(
    "x40_callee_parts",
    lambda s, d: _nations(s, d).select("n_nationkey", F.array_join(scalars.callee_parts(_with("a#?.b!.c"), "typescript"), "|").alias("ts"), F.array_join(scalars.callee_parts(_with("a#.b.c"), "python"), "|").alias("py")),
    "select n_nationkey, 'a' || n_nationkey || '|b|c' as ts, 'a' || n_nationkey || '|b|c' as py from nation",
    raw=True,
)
_add(
    "x25_ignored_paths",
    lambda s, d: _nations(s, d).select(F.explode(F.array(_with("src/n#.ts"), _with("src/keep#.ts"), _with("build/n#.py"), _with("a/build/n#.py"), _with("docs/n#.md"))).alias("path")).select("path", IgnoreRules().plus(["# none", "*.ts", "!keep*.ts", "/build/", "docs"]).column(F.col("path")).alias("ignored")),
    "select replace(p, '#', cast(n_nationkey as varchar)) as path, i as ignored from nation, (values ('src/n#.ts', true), ('src/keep#.ts', false), ('build/n#.py', true), ('a/build/n#.py', false), ('docs/n#.md', true)) t(p, i)",
    raw=True,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
