"""The driver's relational tables in the shape of a code graph.

Parts, customers and so on become symbols; consecutive lines of an order
become calls; orders that join near-by parts become imports. This gives the
graph operators tables of any size whose results SQL can check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..storage import Store, counted

FILES = """
select concat('src/', source, '/', lang, '/d', doc_id, '.txt') as path, sha2(text, 256) as hash, 1704067200000 + doc_id * 60000 as indexed_at,
  lang as language, cast(ceil(length(text) / 4.0) as bigint) as estimated_tokens
from {documents}
"""
_NULLS = "cast(null as int) as end_line, cast(null as int) as end_column, cast(null as string) as signature, cast(null as string) as parameters_json"
_NO_BASE = "cast(null as array<struct<inherits_from_name:string,inherits_from_id:string,inherits_from_imports_id:string,inheritence_type:string>>) as inheritence"


def _symbol(id_, name, kind, file, line, parent, exported, returns="cast(null as string)", decorator="cast(null as string)", base=_NO_BASE) -> str:
    return (
        f"select {id_} as id, {name} as name, {kind} as kind, {file} as file_path, cast({line} as int) as line, 0 as column, {_NULLS}, {returns} as return_type, "
        f"cast(null as string) as docstring, {parent} as parent_id, {decorator} as decorator, {exported} as exported, 'typescript' as language, {base}"
    )


SEGMENT_KIND = "case c_mktsegment when 'BUILDING' then 'function' when 'MACHINERY' then 'method' when 'AUTOMOBILE' then 'arrowFunction' when 'FURNITURE' then 'property' else 'const' end"
TYPE_KIND = "case split_part(p_type, ' ', 1) when 'STANDARD' then 'function' when 'ECONOMY' then 'class' when 'MEDIUM' then 'interface' when 'SMALL' then 'type' when 'LARGE' then 'arrowFunction' else 'const' end"
SYMBOLS = " union all ".join((
    _symbol("concat('r', r_regionkey)", "'<module>'", "'module'", "concat('geo/r', r_regionkey, '.ts')", "0", "cast(null as string)", "false") + " from {region}",
    _symbol("concat('n', n_nationkey)", "n_name", "'class'", "concat('geo/r', n_regionkey, '.ts')", "n_nationkey", "concat('r', n_regionkey)", "true") + " from {nation}",
    _symbol("concat('c', c_custkey)", "c_name", SEGMENT_KIND, "concat('geo/r', n_regionkey, '.ts')", "c_custkey", "concat('n', c_nationkey)", "c_acctbal > 0") + " from {customer} join {nation} on c_nationkey = n_nationkey",
    _symbol("concat('s', s_suppkey)", "s_name", "'method'", "concat('geo/r', n_regionkey, '.ts')", "s_suppkey", "concat('n', s_nationkey)", "s_acctbal > 5000") + " from {supplier} join {nation} on s_nationkey = n_nationkey",
    _symbol(
        "concat('p', p_partkey)", "p_name", TYPE_KIND, "concat('parts/f', p_partkey % 97, '.ts')", "p_partkey div 97", "concat('r', p_partkey % 5)", "p_size > 25", "p_type", "p_brand",
        "case when split_part(p_type, ' ', 1) = 'ECONOMY' then array(named_struct('inherits_from_name', n_name, 'inherits_from_id', concat('n', n_nationkey), "
        "'inherits_from_imports_id', cast(null as string), 'inheritence_type', 'extends')) end as inheritence",
    ) + " from {part} join {nation} on p_partkey % 25 = n_nationkey",
))
CALLS = """
select x.l_orderkey as ord, x.l_linenumber as lin, x.l_partkey as x, y.l_partkey as y, max(concat(x.l_returnflag, x.l_linestatus)) as rf
from {lineitem} x join {lineitem} y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1 and x.l_partkey <> y.l_partkey
group by 1, 2, 3, 4
"""
CALL_SITES = """
select concat_ws('-', 'cs', ord, lin, x, y) as id, concat('p', x) as caller_id, concat('parts/f', x % 97, '.ts') as caller_file_path, 'typescript' as language_name,
  concat(p_name, '()') as call_text, p_name as callee_expression, p_name as callee_name, cast(null as string) as callee_base, cast(null as string) as callee_property,
  'function_call' as call_kind, cast(lin as int) as call_line, 1 as call_column, cast(null as int) as end_line, cast(null as int) as end_column, cast(null as string) as docstring
from {calls} join {part} on y = p_partkey
"""
CALL_EDGES = """
select concat_ws('-', 'ce', ord, lin, x, y) as id, concat_ws('-', 'cs', ord, lin, x, y) as call_site_id, concat('p', x) as caller_id,
  case when rf = 'RF' then 'project_symbol' when rf like 'A%' then 'import' when rf = 'NF' then 'builtin' else 'unresolved' end as target_kind,
  case when rf = 'RF' then concat('p', y) end as callee_id, case when rf like 'A%' then concat('i-', x, '-', y) end as imports_id,
  case when rf = 'RF' then 'same_file' when rf like 'A%' then 'source_import' when rf = 'NF' then 'builtin_list' else 'unresolved' end as resolution_source,
  case when rf = 'RF' then 80 when rf like 'A%' then 90 when rf = 'NF' then 80 else 0 end as confidence, cast(null as string) as reason
from {calls}
"""
IMPORTS = """
select concat('i-', x, '-', y) as id, concat('parts/p', x, '.ts') as file_path, concat('parts/p', y) as sourceModule, array(p_name) as importedNames,
  concat('parts/p', y, '.ts') as resolvedPath, 'source' as resolvedKind, false as isExternal, 'named' as importKind, 'typescript' as resolutionSource, 'import' as edgeKind,
  true as isRuntimeDependency, 90 as confidence, cast(null as string) as reason
from (select distinct x.l_partkey as x, y.l_partkey as y from {lineitem} x join {lineitem} y
  on x.l_orderkey = y.l_orderkey and x.l_linenumber <> y.l_linenumber and abs(x.l_partkey - y.l_partkey) between 1 and 3) join {part} on y = p_partkey
"""
_EVENT = "concat('c', user_id) as symbol_id, concat('geo/', user_id % 5, '.ts') as file_path"
EXCEPTIONS = f"""
select concat('x', event_id) as id, {_EVENT}, concat('E', cast(get_json_object(props, '$.k') as int) % 5) as exception_type, cast(floor(value) as int) as line, 0 as column
from {{events}} where event_type = 'error'
"""
ENV_VARS = f"""
select concat('e', event_id) as id, {_EVENT}, concat('K', get_json_object(props, '$.k')) as name, cast(floor(value) as int) as line, 0 as column
from {{events}} where event_type = 'signup'
"""
TOOL_USAGE = """
select concat('u', event_id) as id, event_type as tool_name, called_at, greatest(0, source_tokens - response_tokens) as tokens_saved, source_tokens, response_tokens
from (select event_id, event_type, unix_millis(cast(ts as timestamp)) as called_at, cast(floor(value * 10) as bigint) as source_tokens,
  cast(get_json_object(props, '$.k') as bigint) as response_tokens from {events})
"""
CHURN = """
select concat('parts/f', l_partkey % 97, '.ts') as path, cast(sum(l_quantity) as bigint) as added, cast(sum(round(l_discount * 100)) as bigint) as removed,
  count(distinct l_orderkey) as commits
from {lineitem} group by 1
"""
VECTORS = "select concat('p', vec_id) as symbol_id, embedding from {embeddings}"
AGENT_DOCS = """
select concat('docs/', page_id, '.md') as path, concat('See src/src', page_id % 20, '/en/d', page_id, '.txt, `NATION_', page_id % 40, '` or `ab`; (src/x.ts).') as content from {pages}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    import string

    names = {x for _, x, _, _ in string.Formatter().parse(text) if x}
    return spark.sql(text, **{n: more[n] if n in more else table(spark, sf_dir, n) for n in names})


def project(spark: SparkSession, sf_dir: str, written: bool = False) -> Catalog:
    """A catalog over the driver's tables; but for a count of parts, nothing is read until a query asks for it.

    Lines are paired by a shuffle, and parts broadcast only if they are few: as their files are small, Spark would send millions of either through the driver.
    `written` pairs the lines of orders at once and writes the calls, for queries that look at sites and edges several times.
    """
    line, part = table(spark, sf_dir, "lineitem").hint("merge"), counted(table(spark, sf_dir, "part"))
    calls = _run(spark, sf_dir, CALLS, lineitem=line)
    if written:
        calls = Store(spark, "projection").keep(calls, "calls")
    return Catalog(
        files=_run(spark, sf_dir, FILES),
        symbols=_run(spark, sf_dir, SYMBOLS),
        imports=_run(spark, sf_dir, IMPORTS, lineitem=line, part=part),
        call_sites=_run(spark, sf_dir, CALL_SITES, calls=calls, part=part),
        call_edges=_run(spark, sf_dir, CALL_EDGES, calls=calls),
        exceptions=_run(spark, sf_dir, EXCEPTIONS),
        env_vars=_run(spark, sf_dir, ENV_VARS),
        tool_usage=_run(spark, sf_dir, TOOL_USAGE),
        vec_symbols=_run(spark, sf_dir, VECTORS),
    )


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, added, removed, commits), as the history source gives them."""
    return _run(spark, sf_dir, CHURN)


def agent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, AGENT_DOCS)


def oracle_tables() -> dict[str, str]:
    """The same tables as DuckDB SQL, by name; later ones may use earlier ones."""

    def duck(text: str) -> str:
        for a, b in (
            ("{", ""), ("}", ""), ("sha2(text, 256)", "sha256(text)"), (" div ", " // "), ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
            ("unix_millis(cast(ts as timestamp))", "epoch_us(ts) // 1000"), ("array(p_name)", "[p_name]"), ("as column", 'as "column"'), ("as string)", "as varchar)"),
            ("cast(null as array<struct<inherits_from_name:string,inherits_from_id:string,inherits_from_imports_id:string,inheritence_type:string>>)",
             "cast(null as struct(inherits_from_name varchar, inherits_from_id varchar, inherits_from_imports_id varchar, inheritence_type varchar)[])"),
            ("array(named_struct('inherits_from_name', n_name, 'inherits_from_id', concat('n', n_nationkey), 'inherits_from_imports_id', cast(null as varchar), 'inheritence_type', 'extends'))",
             "[struct_pack(inherits_from_name := n_name, inherits_from_id := concat('n', n_nationkey), inherits_from_imports_id := cast(null as varchar), inheritence_type := 'extends')]"),
        ):
            text = text.replace(a, b)
        return text.strip()

    return {name: duck(text) for name, text in {
        "files": FILES, "symbols": SYMBOLS, "calls": CALLS, "call_sites": CALL_SITES, "call_edges": CALL_EDGES, "imports": IMPORTS, "exceptions": EXCEPTIONS, "env_vars": ENV_VARS,
        "tool_usage": TOOL_USAGE, "churn": CHURN, "vec_symbols": VECTORS, "agent_docs": AGENT_DOCS,
    }.items()}
