"""Queries over the code graph and their SQL, by inventory id.

Each entry pairs a plan over the projected catalog with DuckDB text over the
same projection. Parameters are fixed here, and written out on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_sources
from .catalog import Catalog
from .functions import parsers, scalars
from .functions.globs import LinkedGlobs
from .functions.paths import extension, is_test, top_dir
from .operators import aggregates as agg
from .operators import calltree, changes, enhance, graph, joins, lookup, nearest, prefixes, resolve, search, spans
from .plans import modes
from .sources import projection
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = 1_800_000_000_000


def _add(name: str, plan: Callable[..., DataFrame], sql: str | None, raw: bool = False, written: bool = False) -> None:
    """`plan` takes a catalog, with its calls `written` if it looks at them several times; or, raw, (spark, sf_dir)."""
    _QUERIES[name] = plan if raw else lambda spark, sf_dir: plan(projection.project(spark, sf_dir, written))
    if sql is not None:
        _SQL[name] = _with_tables(sql)


def _with_tables(sql: str) -> str:
    """The text with definitions of the projected tables that it uses."""
    tables, used = projection.oracle_tables(), []

    def need(text: str) -> None:
        for t in tables:
            if re.search(rf"\b{t}\b", text) and t not in used:
                need(tables[t].replace(f" {t} ", " "))
                used.append(t)

    need(sql)
    body = sql.strip()
    recursive = body.startswith("with recursive ")
    own = body.removeprefix("with recursive ").removeprefix("with ") if body.startswith("with ") else None
    parts = [f"{t} as ({tables[t]})" for t in used]
    head = ("with recursive " if recursive else "with ") + ", ".join(parts)
    if not parts:
        return body
    return f"{head}, {own}" if own is not None else f"{head} {body}"


SYM = "id, name, kind, file_path, line"


def _sym(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "kind", "file_path", "line")


# Lookups -------------------------------------------------------------------

_add("f01_symbol_search", lambda c: _sym(lookup.search_symbols(c, "*blue*", ("function", "class", "arrowFunction"), "parts", "typescript", 50)),
     f"select {SYM} from symbols where name ilike '%blue%' and kind in ('function', 'class', 'arrowFunction') and file_path ilike '%parts%' and language = 'typescript' order by file_path, line, id limit 50")
_add("f02_file_search", lambda c: lookup.search_files(c, "src", "en", 40, "d1"), "select * from files where path ilike '%src%' and language = 'en' and path ilike '%d1%' order by path limit 40")
_add("f03_symbols_by_ids", lambda c: _sym(lookup.symbols_by_ids(c, joins.called_ids(c))), f"select {SYM} from symbols where id in (select callee_id from call_edges where callee_id is not null)")
_add("f04_symbols_by_names", lambda c: _sym(lookup.symbols_by_names(c, ["NATION_3", "small bolt", "Customer#000000007", "<module>"])), f"select {SYM} from symbols where name in ('NATION_3', 'small bolt', 'Customer#000000007', '<module>')")
_add("f05_definition", lambda c: _sym(lookup.definition(c, "p42")), f"select {SYM} from symbols where id = 'p42'")
_add("f06_definition_by_name", lambda c: _sym(lookup.definition_by_name(c, "<module>", "geo/r3.ts")), f"""select {SYM} from symbols where name = '<module>' and file_path = 'geo/r3.ts' order by line, "column", id limit 1""")
_add("f08_symbols_of_files", lambda c: _sym(lookup.symbols_of_files(c, ["geo/r1.ts", "parts/f3.ts"])), f"select {SYM} from symbols where file_path in ('geo/r1.ts', 'parts/f3.ts')")
_add("f09_at_location", lambda c: _sym(lookup.at_location(c, "parts/f5.ts", 1, 0)), f"""select {SYM} from symbols where file_path = 'parts/f5.ts' and line = 1 and "column" = 0""")
_add("f10_callable_at_location", lambda c: _sym(lookup.at_location(c, "parts/f8.ts", 1, 0, ("function", "method", "arrowFunction"))), f"""select {SYM} from symbols where file_path = 'parts/f8.ts' and line = 1 and "column" = 0 and kind in ('function', 'method', 'arrowFunction')""")
_add("f11_need_docstrings", lambda c: _sym(lookup.without_docstring(c, ("class", "interface"))), f"select {SYM} from symbols where kind in ('class', 'interface') and name <> '<module>' and (docstring is null or docstring = '')")
_add("f13_with_docstrings", lambda c: _sym(lookup.with_docstring(c.with_(symbols=c.symbols.withColumn("docstring", F.col("decorator"))), ("class",))), f"select {SYM} from symbols where kind = 'class' and decorator is not null and decorator <> ''")
_add("f14_children", lambda c: _sym(lookup.children(c, "n3")), f"select {SYM} from symbols where parent_id = 'n3'")
_add("f17_file_by_path", lambda c: lookup.file_by_path(c, "src/src1/en/d1.txt"), "select * from files where path = 'src/src1/en/d1.txt'")
_add("f18_files_like", lambda c: lookup.files_like(c, "/de/"), "select * from files where path ilike '%/de/%'")
_IMPORTS = 'id, file_path, "sourceModule", "resolvedPath"'
_imp = lambda df: df.select("id", "file_path", "sourceModule", "resolvedPath")
_add("f19_importers", lambda c: _imp(lookup.importers(c, "parts/p1.ts")), f"""select {_IMPORTS} from imports where "sourceModule" ilike '%parts/p1.ts%' or "sourceModule" ilike '%parts/p1%'""")
_add("f21_imports_by_name", lambda c: _imp(lookup.imports_by_name(c, "small", compat=True)), f"""select {_IMPORTS} from imports where to_json("importedNames") ilike '%small%'""")
_add("f21_imports_of_name", lambda c: _imp(c.imports.filter(F.exists("importedNames", lambda x: x.endswith("bolt")))), f"""select {_IMPORTS} from imports where len(list_filter("importedNames", lambda x: x like '%bolt')) > 0""")
_add("f24_imports_like", lambda c: _imp(lookup.imports_like(c, "parts/p1", 60)), f"""select {_IMPORTS} from imports where file_path ilike '%parts/p1%' order by file_path, "resolvedPath", id limit 60""")
_add("f26_imports_of_files", lambda c: _imp(lookup.imports_of_files(c, [f"parts/p{i}.ts" for i in range(100)])), f"select {_IMPORTS} from imports where file_path in (select 'parts/p' || unnest(range(100)) || '.ts')")
_add("f27_sites_of_callers", lambda c: lookup.sites_of_callers(c, ["p1", "p2", "p3"]).select("id", "caller_id", "callee_name", "call_line"), "select id, caller_id, callee_name, call_line from call_sites where caller_id in ('p1', 'p2', 'p3')")
_EDGE = "id, call_site_id, caller_id, target_kind, callee_id, imports_id, resolution_source, confidence"
_edge = lambda df: df.select(*[x.strip() for x in _EDGE.split(",")])
_add("f29_edges_of_callers", lambda c: _edge(lookup.edges_of_callers(c, ["p1", "p2", "p3"])), f"select {_EDGE} from call_edges where caller_id in ('p1', 'p2', 'p3')")
_add("f30_edges_of_callees", lambda c: _edge(lookup.edges_of_callees(c, ["p1", "p2", "p3"])), f"select {_EDGE} from call_edges where callee_id in ('p1', 'p2', 'p3')")
_add("f31_callee_pairs", lambda c: lookup.callee_pairs(c), "select callee_id as callee, caller_id as caller from call_edges where callee_id is not null")
_add("f36_callables_without_types", lambda c: _sym(lookup.callables_without_types(c, "typescript", ["parts/f1.ts", "parts/f2.ts"])), f"select {SYM} from symbols where language = 'typescript' and kind in ('function', 'method', 'arrowFunction') and parameters_json is null and file_path in ('parts/f1.ts', 'parts/f2.ts')")
_add("f37_classes_without_bases", lambda c: _sym(lookup.classes_without_bases(c, "typescript")), f"select {SYM} from symbols where language = 'typescript' and kind = 'class' and inheritence is null")
_add("s07_all_symbols", lambda c: _sym(lookup.all_symbols(c)), f"select {SYM} from symbols")

# Joins ---------------------------------------------------------------------

_add("j01_outbound", lambda c: joins.outbound(c, ["p5", "p6", "p7"]).select("id", "caller_id", "callee_id", "callee_name", "call_line", "is_lang_feature"),
     "select e.id, e.caller_id, e.callee_id, s.callee_name, s.call_line, e.target_kind = 'builtin' as is_lang_feature from call_edges e join call_sites s on s.id = e.call_site_id where e.caller_id in ('p5', 'p6', 'p7')")
# A name that several parts share: that of part 7.
_NAME7 = "(select p_name from part where p_partkey = 7)"


def _name7(spark: SparkSession, sf_dir: str) -> str:
    return projection.table(spark, sf_dir, "part").filter("p_partkey = 7").first().p_name


_CALLER = "c.file_path as caller_file, c.name as caller_name, c.line as caller_line, c.id as caller_id"
_add("j02_callers", lambda spark, d: joins.callers(projection.project(spark, d), _name7(spark, d)), f"""
    select distinct {_CALLER} from call_edges e join call_sites s on s.id = e.call_site_id join symbols t on t.name = {_NAME7} join symbols c on c.id = e.caller_id
    where e.callee_id = t.id or s.callee_name = {_NAME7}""", raw=True)
_NESTED = """
    select distinct {caller}, k.name as child_name, k.file_path as child_file, k.line as child_line
    from call_edges e join call_sites s on s.id = e.call_site_id join symbols t on {target} join symbols c on c.id = e.caller_id
    left join symbols k on k.parent_id = t.id and (e.callee_id = k.id or lower(s.callee_name) = lower(k.name))
    where (e.callee_id = t.id or lower(s.callee_name) = lower(t.name) or k.id is not null) and c.name <> '<module>'"""
_add("j03_callers_nested", lambda spark, d: joins.callers_nested(projection.project(spark, d, written=True), _name7(spark, d)), _NESTED.format(caller=_CALLER, target=f"lower(t.name) = lower({_NAME7})"), raw=True)
_add("j04_callers_nested_by_id", lambda c: joins.callers_nested_by_id(c, "r2"), _NESTED.format(caller=_CALLER, target="t.id = 'r2'"), written=True)
_add("j08_dep_files", lambda c: joins.dependency_files(c, ["parts/f1.ts", "parts/f2.ts"]), """
    select distinct t.file_path from call_edges e join call_sites s on s.id = e.call_site_id join symbols t on t.id = e.callee_id
    where s.caller_file_path in ('parts/f1.ts', 'parts/f2.ts') and t.file_path not in ('parts/f1.ts', 'parts/f2.ts')""")
_add("j09_unresolved_edges", lambda c: joins.edges_with_sites(c, unresolved=True).select("id", "caller_id", "callee_name"), "select e.id, e.caller_id, s.callee_name from call_edges e join call_sites s on s.id = e.call_site_id where e.callee_id is null and e.imports_id is null")
_PUBLIC = "select s.* from symbols s where s.exported or s.parent_id in (select id from symbols where exported)"
_add("j10_key_symbols", lambda c: joins.key_symbols(c), f"""
    with pub as ({_PUBLIC}) select pub.id, name, kind, file_path, line, count(e.id) as call_count from pub left join call_edges e on e.callee_id = pub.id
    group by pub.id, name, kind, file_path, line order by call_count desc, pub.id limit 30""")
_ENTRY = "exported and parent_id in (select id from symbols where name = '<module>')"
_INTERNAL = "not s.exported and s.kind in ('function', 'method', 'arrowFunction') and not exists (select 1 from symbols p where p.id = s.parent_id and p.exported)"
_add("j11_entrypoints", lambda c: _sym(joins.entrypoint_symbols(c, ("class", "function"))), f"select {SYM} from symbols where {_ENTRY} and kind in ('class', 'function')")
_add("j12_internal_callables", lambda c: _sym(joins.internal_callables(c)), f"select {SYM} from symbols s where {_INTERNAL}")
_add("j13_inheriting", lambda c: _sym(joins.inheriting(c, id_="n4")), f"select {SYM} from symbols where len(list_filter(inheritence, lambda x: x.inherits_from_id = 'n4')) > 0")
_add("j14_need_embeddings", lambda c: _sym(joins.needing_embeddings(c, ["parts/f1.ts", "geo/r1.ts"])), f"select {SYM} from symbols where id not in (select symbol_id from vec_symbols) and file_path in ('parts/f1.ts', 'geo/r1.ts')")
_add("j17_all_exceptions", lambda c: joins.all_exceptions(c).select("id", "symbol_name", "exception_type", "line"), "select x.id, coalesce(s.name, 'Unknown') as symbol_name, x.exception_type, x.line from exceptions x left join symbols s on s.id = x.symbol_id")
_add("j18_all_env_vars", lambda c: joins.all_env_vars(c).select("id", "symbol_name", F.col("name").alias("env_name"), "line"), "select x.id, coalesce(s.name, 'Unknown') as symbol_name, x.name as env_name, x.line from env_vars x left join symbols s on s.id = x.symbol_id")
_add("j19_pending_sites", lambda c: joins.pending_sites(c).select("id", "caller_id"), "select distinct s.id, s.caller_id from call_sites s left join call_edges e on e.call_site_id = s.id where e.id is null or e.resolution_source = 'unresolved' or (e.resolution_source = 'source_import' and e.callee_id is null)")
_THROUGH = """called as (select distinct callee_id as id from call_edges where callee_id is not null),
    thru as (select p.name as type_name, s.name as callee_name from symbols s join called using (id) join symbols p on p.id = s.parent_id
      union select unnest(i."importedNames"), cs.callee_name from call_edges e join call_sites cs on cs.id = e.call_site_id join imports i on i.id = e.imports_id where e.callee_id is null),
    bases as (select id as parent_id, unnest(inheritence).inherits_from_name as type_name, generate_subscripts(inheritence, 1) as pos from symbols where inheritence is not null),
    firsts as (select parent_id, arg_min(type_name, pos) as type_name from bases where type_name in (select type_name from thru) group by 1),
    covered as (select distinct m.id from symbols m join firsts f on f.parent_id = m.parent_id join thru t on t.type_name = f.type_name and t.callee_name = m.name)"""
_add("j20_inheritance_covered", lambda c: joins.inheritance_covered(c), f"with {_THROUGH} select id from covered")
_add("j21_via_imports", lambda c: joins.via_imports(c), """select distinct unnest(i."importedNames") as type_name, cs.callee_name from call_edges e join call_sites cs on cs.id = e.call_site_id join imports i on i.id = e.imports_id where e.callee_id is null""")

# Aggregates ----------------------------------------------------------------

_add("a01_usage_totals", agg.usage_totals, "select count(*) as calls, cast(sum(tokens_saved) as bigint) as tokens_saved, cast(sum(source_tokens) as bigint) as source_tokens, cast(sum(response_tokens) as bigint) as response_tokens from tool_usage")
_add("a02_usage_by_tool", agg.usage_by_tool, "select tool_name, count(*) as calls, cast(sum(tokens_saved) as bigint) as tokens_saved, cast(sum(source_tokens) as bigint) as source_tokens, cast(sum(response_tokens) as bigint) as response_tokens from tool_usage group by 1")
_add("a03_call_counts", lambda c: joins.key_symbols(c, limit=None).select("id", "call_count"), f"with pub as ({_PUBLIC}) select pub.id, count(e.id) as call_count from pub left join call_edges e on e.callee_id = pub.id group by 1")
_add("a04_estimated_tokens", lambda c: agg.estimated_tokens(c, c.files.filter("language = 'fr'").select("path")), "select cast(sum(estimated_tokens) as bigint) as tokens from files where language = 'fr'")
_add("a05_churn", lambda spark, d: agg.churn_by_path(projection.churn(spark, d)), "select path, cast(added as bigint) as added, cast(removed as bigint) as removed, commits from churn", raw=True)
_add("a07_kind_counts", agg.symbols_per_file, "select file_path, count(*) as total, count(*) filter (where kind in ('interface', 'type')) as abstract, count(*) filter (where exported) as exported from symbols group by 1")
_PAIRS = """pairs as (select distinct file_path as src, "resolvedPath" as dst from imports where "resolvedPath" is not null and file_path <> "resolvedPath")"""
_FANS = "fans as (select node, sum(o) as ce, sum(i) as ca from (select src as node, 1 as o, 0 as i from pairs union all select dst, 0, 1 from pairs) group by 1)"
_add("a08_fan_in_out", lambda c: agg.fan_out_in(agg.import_edges(c)), f"with {_PAIRS}, {_FANS} select node, cast(ce as bigint) as ce, cast(ca as bigint) as ca from fans")
_add("a09_degrees", lambda c: agg.degrees(graph.call_graph(c).distinct()), "with e as (select distinct caller_id as s, callee_id as t from call_edges where callee_id is not null) select node, count(*) as degree from (select s as node from e union all select t from e) group by 1")
_add("a10_symbols_by_kind", lambda c: agg.symbols_by_kind(c, "geo/r2.ts").select("kind", F.array_join("names", ",").alias("names")), "select kind, string_agg(name, ',' order by line, id) as names from symbols where file_path = 'geo/r2.ts' group by 1")
_add("a11_files_by_dir", lambda c: agg.files_by_dir(c, 2), "select array_to_string(string_split(path, '/')[1:2], '/') as dir, count(*) as files, cast(sum(estimated_tokens) as bigint) as tokens from files group by 1")
_add("a12_last_indexed", lambda c: agg.last_indexed(c, NOW), f"select max(indexed_at) as last_indexed, cast(floor(({NOW} - max(indexed_at)) / 60000.0) as bigint) as minutes_ago from files")
_HEALTH = """select 'files' as "check", count(*) as n from files union all select 'symbols', count(*) from symbols union all select 'imports', count(*) from imports
    union all select 'call_sites', count(*) from call_sites union all select 'call_edges', count(*) from call_edges
    union all select 'orphan_call_sites', count(*) from call_sites where caller_id not in (select id from symbols)
    union all select 'orphan_call_edges', count(*) from call_edges where call_site_id not in (select id from call_sites)
    union all select 'unresolved_edges', count(*) from call_edges where resolution_source = 'unresolved'
    union all select 'symbols_without_file', count(*) from symbols where file_path not in (select path from files)"""
_add("m35_health", modes.index_health, _HEALTH)

# Graphs --------------------------------------------------------------------

_add("g01_subtree", lambda c: graph.subtree(c, "r1").select("id", "depth"), "with recursive below as (select id, 0 as depth from symbols where id = 'r1' union all select s.id, b.depth + 1 from symbols s join below b on s.parent_id = b.id) select id, depth from below")
_add("g02_parent_class", graph.parent_class, """with recursive up as (select id, id as at_, kind, parent_id from symbols
    union all select u.id, s.id, s.kind, s.parent_id from up u join symbols s on s.id = u.parent_id where u.kind <> 'class') select id, at_ as class_id from up where kind = 'class'""")
_E = "e as (select distinct caller_id as s, callee_id as t from call_edges where callee_id is not null)"
_add("g05_reachable", lambda spark, d: graph.reachable_symbols(projection.project(spark, d), _name7(spark, d)), f"""
    with recursive {_E}, start as (select id, parent_id from symbols where name = {_NAME7}),
    go as (select id from start union select parent_id from start where parent_id is not null union select e.t from go join e on e.s = go.id),
    below as (select id from start union select s.id from symbols s join below b on s.parent_id = b.id)
    select id from go union select id from below""", raw=True)
_add("g06_blast_radius", lambda c: graph.blast_radius(c, c.symbols.filter("id = 'p3'").select(F.col("id").alias("node"))).select("node"), f"""
    with recursive {_E}, r as (select t as a, s as b from e union select y.parent_id, e.s from e join symbols y on y.id = e.t where y.parent_id is not null),
    go as (select 'p3' as node union select r.b from go join r on r.a = go.node) select node from go""", written=True)
_RANKS = """with recursive e as (select caller_id as a, callee_id as b from call_edges where callee_id is not null), deg as (select a, count(*) as d from e group by 1),
    nodes as (select a as n from e union select b from e), cnt as (select count(*)::double as c from nodes),
    pr(i, n, r) as (select 0, n, 1 / c from nodes, cnt union all
      select pr_i + 1, n, r from (select max(p.i) as pr_i, x.n as n, 0.15 / max(cnt.c) + 0.85 * sum(x.v) as r from (select i from pr limit 1) p,
        (select n, 0.0 as v from nodes union all select e.b, pr.r / deg.d from pr join e on e.a = pr.n join deg on deg.a = e.a) x, cnt group by x.n) q where pr_i < 30)"""
_add("g07_pagerank", lambda c: graph.pagerank(graph.call_graph(c)).select(F.col("node").alias("id"), F.round("rank", 6).alias("rank")), f"""
    {_RANKS} select n as id, round(r, 6) as rank from pr where i = 30""")
_SCC = """reach as (select src, dst from pairs union select r.src, p.dst from reach r join pairs p on p.src = r.dst),
    both_ as (select a.src as node, least(a.src, min(a.dst)) as scc from reach a join reach b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src)"""
_add("g09_scc", lambda c: graph.cyclic_components(agg.import_edges(c)), f"with recursive {_PAIRS}, {_SCC} select scc, node from both_")
_add("m32_cycles", lambda c: modes.dependency_cycles(c), f"with recursive {_PAIRS}, {_SCC} select cast(count(*) as integer) as size, string_agg(node, ' ' order by node) as members from both_ group by scc order by size desc, members limit 20")
_add("g10_reachable_from_entries", lambda c: graph.reach(graph.call_graph(c), c.symbols.filter("kind = 'class' and exported").select(F.col("id").alias("node"))).select("node"), f"""
    with recursive {_E}, go as (select id as node from symbols where kind = 'class' and exported union select e.t from go join e on e.s = go.node) select node from go""")
_add("g12_hierarchy", lambda c: modes.class_hierarchy(c, "n4").select("relation", "id", "name"), """
    select 'ancestor' as relation, p.id, p.name from symbols s join symbols p on p.id = s.parent_id where s.id = 'n4'
    union all select 'member', id, name from symbols where parent_id = 'n4'
    union all select 'heir', id, name from symbols where len(list_filter(inheritence, lambda x: x.inherits_from_id = 'n4')) > 0""")
_add("g03_trace", lambda c: modes.trace(c, ["p3"], "out", 2).select("src", "dst", "depth"), f"""
    with {_E}, one as (select s, t from e where s = 'p3') select s as src, t as dst, 1 as depth from one
    union all select s, t, 2 from e where s in (select t from one) and s <> 'p3'""")

# Search --------------------------------------------------------------------


def _vector7(c: Catalog) -> list[float]:
    return list(c.vec_symbols.filter("symbol_id = 'p7'").first().embedding)


_DIST = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double))))"
_NEAR = f"near as (select v.symbol_id, {_DIST} as distance from vec_symbols v, (select embedding from vec_symbols where symbol_id = 'p7') q)"
_add("v01_knn", lambda c: search.nearest(c, _vector7(c), 20).select("symbol_id", F.round("distance", 6).alias("distance")), f"with {_NEAR} select symbol_id, round(distance, 6) as distance from near order by near.distance, symbol_id limit 20")
_add("v02_rrf", lambda c: search.hybrid(c, "*e*", _vector7(c), ("function", "class"), "parts", None, 20).select("id", F.round("score", 9).alias("score")), f"""
    with {_NEAR}, top as (select * from near order by distance, symbol_id limit 40),
    t as (select id, row_number() over (order by file_path, line, id) as p from (select * from symbols where name ilike '%e%' and kind in ('function', 'class') and file_path ilike '%parts%' order by file_path, line, id limit 40)),
    v as (select s.id, row_number() over (order by distance, symbol_id) as p from top join symbols s on s.id = symbol_id where kind in ('function', 'class') and contains(file_path, 'parts'))
    select id, round(score, 9) as score from (select coalesce(t.id, v.id) as id, coalesce(1 / (60.0 + t.p), 0) + coalesce(1 / (60.0 + v.p), 0) as score from t full join v on t.id = v.id) order by score desc, id limit 20""")
_add("v03_embedding_text", lambda c: search.embedding_text(c.with_(symbols=joins.needing_embeddings(c))).select("id", "text"), "select id, concat_ws(chr(10), name, kind, file_path) as text from symbols where id not in (select symbol_id from vec_symbols)")
_add("v03_embedding_text_all", search.embedding_text, "select id, concat_ws(chr(10), name, kind, file_path) as text from symbols")


# Modes ---------------------------------------------------------------------

_add("m02_files_detailed", lambda c: modes.search_files(c.with_(symbols=c.symbols.withColumn("file_path", F.lit("src/src1/en/d1.txt"))), "src/src1/", limit=10, detailed=True).select("path", "symbols", "exported"), """
    select path, case when path = 'src/src1/en/d1.txt' then (select count(*) from symbols) else 0 end as symbols, case when path = 'src/src1/en/d1.txt' then (select count(*) from symbols where exported) else 0 end as exported
    from (select path from files where path ilike '%src/src1/%' order by path limit 10)""")
_add("m10_references", lambda spark, d: modes.references(projection.project(spark, d), _name7(spark, d)), f"""
    select distinct 'call' as ref_kind, caller_file as file_path, caller_name as name, caller_line as line from ({_NESTED.format(caller=_CALLER, target=f"lower(t.name) = lower({_NAME7})")})
    union all select 'import', file_path, "sourceModule", null from imports where list_contains("importedNames", {_NAME7})""", raw=True)
_add("m13_resolve_type", lambda c: modes.resolve_type(c, "ECONOMY", None).select("role", "id"), "select 'producer' as role, id from symbols where return_type ilike '%ECONOMY%'")
_add("m16_blast_radius", lambda c: modes.blast_radius(c.with_(symbols=c.symbols.withColumn("name", F.when(F.col("id") == "p3", "the one").otherwise(F.col("name")))), "the one").select("id"), f"""
    with recursive {_E}, r as (select t as a, s as b from e union select y.parent_id, e.s from e join symbols y on y.id = e.t where y.parent_id is not null),
    go as (select 'p3' as node union select r.b from go join r on r.a = go.node) select node as id from go where node <> 'p3'""")
_OWNERS = "select 'c' || c_custkey as id from customer where c_mktsegment = 'BUILDING'"
_add("m18_required_env_vars", lambda c: modes.required_env_vars(c, "NATION_3").select("id", "symbol_name", "scope"), """
    with f as (select id from symbols where name = 'NATION_3'), r as (select id from f union select parent_id from symbols where name = 'NATION_3' union select s.id from symbols s join f on s.parent_id = f.id)
    select x.id, coalesce(s.name, 'Unknown') as symbol_name, case when lower(s.name) = 'nation_3' then 'direct' else 'downstream' end as scope from env_vars x left join symbols s on s.id = x.symbol_id where x.symbol_id in (select id from r)""")
_add("m19_error_flow", lambda c: modes.error_flow(c, "NATION_3").select("id", "exception_type", "scope"), """
    with f as (select id from symbols where name = 'NATION_3'), r as (select id from f union select parent_id from symbols where name = 'NATION_3' union select s.id from symbols s join f on s.parent_id = f.id)
    select x.id, x.exception_type, case when lower(s.name) = 'nation_3' then 'direct' else 'downstream' end as scope from exceptions x left join symbols s on s.id = x.symbol_id where x.symbol_id in (select id from r)""")
_add("m20_data_flow", lambda c: modes.data_flow(c.with_(symbols=c.symbols.withColumn("parameters_json", F.lit('[{"name":"a","type":"int"},{"name":"b","type":"X"}]'))), "p3", 15), f"""
    with callee as (select coalesce(t.name, s.callee_name) as name, coalesce(t.file_path, i."sourceModule") as file_path, s.call_line as line from call_edges e join call_sites s on s.id = e.call_site_id
      left join symbols t on t.id = e.callee_id left join imports i on i.id = e.imports_id where e.caller_id = 'p3' order by 3, 1, 2 nulls first limit 15),
    caller as (select distinct caller_name as name, caller_file as file_path, caller_line as line from ({_NESTED.format(caller=_CALLER, target="t.id = 'p3'")}) order by 2, 3, 1 limit 15)
    select 'callee' as role, name, file_path, line from callee union all select 'caller', name, file_path, line from caller
    union all select 'return', return_type, null, null from symbols where id = 'p3' and return_type is not null union all select 'parameter', n, t, null from (values ('a', 'int'), ('b', 'X')) v(n, t)""")
_add("m21_key_symbols_by_dir", lambda c: modes.codebase_map(c.with_(files=c.symbols.select(F.col("file_path").alias("path"), F.lit(0).cast("long").alias("estimated_tokens")).distinct())).select("dir", "files", "layer", F.array_join(F.transform("key_symbols", lambda x: x["name"]), ",").alias("keys")), f"""
    with pub as ({_PUBLIC}), k as (select pub.id, pub.name, string_split(file_path, '/')[1] as dir, count(e.id) as n from pub left join call_edges e on e.callee_id = pub.id group by 1, 2, 3),
    best as (select *, row_number() over (partition by dir order by n desc, id) as r from k), top as (select dir, string_agg(name, ',' order by r) as keys from best where r <= 5 group by 1)
    select dir, (select count(distinct file_path) from symbols where string_split(file_path, '/')[1] = dir) as files, 0 as layer, keys from top""", written=True)
_add("m22_entry_points", lambda c: modes.entry_points(c, only_unreferenced=True), f"""select {SYM} from symbols where {_ENTRY} and kind in ('function', 'class', 'const', 'arrowFunction', 'interface', 'type') and name not in (select unnest("importedNames") from imports)""")
_add("m23_explore", lambda c: modes.explore(c, "parts", None, 80).select("id", "degree", "score"), f"""
    with recursive {_E}, entry as (select id from symbols where {_ENTRY}), go as (select id as node from entry union select e.t from go join e on e.s = go.node),
    deg as (select node, count(*) as degree from (select s as node from e union all select t from e) group by 1)
    select s.id, d.degree, d.degree + (case when s.id in (select id from entry) then 1000 else 0 end) + (case when s.id in (select node from go) then 100 else 0 end) as score
    from symbols s join deg d on d.node = s.id where contains(s.file_path, 'parts') order by score desc, s.id limit 80""")
_FILE97 = "concat('parts/f', regexp_extract({}, '([0-9]+)', 1) :: bigint % 97, '.ts')"


def _by_file97(c: Catalog) -> Catalog:
    """Imports between the files that hold the parts' symbols."""
    mod = lambda x: F.concat(F.lit("parts/f"), F.regexp_extract(x, r"([0-9]+)", 1).cast("long") % 97, F.lit(".ts"))
    return c.with_(imports=c.imports.withColumn("file_path", mod("file_path")).withColumn("resolvedPath", mod("resolvedPath")))


_COUPLING = f"""pairs as (select distinct {_FILE97.format('file_path')} as src, {_FILE97.format('"resolvedPath"')} as dst from imports), own as (select * from pairs where src <> dst),
    fans as (select node, sum(o) as ce, sum(i) as ca from (select src as node, 1 as o, 0 as i from own union all select dst, 0, 1 from own) group by 1),
    f as (select file_path, count(*) as total, count(*) filter (where kind in ('interface', 'type')) as abstract from symbols group by 1),
    m as (select f.file_path, coalesce(ce, 0) as ce, coalesce(ca, 0) as ca, abstract / total as a, case when coalesce(ce, 0) + coalesce(ca, 0) > 0 then ce / (ce + ca) else 0 end as i from f left join fans on node = f.file_path)"""
_add("m24_coupling", lambda c: agg.coupling(_by_file97(c)).select("file_path", "ce", "ca", F.round("instability", 6).alias("instability"), F.round("abstractness", 6).alias("abstractness"), F.round("distance", 6).alias("distance")), f"""
    with {_COUPLING} select file_path, cast(ce as bigint) as ce, cast(ca as bigint) as ca, round(i, 6) as instability, round(a, 6) as abstractness, round(abs(a + i - 1), 6) as distance from m""")
_DEAD = f"""with {_THROUGH}, names as (select distinct unnest("importedNames") as name from imports), alive as (select id from called union select id from covered),
    dead as (select 'exported' as part, s.* from symbols s where {_ENTRY} and name not in (select name from names) union all select 'internal', s.* from symbols s where {_INTERNAL})
    select id, name, kind, file_path, line, part from dead where id not in (select id from alive) and not (kind = 'method' and name in ('constructor', '__init__', 'new'))"""
_add("m25_dead_code", lambda c: modes.dead_code(c, limit=50), f"{_DEAD} order by part, file_path, line, id limit 50")
_add("m25_dead_code_all", lambda c: modes.dead_code(c, limit=None), _DEAD)


def _with_tests(c: Catalog) -> Catalog:
    """Every third part file is a test, and indexed like the others."""
    named = lambda x: F.when(F.regexp_extract(x, r"f([0-9]+)\.ts", 1).try_cast("int") % 3 == 0, F.concat(F.lit("tests/"), x)).otherwise(F.col(x))
    symbols = c.symbols.withColumn("file_path", named("file_path"))
    imports = _by_file97(c).imports.withColumn("file_path", named("file_path")).withColumn("resolvedPath", named("resolvedPath"))
    return c.with_(symbols=symbols, imports=imports, files=symbols.select(F.col("file_path").alias("path")).distinct())


_T = "case when try_cast(regexp_extract({x}, 'f([0-9]+)[.]ts', 1) as int) % 3 = 0 then concat('tests/', {x}) else {x} end"
_add("m26_untested", lambda c: modes.untested(_with_tests(c), limit=None).select("id", "file_path"), f"""
    with s as (select id, name, kind, parent_id, exported, {_T.format(x='file_path')} as file_path from symbols),
    i as (select {_T.format(x=_FILE97.format('file_path'))} as file_path, {_T.format(x=_FILE97.format('"resolvedPath"'))} as dst from imports),
    seen as (select file_path as p from s where file_path like 'tests/%' union select dst from i where file_path like 'tests/%')
    select id, file_path from s where exported and parent_id in (select id from s where name = '<module>') and kind in ('function', 'method', 'arrowFunction', 'class') and file_path not in (select p from seen)""")
_add("m17_related_tests", lambda c: modes.related_tests(_with_tests(c), "parts/f4.ts").select("path"), f"""
    with i as (select {_T.format(x=_FILE97.format('file_path'))} as file_path, {_T.format(x=_FILE97.format('"resolvedPath"'))} as dst, "sourceModule" as sm from imports)
    select distinct file_path as path from i where (dst ilike '%parts/f4.ts%' or sm ilike '%parts/f4.ts%') and file_path like 'tests/%'""")
_add("m27_similar", lambda c: modes.similar_patterns(c, c.symbols.filter("id = 'p8'").first(), ("kind", "return_type", "inheritance")), f"""
    select x.{SYM.replace(', ', ', x.')} from symbols x, (select * from symbols where id = 'p8') q where x.id <> q.id and x.kind = q.kind and x.return_type ilike '%' || q.return_type || '%'
    and (q.inheritence is null or list_has_any(list_transform(x.inheritence, lambda b: b.inherits_from_name), list_transform(q.inheritence, lambda b: b.inherits_from_name))) order by x.file_path, x.line, x.id limit 20""")
_add("m28_importance", lambda c: modes.importance(c, 20).select("id"), f"""
    {_RANKS} select n as id from (select n, round(r, 9) as rank from pr where i = 30) q join symbols s on s.id = q.n
    where not (s.file_path like 'tests/%' or s.file_path like '%/tests/%') order by rank desc, n limit 20""")
_add("m29_hotspots", lambda spark, d: modes.hotspots(projection.project(spark, d), projection.churn(spark, d)).select("path", F.round("score", 4).alias("score")), """
    with s as (select file_path as path, count(*) as n from symbols group by 1) select c.path, round((added + removed) * (1 + coalesce(n, 0) / 10), 4) as score from churn c left join s using (path) order by (added + removed) * (1 + coalesce(n, 0) / 10) desc, c.path limit 20""", raw=True)
_add("m33_stale_refs", lambda spark, d: modes.stale_references(projection.project(spark, d), projection.agent_docs(spark, d)), r"""
    with p as (select distinct path, unnest(regexp_extract_all(content, '(?m)(?:^|[\s`''"(])([a-zA-Z][\w./\-]*\/[\w./\-]+(\.\w{1,6})?)(?:$|[\s`''")\]:,])', 1)) as ref from agent_docs),
    y as (select distinct path, unnest(regexp_extract_all(content, '`([A-Za-z_$][\w$]*)`', 1)) as ref from agent_docs)
    select path, 'path' as kind, ref from p where ref not in (select path from files) union all select path, 'symbol', ref from y where length(ref) >= 3 and ref not in (select name from symbols)""", raw=True)
_add("m34_token_savings", modes.token_savings, """
    select cast(null as varchar) as tool_name, count(*) as calls, cast(sum(tokens_saved) as bigint) as tokens_saved, cast(sum(source_tokens) as bigint) as source_tokens, cast(sum(response_tokens) as bigint) as response_tokens, round(sum(tokens_saved) * 3.0 / 1e6, 4) as cost from tool_usage
    union all select tool_name, count(*), cast(sum(tokens_saved) as bigint), cast(sum(source_tokens) as bigint), cast(sum(response_tokens) as bigint), round(sum(tokens_saved) * 3.0 / 1e6, 4) from tool_usage group by 1""")

# Changes -------------------------------------------------------------------


def _half(c: Catalog) -> tuple[Catalog, DataFrame, DataFrame]:
    """An older index that lacks every third symbol of some files and has others that are gone."""
    paths = c.symbols.filter("file_path like 'parts/f1%'").select(F.col("file_path").alias("path")).distinct()
    key = F.regexp_extract("id", r"([0-9]+)", 1).cast("long")
    new = lookup.among(c.symbols, "file_path", paths).filter(key % 5 != 0)
    return c.with_(symbols=c.symbols.filter(key % 3 != 0)), new, paths


_add("w02_diff_upsert", lambda c: (lambda x: changes.diff_symbols(x[0].symbols, x[1], x[2]))(_half(c)), """
    with k as (select id, file_path, cast(regexp_extract(id, '([0-9]+)', 1) as bigint) as n from symbols), old as (select * from k where n % 3 <> 0), new as (select * from k where file_path like 'parts/f1%' and n % 5 <> 0)
    select id, 'insert' as change from new where id not in (select id from old) union all select id, 'delete' from old where file_path like 'parts/f1%' and id not in (select id from new)""")
_add("w01_upsert_files", lambda c: changes.upsert_files(c.with_(files=c.files.filter("language <> 'fr'")), c.files.filter("language in ('fr', 'de')"), 7).files.select("path", "indexed_at"), "select path, case when language in ('fr', 'de') then 7 else indexed_at end as indexed_at from files")
_add("w03_replace_imports", lambda c: changes.replace_for_files(c.imports, c.imports.filter("resolvedPath like '%1.ts'"), c.imports.filter("file_path like 'parts/p1%'").select(F.col("file_path").alias("path")).distinct()).select("id"), """
    select id from imports where file_path not like 'parts/p1%' union all select id from imports where "resolvedPath" like '%1.ts'""")
_add("w05_last_edges", lambda c: changes.last_edges(c.call_edges.withColumn("call_site_id", F.substring_index("call_site_id", "-", 3)), "confidence").select("id"), """
    select id from (select id, row_number() over (partition by array_to_string(string_split(call_site_id, '-')[1:3], '-'), caller_id order by confidence desc, id desc) as n from call_edges) where n = 1""")
_add("w11_cascade_delete", lambda c: _counts(changes.delete_files(c, c.symbols.filter("file_path like 'parts/f1%'").select(F.col("file_path").alias("path")).distinct())), """
    with gone as (select id from symbols where file_path like 'parts/f1%'), s as (select * from call_sites where caller_id not in (select id from gone) and caller_file_path not like 'parts/f1%')
    select 'symbols' as t, count(*) as n from symbols where file_path not like 'parts/f1%' union all select 'call_sites', count(*) from s
    union all select 'call_edges', count(*) from call_edges where call_site_id in (select id from s) union all select 'callees', count(*) from call_edges where call_site_id in (select id from s) and callee_id not in (select id from gone)
    union all select 'vectors', count(*) from vec_symbols where symbol_id not in (select id from gone)""")


def _counts(c: Catalog) -> DataFrame:
    n = lambda t, name: t.agg(F.lit(name).alias("t"), F.count("*").alias("n"))
    return n(c.symbols, "symbols").unionByName(n(c.call_sites, "call_sites")).unionByName(n(c.call_edges, "call_edges")).unionByName(n(c.call_edges.filter("callee_id is not null"), "callees")).unionByName(n(c.vec_symbols, "vectors"))


_add("w12_update_docstrings", lambda c: changes.update_symbols(c, c.symbols.filter("kind = 'interface'").select("id", F.concat(F.lit("doc of "), "name").alias("docstring"))).symbols.filter("docstring is not null").select("id", "docstring"), "select id, 'doc of ' || name as docstring from symbols where kind = 'interface'")
_add("w15_merge_inheritance", lambda c: changes.update_inheritance(c, c.symbols.filter("kind = 'class' and file_path like 'parts/%'").select("id", F.transform("inheritence", lambda x: F.struct(x["inherits_from_name"].alias("inherits_from_name"), F.lit("new").alias("inherits_from_id"), x["inherits_from_imports_id"].alias("inherits_from_imports_id"), x["inheritence_type"].alias("inheritence_type"))).alias("bases"))).symbols.filter("inheritence is not null").select("id", F.size("inheritence").alias("n"), F.col("inheritence")[0]["inherits_from_id"].alias("base")), "select id, cast(len(inheritence) as integer) as n, 'new' as base from symbols where inheritence is not null")

# Resolution ----------------------------------------------------------------


def _cascade(c: Catalog) -> DataFrame:
    """Edges of sites that name parts of the own file, imported ones, builtins, and unknown ones."""
    key = F.regexp_extract("callee_name", r"^(.*)$", 1)
    sites = c.call_sites.withColumn("callee_name", F.when(F.col("call_line") == 1, "parseInt").when(F.col("call_line") == 2, "nowhere").otherwise(key)).withColumn("call_kind", F.when(F.col("call_line") == 7, "dynamic_call").otherwise(F.col("call_kind")))
    imports = c.imports.withColumn("file_path", F.concat(F.lit("parts/f"), F.regexp_extract("file_path", r"([0-9]+)", 1).cast("long") % 97, F.lit(".ts"))).withColumn("resolvedPath", F.concat(F.lit("parts/f"), F.regexp_extract("resolvedPath", r"([0-9]+)", 1).cast("long") % 97, F.lit(".ts")))
    return resolve.resolve_calls(c.with_(imports=imports), sites)


_add("c06_cascade", lambda c: _cascade(c).groupBy("resolution_source", "target_kind", "confidence").agg(F.count("*").alias("n")), f"""
    with cs as (select id, caller_file_path as f, call_line, case when call_line = 1 then 'parseInt' when call_line = 2 then 'nowhere' else callee_name end as nm from call_sites),
    i as (select {_FILE97.format('file_path')} as f, {_FILE97.format('"resolvedPath"')} as dst, unnest("importedNames") as nm, id from imports),
    fn as (select file_path as f, name as nm, min(kind) as k from symbols where kind in ('function', 'method', 'arrowFunction', 'class') group by 1, 2),
    hit as (select cs.id, arg_min(i.dst, i.id) as dst from cs join i on i.f = cs.f and i.nm = cs.nm group by 1),
    r as (select cs.id, case when call_line = 7 then 'dynamic_pattern' when fn.k is not null then 'same_file' when hit.dst is not null then 'source_import' when cs.nm = 'parseInt' then 'builtin_list' else 'unresolved' end as src,
      exists (select 1 from symbols s where s.file_path = hit.dst and s.name = cs.nm) as found
      from cs left join fn on fn.f = cs.f and fn.nm = cs.nm left join hit on hit.id = cs.id)
    select src as resolution_source, case src when 'dynamic_pattern' then 'dynamic' when 'same_file' then 'project_symbol' when 'builtin_list' then 'builtin' when 'unresolved' then 'unresolved' else case when found then 'project_symbol' else 'import' end end as target_kind,
      case src when 'dynamic_pattern' then 100 when 'source_import' then 90 when 'unresolved' then 0 else 80 end as confidence, count(*) as n from r group by 1, 2, 3""")
_add("c06_edges", lambda c: _cascade(c).select("call_site_id", "caller_id", "target_kind", "callee_id", "imports_id", "resolution_source", "confidence"), f"""
    with cs as (select id, caller_id, caller_file_path as f, call_line, case when call_line = 1 then 'parseInt' when call_line = 2 then 'nowhere' else callee_name end as nm from call_sites),
    i as (select {_FILE97.format('file_path')} as f, {_FILE97.format('"resolvedPath"')} as dst, unnest("importedNames") as nm, id from imports),
    fn as (select file_path as f, name as nm, arg_min(id, {{'l': line, 'i': id}}) as k from symbols where kind in ('function', 'method', 'arrowFunction', 'class') group by 1, 2),
    hit as (select cs.id, cs.nm, min(i.id) as imp, arg_min(i.dst, i.id) as dst from cs join i on i.f = cs.f and i.nm = cs.nm group by 1, 2),
    mem as (select hit.id, arg_min(s.id, {{'l': s.line, 'i': s.id}}) as m from hit join symbols s on s.file_path = hit.dst and s.name = hit.nm group by 1),
    r as (select cs.*, fn.k, hit.imp, mem.m, case when call_line = 7 then 'dynamic_pattern' when fn.k is not null then 'same_file' when hit.dst is not null then 'source_import' when cs.nm = 'parseInt' then 'builtin_list' else 'unresolved' end as src
      from cs left join fn on fn.f = cs.f and fn.nm = cs.nm left join hit on hit.id = cs.id left join mem on mem.id = cs.id)
    select id as call_site_id, caller_id, case src when 'dynamic_pattern' then 'dynamic' when 'same_file' then 'project_symbol' when 'builtin_list' then 'builtin' when 'unresolved' then 'unresolved' else if(m is null, 'import', 'project_symbol') end as target_kind,
      case src when 'same_file' then k when 'source_import' then m end as callee_id, case src when 'source_import' then imp end as imports_id, src as resolution_source, case src when 'dynamic_pattern' then 100 when 'source_import' then 90 when 'unresolved' then 0 else 80 end as confidence from r""")
_add("r07_import_targets", lambda c: resolve.import_targets(c.imports.select("id", F.regexp_replace("sourceModule", r"^parts/p(\d+)$", "parts/f$1").alias("target")), c.symbols.select(F.col("file_path").alias("path")).distinct()), """
    with f as (select distinct file_path as path from symbols) select i.id, f.path as "resolvedPath" from imports i join f on f.path = replace(i."sourceModule", 'parts/p', 'parts/f') || '.ts'""")

# Scalars -------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "source", "lang")


_add("x02_truncate", lambda s, d: _texts(s, d).select("doc_id", scalars.truncate(F.col("text")).alias("short"), scalars.node_id(F.col("text")).alias("node")), "select doc_id, case when length(text) > 80 then text[1:79] || '…' else text end as short, regexp_replace(text, '[^A-Za-z0-9_]', '_', 'g') as node from documents", raw=True)
_add("x11_paths", lambda c: c.files.select("path", top_dir("path", 2).alias("dir"), extension("path").alias("ext"), is_test("path").alias("test"), scalars.search_mode(F.col("path")).alias("mode")), "select path, array_to_string(string_split(path, '/')[1:2], '/') as dir, '.txt' as ext, false as test, 'file_compact' as mode from files")
_add("x14_hashes", lambda c: c.symbols.select("id", scalars.symbol_hash(F.col("name"), F.col("kind"), F.col("file_path"), F.col("line"), F.col("column"), F.col("name")).alias("h")), """select id, sha256(name || kind || file_path || line || "column" || name) as h from symbols""")
_add("x10_confidence", lambda c: c.call_edges.select("id", scalars.confidence(F.col("resolution_source")).alias("c"), scalars.resolution_note(F.col("resolution_source"), F.col("confidence")).alias("note")), "select id, confidence as c, case when confidence = 0 then ' [resolution: unresolved, confidence 0]' else ' [resolution: ' || resolution_source || ', confidence ' || confidence || ']' end as note from call_edges")
_add("x36_times", lambda c: c.tool_usage.select("id", scalars.duration(F.col("source_tokens") * 997).alias("took"), scalars.start_of_day(F.col("called_at")).alias("day"), scalars.end_of_day(F.col("called_at")).alias("last"), scalars.date_time(F.col("called_at")).alias("at")), """
    select id, case when s = 0 then '0s' else concat_ws(' ', case when s >= 3600 then (s // 3600) || 'h' end, case when s % 3600 >= 60 then (s % 3600 // 60) || 'm' end, case when s % 60 > 0 then (s % 60) || 's' end) end as took,
      called_at // 86400000 * 86400000 as day, called_at // 86400000 * 86400000 + 86399999 as last, strftime(make_timestamp(called_at // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') as at
    from (select *, source_tokens * 997 // 1000 as s from tool_usage)""")
_add("x22_cost", lambda c: c.tool_usage.select("id", scalars.approximate_cost(F.col("tokens_saved")).alias("cost"), scalars.token_estimate(F.col("tool_name")).alias("tokens")), "select id, (tokens_saved * 3 + 50) // 100 / 10000.0 as cost, cast(ceil(length(tool_name) / 4.0) as bigint) as tokens from tool_usage")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of customers as changes of files."""
    return projection.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).cast("string").alias("path"), F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("root"))


#: Bursts of the events in DuckDB: rows (root, k, ts, path, kind), k the burst's number.
_BURSTS = """o as (select cast(user_id % 3 as varchar) as root, ts, cast(user_id % 20 as varchar) as path, event_type as kind,
      case when ts < lag(ts) over (partition by user_id % 3 order by ts) + interval 500 milliseconds then 0 else 1 end as fresh from events),
    g as (select *, sum(fresh) over (partition by root order by ts rows unbounded preceding) as k from o),
    t as (select root, k, min(ts) as start, max(ts) + interval 500 milliseconds as "end" from g group by 1, 2), f as (select root, k, path, max({'ts': ts, 'kind': kind})['kind'] as kind from g group by 1, 2, 3)"""
_add("t02_debounced_batches", lambda spark, d: watch.debounced(_events(spark, d)).select("root", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "path", "kind"), f"""
    with {_BURSTS} select root, epoch_us(start) as start_us, epoch_us("end") as end_us, path, kind from f join t using (root, k)""", raw=True)
_add("t03_last_events", lambda spark, d: watch.last_events(_events(spark, d).withColumn("seq", F.unix_micros("ts"))).select("path", "kind", "seq"), "select path, max({'s': epoch_us(ts), 'k': kind})['k'] as kind, max(epoch_us(ts)) as seq from (select *, cast(user_id % 20 as varchar) as path, event_type as kind from events) group by 1", raw=True)
# More lookups, counts and changes, by inventory id ---------------------------

_add("f07_symbols_of_file", lambda c: _sym(lookup.symbols_of_files(c, ["geo/r3.ts"])), f"select {SYM} from symbols where file_path = 'geo/r3.ts'")
_add("f12_need_docstrings_in_file", lambda c: _sym(lookup.without_docstring(c, ("class", "function"), "parts/f9.ts")), f"select {SYM} from symbols where kind in ('class', 'function') and name <> '<module>' and coalesce(docstring, '') = '' and file_path = 'parts/f9.ts'")
_add("f15_file_hash", lambda c: lookup.file_hash(c, "src/src1/en/d1.txt"), "select hash from files where path = 'src/src1/en/d1.txt'")
_add("f20_import_by_id", lambda spark, d: (lambda c: _imp(lookup.import_by_id(c, c.imports.agg(F.min("id")).first()[0])))(projection.project(spark, d)), f"select {_IMPORTS} from imports where id = (select min(id) from imports)", raw=True)
_add("f22_imports_by_name_and_file", lambda c: _imp(lookup.imports_by_name(c.with_(imports=c.imports.withColumn("file_path", F.lit("one.ts"))), "small ring", "one.ts")), f"""select id, 'one.ts' as file_path, "sourceModule", "resolvedPath" from imports where list_contains("importedNames", 'small ring')""")
_add("f25_import_between", lambda c: _imp(c.imports.join(lookup.import_between(c.with_(imports=c.imports.withColumn("file_path", F.lit("one.ts"))), "one.ts", "parts/p3.ts").select("id"), "id", "left_semi")), f"""select {_IMPORTS} from imports where "resolvedPath" = 'parts/p3.ts'""")
_add("f35_symbols_by_ids_frame", lambda c: _sym(lookup.symbols_by_ids(c, [f"p{i}" for i in range(300)])), f"select {SYM} from symbols where id in (select 'p' || unnest(range(300)))")
_add("s06_all_files", lambda c: c.files.select("path", "hash", "language"), "select path, hash, language from files")
_add("s08_all_imports", lambda c: _imp(c.imports.orderBy("file_path", "resolvedPath")), f"select {_IMPORTS} from imports")
_add("a06_symbols_per_file", lambda c: c.symbols.groupBy("file_path").agg(F.count("*").alias("n")), "select file_path, count(*) as n from symbols group by 1")
_add("a14_exported_counts", lambda c: agg.symbols_per_file(c).select("file_path", "total", "exported"), "select file_path, count(*) as total, count(*) filter (where exported) as exported from symbols group by 1")
_add("j22_implementations_at", lambda c: _sym(joins.implementations_at(c, c.symbols.filter("kind = 'interface' and file_path like 'parts/f1%'"))), f"select {SYM} from symbols where (file_path, line) in (select (file_path, line) from symbols where kind = 'interface' and file_path like 'parts/f1%')")
_add("j16_downstream_env_vars", lambda spark, d: modes.required_env_vars(projection.project(spark, d), "NATION_5").groupBy("scope").agg(F.count("*").alias("n")), """
    with f as (select id from symbols where name = 'NATION_5'), r as (select id from f union select parent_id from symbols where name = 'NATION_5' union select s.id from symbols s join f on s.parent_id = f.id)
    select case when lower(s.name) = 'nation_5' then 'direct' else 'downstream' end as scope, count(*) as n from env_vars x left join symbols s on s.id = x.symbol_id where x.symbol_id in (select id from r) group by 1""", raw=True)
_add("t06_changed_files", lambda c: c.files.join(c.files.withColumn("hash", F.when(F.col("language") == "fr", F.lit("old")).otherwise(F.col("hash"))).filter("language <> 'es'").select("path", "hash"), ["path", "hash"], "left_anti").select("path"), "select path from files where language in ('fr', 'es')")
_add("w08_upsert_vectors", lambda c: changes.upsert_vectors(c, c.vec_symbols.filter("symbol_id like 'p1%'").withColumn("embedding", F.slice("embedding", 1, 2))).vec_symbols.select("symbol_id", F.size("embedding").alias("n")), "select symbol_id, case when symbol_id like 'p1%' then 2 else cast(len(embedding) as integer) end as n from vec_symbols")
_add("w10_delete_vectors_of_files", lambda c: changes.delete_vectors_of_files(c, c.symbols.filter("file_path like 'parts/f1%'").select(F.col("file_path").alias("path")).distinct()).vec_symbols.select("symbol_id"), "select symbol_id from vec_symbols where symbol_id not in (select id from symbols where file_path like 'parts/f1%')")
_add("w13_remove_docstrings", lambda c: changes.without_docstrings(c.with_(symbols=c.symbols.withColumn("docstring", F.col("name"))), ("class", "type")).symbols.groupBy("kind").agg(F.count("docstring").alias("n")), "select kind, count(case when kind not in ('class', 'type') then name end) as n from symbols group by 1")
_add("w17_usage_row", lambda c: changes.usage_row(c, "read_code", ["src/src1/en/d1.txt", "src/src2/en/d2.txt"], 17, 5).select("tool_name", "source_tokens", "response_tokens", "tokens_saved"), """
    select 'read_code' as tool_name, t as source_tokens, cast(5 as bigint) as response_tokens, greatest(0, t - 5) as tokens_saved from (select cast(coalesce(sum(estimated_tokens), 36) as bigint) as t from files where path in ('src/src1/en/d1.txt', 'src/src2/en/d2.txt'))""")
_add("x09_imported_names", lambda c: c.imports.select("id", F.array_join(scalars.local_names(F.transform("importedNames", lambda x: F.concat(F.lit(" type "), x, F.lit(" as q"))), types=True), ",").alias("local"), F.array_join(scalars.original_names(F.transform("importedNames", lambda x: F.concat(x, F.lit(" as q")))), ",").alias("original")), """select id, 'q' as local, array_to_string("importedNames", ',') as original from imports""")
_add("x21_symbol_refs", lambda spark, d: projection.agent_docs(spark, d).select("path", F.array_join(scalars.symbol_refs(F.col("content")), ",").alias("refs"), F.array_join(scalars.path_refs(F.col("content")), ",").alias("paths")), """
    select path, 'NATION_' || (regexp_extract(path, '([0-9]+)', 1)::int % 40) as refs, 'src/src' || (regexp_extract(path, '([0-9]+)', 1)::int % 20) || '/en/d' || regexp_extract(path, '([0-9]+)', 1) || '.txt,src/x.ts' as paths from agent_docs""", raw=True)


def queries() -> dict[str, Query]:
    return _QUERIES | registry_sources.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | registry_sources.oracle_sql()

# Joins of intervals, prefixes and folders ----------------------------------------


def _spanned(c: Catalog, sf: DataFrame) -> Catalog:
    """Symbols of parts as spans that begin at their line and are as long as the part is large."""
    sized = sf.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("_n"))
    s = c.symbols.join(sized, "id").withColumn("end_line", F.col("line") + F.col("_n")).withColumn("end_column", F.col("_n") % 7)
    return c.with_(symbols=s.select(*c.symbols.columns))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each line of an order: in the file of its part, at a line that its supplier gives."""
    at = projection.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("n"))
    return at.select((F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("position"), F.format_string("parts/f%d.ts", F.col("l_partkey") % 97).alias("file_path"), (F.col("l_suppkey") * 3 % 251).cast("int").alias("line"), F.col("n").cast("int").alias("column"))


_SPANS = """held as (select s.id, s.file_path, s.name, s.kind, s.return_type, s.line as a, 0 as ac, s.line + p_size as b, p_size % 7 as bc from symbols s join part on s.id = 'p' || p_partkey),
    asked as (select l_partkey * 1000000 + l_suppkey as position, 'parts/f' || (l_partkey % 97) || '.ts' as file_path, l_suppkey * 3 % 251 as line, min(l_linenumber) as col from lineitem group by l_partkey, l_suppkey),
    met as (select position, arg_min(h, {'x': -h.a, 'y': -h.ac, 'b': h.b, 'bc': h.bc, 'id': h.id}) as h from asked q join held h on h.file_path = q.file_path and h.a <= q.line and (h.b > q.line or h.b = q.line and h.bc >= q.col) group by position)"""
_add("c15_symbols_at", lambda spark, d: spans.symbols_at(_spanned(projection.project(spark, d), projection.table(spark, d, "part")), _positions(spark, d)), f"with {_SPANS} select position, h.id as id from met", raw=True)
_add("c15_callables_at", lambda spark, d: spans.symbols_at(_spanned(projection.project(spark, d), projection.table(spark, d, "part")), _positions(spark, d), ("function", "method", "arrowFunction", "class")),
     "with " + _SPANS.replace("from symbols s", "from (select * from symbols where kind in ('function', 'method', 'arrowFunction', 'class')) s") + " select position, h.id as id from met", raw=True)
_add("h08_types_at", lambda spark, d: spans.types_at(_spanned(projection.project(spark, d), projection.table(spark, d, "part")), _positions(spark, d)), f"""
    with {_SPANS} select q.position, h.id as id, coalesce(h.name || ': ' || h.return_type, h.kind || ' ' || h.name) as type from asked q left join met using (position)""", raw=True)


def _type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, in the file of its imports, its name cut short, its brand, and its name with more after it."""
    p = projection.table(spark, sf_dir, "part")
    name = F.col("p_name")
    names = F.when(F.col("p_size") % 3 == 0, F.array(F.upper(F.substring(name, 1, 4)))).when(F.col("p_size") % 3 == 1, F.array(F.col("p_brand"), F.concat(name, F.lit("Extra")))).otherwise(F.array(F.lit(""), F.concat(F.lit("x"), name)))
    return p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.format_string("parts/p%d.ts", "p_partkey").alias("file_path"), names.alias("names"))


_add("h06_imports_of_types", lambda spark, d: prefixes.imports_of_types(projection.project(spark, d), _type_names(spark, d)), """
    with t as (select 't' || p_partkey as id, 'parts/p' || p_partkey || '.ts' as file_path,
      unnest(case p_size % 3 when 0 then [upper(p_name[1:4])] when 1 then [p_brand, p_name || 'Extra'] else ['', 'x' || p_name] end) as name from part),
    i as (select id, file_path, resolvedPath, unnest(importedNames) as name from imports)
    select t.id, min({'r': i.resolvedPath, 'i': i.id})['i'] as imports_id from t join i on t.file_path = i.file_path and t.name <> '' and i.name <> ''
      and (starts_with(lower(i.name), lower(t.name)) or starts_with(lower(t.name), lower(i.name))) group by 1""", raw=True)


def _defined(c: Catalog) -> DataFrame:
    """Call sites as if they stood in the file of their caller's imports; a third of the definitions lie in the folder of the imports."""
    n = F.substring("caller_id", 2, 20).cast("long")
    where = F.when(n % 3 == 0, F.lit("parts/any.ts")).when(n % 3 == 1, F.lit("far/away.ts"))
    return c.call_sites.select(F.col("id").alias("site"), F.concat(F.lit("parts/"), "caller_id", F.lit(".ts")).alias("file_path"), where.alias("definition_path"), F.concat(F.lit("made."), "callee_name", F.lit("?.go")).alias("callee_expression"))


_add("c16_imports_of_definitions", lambda c: prefixes.imports_of_definitions(c, _defined(c)), """
    with q as (select id as site, 'parts/' || caller_id || '.ts' as file_path, cast(caller_id[2:] as bigint) % 3 as k, callee_name from call_sites),
    i as (select id, file_path, resolvedPath, importedNames[1] as name from imports),
    near as (select site, min({'r': resolvedPath, 'i': id})['i'] as imp from q join i using (file_path) where k = 0 group by 1),
    chained as (select site, min({'r': resolvedPath, 'i': id})['i'] as imp from q join i using (file_path) where name in ('made', callee_name, 'go') group by 1)
    select site, coalesce(near.imp, chained.imp) as imports_id from q left join near using (site) left join chained using (site) where coalesce(near.imp, chained.imp) is not null""")


def _marked(c: Catalog) -> DataFrame:
    """Compiler settings in the root, in the folders of a third of the sources, and in some of their languages' folders."""
    folder = c.files.select(F.array(F.lit(""), F.concat_ws("/", F.get(F.split("path", "/"), F.lit(0)), F.get(F.split("path", "/"), F.lit(1))), F.regexp_replace("path", "/[^/]*$", "")).alias("d")).select(F.explode("d").alias("dir")).distinct()
    return folder.filter("dir = '' or length(dir) % 3 = 0")


_ABOVE = """folder as (select distinct unnest(['', regexp_extract(path, '^[^/]*/[^/]*'), regexp_replace(path, '/[^/]*$', '')]) as dir from files), marked as (select dir from folder where dir = '' or length(dir) % 3 = 0),
    near as (select path, arg_max(dir, length(dir)) as dir from files join marked on dir = '' or starts_with(path, dir || '/') group by 1)"""
_add("r04_nearest_settings", lambda c: nearest.nearest(c.files, _marked(c)), f"with {_ABOVE} select path, dir from near")


def _aliased(c: Catalog) -> DataFrame:
    """Every file imports its own name by an alias and by one that only the root's settings know."""
    imports = c.files.select(F.explode(F.array(F.lit("@/"), F.lit("~/"), F.lit("@/sub/"), F.lit("./"))).alias("start"), "path").select(F.concat("start", "path").alias("id"), F.col("path").alias("file_path"), F.concat("start", F.regexp_extract("path", "[^/]*$", 0)).alias("sourceModule"))
    pair = lambda p, *t: F.struct(F.lit(p).alias("pattern"), F.array(*map(F.lit, t)).alias("targets"))
    paths = F.when(F.col("dir") == "", F.array(pair("~/*", "top/*", "../*"), pair("@/*", "all/*"))).otherwise(F.array(pair("@/*", "./own/*"), pair("@/sub/*", "../deep/*/index")))
    return nearest.alias_targets(imports, _marked(c).select("dir", F.when(F.length("dir") % 2 == 1, F.lit("./base")).alias("base_url"), paths.alias("paths")))


_add("r03_alias_targets", _aliased, f"""
    with {_ABOVE}, q as (select path, dir, parse_filename(path) as name, if(length(dir) % 2 = 1, concat_ws('/', nullif(dir, ''), 'base'), dir) as base, length(dir) % 2 = 1 as based, unnest(['@/', '~/', '@/sub/']) as start from near),
    t as (select start || path as id, base, based, start || name as module, list_concat(
      case when dir = '' and start = '~/' then ['top/' || name, name] when dir = '' and start = '@/' then ['all/' || name] when dir = '' then ['all/sub/' || name]
        when start = '@/' then [concat_ws('/', nullif(base, ''), 'own/' || name)] when start = '@/sub/' then [concat_ws('/', nullif(regexp_replace(base, '/?[^/]*$', ''), ''), 'deep/' || name || '/index')] else [] end,
      if(based, [concat_ws('/', nullif(base, ''), start || name)], [])) as targets from q)
    select id, unnest(targets) as target, unnest(range(0, len(targets)))::int as at from t""")

# Call trees ------------------------------------------------------------------------


def _nested(c: Catalog) -> Catalog:
    """Parts are named after their ids, and every fourth is a member of the part of a quarter of its number."""
    n = F.substring("id", 2, 20).cast("long")
    parent = F.when((n % 4 == 0) & (n > 0), F.concat(F.lit("p"), F.floor(n / 4).cast("string")))
    return c.with_(symbols=c.symbols.filter(F.col("id").startswith("p")).withColumn("name", F.col("id")).withColumn("parent_id", parent).select(*c.symbols.columns))


def _walk(kids: str) -> str:
    """SQL of a walk from p3 to depth 3, one line at a time, over lists of what is below each symbol."""
    return f"""
    with recursive s as (select id, line, file_path, cast(id[2:] as bigint) as k, case when cast(id[2:] as bigint) % 4 = 0 and cast(id[2:] as bigint) > 0 then 'p' || (cast(id[2:] as bigint) // 4) end as parent from symbols where id like 'p%'),
    e as (select distinct caller_id as a, callee_id as b from call_edges where callee_id is not null),
    {kids},
    walk as (
      select [{{'id': 'p3', 'lv': 0, 'st': 0, 'm': false, 'path': []::varchar[]}}] as stack, []::varchar[] as met, null::int as level, null::varchar as id, null::varchar as parent, null::varchar as mark
      union all
      select list_concat(case when not top.m and not list_contains(met, top.id) and top.st < 3 then coalesce(list_transform(ks, lambda x: {{'id': x.id, 'lv': top.lv + 1 + if(x.m, 0, x.g), 'st': top.st + 1, 'm': x.m, 'path': list_append(top.path, top.id)}}), []) else [] end, stack[2:]),
        case when top.m or list_contains(met, top.id) then met else list_append(met, top.id) end, top.lv, top.id, top.path[-1],
        case when top.m then 'member' when list_contains(top.path, top.id) then 'cycle' when list_contains(met, top.id) then 'revisit' else '' end
      from (select *, stack[1] as top from walk where len(stack) > 0) w left join kids on kids.t = w.top.id)
    select level, id, parent, mark from walk where level is not null"""


_LINES = ("level", "id", "parent", "mark")
_add("g04_inbound_tree", lambda c: calltree.call_lines(_nested(c), "p3", "in", 3).select(*_LINES), _walk("""
    g as (select b as t, 0 as g, null::int as ml, null::varchar as mn, true as caller, s.file_path, s.line, a as id from e join s on s.id = a
      union all select m.parent, 1, m.line, m.id, true, s.file_path, s.line, a from e join s on s.id = a join s m on m.id = b where m.parent is not null
      union all select distinct m.parent, 1, m.line, m.id, false, null, null::int, m.id from e join s on s.id = a join s m on m.id = b where m.parent is not null),
    kids as (select t, list({'id': id, 'm': not caller, 'g': g} order by g, ml, mn, caller, file_path, line, id) as ks from g group by t)"""), written=True)
_add("g03_outbound_tree", lambda c: calltree.call_lines(_nested(c), "p3", "out", 3).select(*_LINES), _walk("""
    made as (select x.caller_id as t, callee_id as id, min(call_line) as line from call_edges x join call_sites y on y.id = x.call_site_id where callee_id is not null group by 1, 2),
    g as (select t, id, 0 as g, line from made union all select parent, id, 2, line from s where parent is not null and id in (select caller_id from call_edges)),
    kids as (select t, list({'id': id, 'm': false, 'g': 0} order by g, line, id) as ks from g group by t)"""))

# What language servers and signatures say ------------------------------------------


def _moved(c: Catalog) -> Catalog:
    """Call sites as if they stood in the file of their caller's imports."""
    return c.with_(call_sites=c.call_sites.withColumn("caller_file_path", F.concat(F.lit("parts/"), "caller_id", F.lit(".ts"))).withColumn("callee_expression", F.concat(F.lit("made."), "callee_name", F.lit("?.go"))))


def _definitions(c: Catalog) -> DataFrame:
    """For each call site by its caller: the callee's own place, a place in the language, in the folder of imports, or one that only the expression explains; and before that one that leads nowhere."""
    k = F.substring("caller_id", 2, 20).cast("long") % 5
    y = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    path = F.when(k == 0, F.format_string("parts/f%d.ts", y % 97)).when(k == 1, "lib/es5.d.ts").when(k == 2, "parts/other.ts").otherwise("far/away.ts")
    line = F.floor(y / 97).cast("int")
    paths = F.when(line % 2 == 0, F.array(F.lit("no/where.ts"), path)).otherwise(F.array(F.lit(None).cast("string"), path))
    return c.call_sites.select(F.col("id").alias("call_site_id"), F.posexplode(paths).alias("n", "path"), line.alias("line"), F.lit(0).alias("column")).filter("path is not null")


def _edges(df: DataFrame) -> DataFrame:
    return df.select("call_site_id", "target_kind", "callee_id", "imports_id", "resolution_source", "confidence")


_add("c12_definition_edges", lambda c: _edges(resolve.resolve_calls(_moved(c), stages=(resolve.unresolved,), definitions=_definitions(c), builtin_paths=("lib/",))), """
    with q as (select id as site, 'parts/' || caller_id || '.ts' as file_path, cast(caller_id[2:] as bigint) % 5 as k, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as y, callee_name from call_sites),
    i as (select id, file_path, resolvedPath, importedNames[1] as name from imports),
    near as (select site, min({'r': resolvedPath, 'i': id})['i'] as imp from q join i using (file_path) where k in (0, 2) group by 1),
    chained as (select site, min({'r': resolvedPath, 'i': id})['i'] as imp from q join i using (file_path) where name in ('made', callee_name, 'go') group by 1),
    r as (select q.*, s.id as callee, case when s.id is null and k <> 1 then coalesce(near.imp, chained.imp) end as imp from q left join near using (site) left join chained using (site)
      left join symbols s on k = 0 and s.id = 'p' || y and s.kind in ('function', 'method', 'arrowFunction', 'class'))
    select site as call_site_id, case when callee is not null then 'project_symbol' when k = 1 then 'builtin' when imp is not null then 'import' else 'unresolved' end as target_kind, callee as callee_id, imp as imports_id,
      if(callee is null and k <> 1 and imp is null, 'unresolved', 'lsp_definition') as resolution_source, if(callee is null and k <> 1 and imp is null, 0, 100) as confidence from r""", written=True)


def _hovers(c: Catalog) -> DataFrame:
    """Two hovers for each call site: one that shows a type that no import has, or nothing, and one that names the callee."""
    k = F.substring("caller_id", 2, 20).cast("long") % 4
    name = F.col("callee_name")
    text = F.when(k == 0, F.concat(name, F.lit(": Widget"))).when(k == 1, F.concat(F.lit("Look:\n```typescript\n(method) ("), name, F.lit(") => Promise<void>\n```\nmore"))).when(k == 2, F.concat(F.lit("no mark "), name)).otherwise(F.concat(F.lit("(alias) q: "), name))
    both = F.array(F.lit("(property) other: Missing"), text)
    return c.call_sites.select(F.col("id").alias("call_site_id"), F.posexplode(both).alias("n", "text"))


_add("c13_hover_edges", lambda c: _edges(resolve.resolve_calls(_moved(c), stages=(resolve.unresolved,), hovers=_hovers(c))), """
    with q as (select id as site, 'parts/' || caller_id || '.ts' as file_path, cast(caller_id[2:] as bigint) % 4 as k, callee_name from call_sites),
    f as (select site, min({'r': resolvedPath, 'i': i.id})['i'] as imp from q join imports i on i.file_path = q.file_path and importedNames[1] = callee_name where k in (0, 1) group by 1)
    select site as call_site_id, if(imp is null, 'unresolved', 'import') as target_kind, null::varchar as callee_id, imp as imports_id, if(imp is null, 'unresolved', 'lsp_hover') as resolution_source, if(imp is null, 0, 60) as confidence from q left join f using (site)""", written=True)


def _signed(c: Catalog, spark: SparkSession, sf_dir: str) -> Catalog:
    """Parts with signatures that name nations, brands and types as bases."""
    n = F.substring("id", 2, 20).cast("long")
    nation = projection.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.regexp_replace("n_name", "[^A-Za-z0-9_]", "_").alias("_n"))
    s = c.symbols.filter("id like 'p%'").withColumn("_k", n % 25).join(nation, "_k")
    text = (
        F.when(F.col("kind") == "class", F.concat(F.lit("class P<T extends Q> extends "), "_n", F.lit("<Map<A, B>, C>\n  implements I1, "), "decorator", F.lit(" {")))
        .when(F.col("kind") == "interface", F.concat(F.lit("interface P extends Missing, Lost")))
        .when((F.col("kind") == "type") & (n % 3 == 0), F.concat(F.lit("type P = "), "_n", F.lit(" & Fn<(a: X) => Y & Z> & Last")))
        .when((F.col("kind") == "type") & (n % 3 == 1), F.concat(F.lit("type P =\n  | "), "_n", F.lit("\n  | 'text'")))
        .when(F.col("kind") == "type", F.concat(F.lit("type P = Pick<"), "_n", F.lit(", 'a' | 'b'>")))
    )
    # Nations are symbols by the same names, so that bases are found among them.
    named = c.symbols.filter("id like 'n%'").withColumn("name", F.regexp_replace("name", "[^A-Za-z0-9_]", "_"))
    return c.with_(symbols=s.withColumn("signature", text).withColumn("inheritence", F.when(F.lit(False), F.col("inheritence"))).select(*c.symbols.columns).unionByName(named))


_add("h03_signature_bases", lambda spark, d: (lambda c: enhance.enhance_bases(_signed(c, spark, d)).symbols.filter("inheritence is not null").select("id", F.posexplode("inheritence").alias("at", "b")).select("id", "at", F.col("b.inherits_from_name").alias("base"), F.col("b.inheritence_type").alias("how")))(projection.project(spark, d)), """
    with p as (select 'p' || p_partkey as id, p_partkey % 3 as k, regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') as n, split_part(p_type, ' ', 1) as t, p_brand from part join nation on n_nationkey = p_partkey % 25),
    x as (select id, case when t = 'ECONOMY' then [{'b': n, 'h': 'extends'}, {'b': 'I1', 'h': 'implements'}] when t = 'SMALL' and k = 0 then [{'b': n, 'h': 'intersection'}, {'b': 'Fn', 'h': 'intersection'}, {'b': 'Last', 'h': 'intersection'}]
      when t = 'SMALL' and k = 1 then [{'b': n, 'h': 'union'}] when t = 'SMALL' then [{'b': n, 'h': 'extends'}] else [] end as l from p)
    select id, unnest(range(0, len(l)))::int as at, unnest(l)['b'] as base, unnest(l)['h'] as how from x""", raw=True)


def _implemented(c: Catalog) -> DataFrame:
    """Interfaces of parts with the places of the two parts after them in their file."""
    face = c.symbols.filter("kind = 'interface' and id like 'p%'").select(F.col("id").alias("interface_id"), "file_path", "line")
    return face.select("interface_id", "file_path", F.explode(F.array(F.col("line") + 1, F.col("line") + 2, F.col("line") + 2)).alias("line"))


_add("h02_implementations", lambda c: enhance.enhance_implementations(c.with_(symbols=c.symbols.filter("id like 'p%'").withColumn("inheritence", F.when(F.lit(False), F.col("inheritence")))), _implemented(c)).symbols.filter("inheritence is not null").select("id", F.explode("inheritence").alias("b")).select("id", F.col("b.inherits_from_name").alias("base"), F.col("b.inheritence_type").alias("how")), """
    with hit as (select distinct s.id, f.name from symbols f join symbols s on s.file_path = f.file_path and s.line in (f.line + 1, f.line + 2) and s.id like 'p%' where f.kind = 'interface' and f.id like 'p%')
    select distinct id, name as base, 'implements' as how from hit""")


def _hovered(c: Catalog) -> DataFrame:
    n = F.substring("id", 2, 20).cast("long")
    text = F.when(n % 3 == 0, F.concat(F.lit("```typescript\n(method) A.f(a: Map<string, number>, b?: "), "return_type", F.lit(", c): Promise<void>\n```"))).when(n % 3 == 1, F.concat(F.lit("(function) def f() -> "), "return_type")).otherwise(F.lit("nothing here"))
    return c.symbols.filter("id like 'p%'").select("id", text.alias("text"))


_add("h01_callable_types", lambda c: enhance.enhance_callables(c, _hovered(c)).symbols.filter("parameters_json is not null").select("id", "parameters_json", "return_type"), """
    select id, case when k = 0 then '[{"name":"a","type":"Map<string, number>"},{"name":"b?","type":"' || return_type || '"},{"name":"c","type":"any"}]' else '[]' end as parameters_json, if(k = 0, 'Promise<void>', return_type) as return_type
    from (select *, cast(id[2:] as bigint) % 3 as k from symbols where id like 'p%') where kind in ('function', 'method', 'arrowFunction') and k < 2""")

# Changes and lookups that had no row of their own ----------------------------------

_add("w09_delete_vectors", lambda c: changes.delete_vectors(c, c.symbols.filter("line % 3 = 0").select("id")).vec_symbols.select("symbol_id", F.size("embedding").alias("n")), "select symbol_id, len(embedding)::int as n from vec_symbols where symbol_id not in (select id from symbols where line % 3 = 0)")
_add("w16_record_usage", lambda c: agg.usage_totals(changes.record_usage(c, changes.usage_row(c, "click", ["src/src1/en/d1.txt"], 17, 5))), """
    with f as (select coalesce(sum(estimated_tokens), 18) as t from files where path = 'src/src1/en/d1.txt')
    select count(*) + 1 as calls, cast(sum(tokens_saved) + max(greatest(0, f.t - 5)) as bigint) as tokens_saved, cast(sum(source_tokens) + max(f.t) as bigint) as source_tokens, cast(sum(response_tokens) + 5 as bigint) as response_tokens from tool_usage, f""")
_add("a15_imports_by_file", lambda c: agg.by_file(c.imports, F.struct("resolvedPath", "id")).select("file_path", "n", F.array_join(F.transform("rows", lambda r: r["id"]), ",").alias("ids")), """select file_path, count(*) as n, string_agg(id, ',' order by "resolvedPath", id) as ids from imports group by 1""")
_add("f35_symbols_by_file", lambda c: agg.by_file(c.symbols, F.struct("line", "id")).select("file_path", "n", F.array_join(F.transform("rows", lambda r: r["id"]), ",").alias("ids")), "select file_path, count(*) as n, string_agg(id, ',' order by line, id) as ids from symbols group by 1")
_add("m03_semantic_search", lambda c: modes.semantic_search(c, "*e*", _vector7(c), ("function", "class"), None, 20, "parts").select("id", "name", F.round("score", 9).alias("score")), f"""
    with {_NEAR}, top as (select * from near order by distance, symbol_id limit 40),
    t as (select id, row_number() over (order by file_path, line, id) as p from (select * from symbols where name ilike '%e%' and kind in ('function', 'class') and file_path ilike '%parts%' order by file_path, line, id limit 40)),
    v as (select s.id, row_number() over (order by distance, symbol_id) as p from top join symbols s on s.id = symbol_id where kind in ('function', 'class') and contains(file_path, 'parts'))
    select x.id, s.name, round(score, 9) as score from (select coalesce(t.id, v.id) as id, coalesce(1 / (60.0 + t.p), 0) + coalesce(1 / (60.0 + v.p), 0) as score from t full join v on t.id = v.id) x join symbols s on s.id = x.id order by score desc, x.id limit 20""")
_add("x24_linked_globs", lambda c: c.files.select("path", LinkedGlobs().plus(["# sources", "src/src1*/**", "!src/src12/**", "src/src3*/en/**", "!src/src3/**", "d7.txt"]).column(F.col("path")).alias("ignored")), """
    select path, case when regexp_matches(path, '^src/src1[^/]*/') then not starts_with(path, 'src/src12/') else regexp_matches(path, '^src/src3[^/]*/en/') or path like '%/d7.txt' end as ignored from files""")
_add("x31_comments", lambda spark, d: projection.table(spark, d, "part").select("p_partkey", parsers.udf_of(lambda t: parsers.comment(t, "typescript", "  "), "string")(F.concat_ws("\n", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")))).alias("script"), parsers.udf_of(lambda t: parsers.comment(t, "python"), "string")(F.concat_ws("\n", "p_name", "p_brand")).alias("plain")), """
    select p_partkey, if(p_size > 25, '  /**' || chr(10) || '   * ' || p_name || chr(10) || '   * ' || p_brand || chr(10) || '   */', '  /** ' || p_name || ' */') as script, repeat(chr(34), 3) || p_name || chr(10) || p_brand || chr(10) || repeat(chr(34), 3) as plain from part""", raw=True)
_add("x06_receiver_chains", lambda c: c.call_sites.select("id", F.array_join(parsers.udf_of(lambda t: parsers.receiver_chain(t, "go"), "array<string>")(F.concat(F.lit("a(b.c)."), "callee_name", F.lit("?.go(x.y)"))), "|").alias("chain")), "select id, 'a(b.c)|' || callee_name as chain from call_sites")


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of five parts, in chains of four rings."""
    p = projection.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    ring = p.select("p", (F.floor(F.col("p") / 5) * 5 + (F.col("p") + 1) % 5).alias("q"))
    chain = p.filter("p % 5 = 0 and floor(p / 5) % 4 < 3").select("p", (F.col("p") + 5).alias("q"))
    return ring.unionByName(chain).select(F.col("p").cast("string").alias("src"), F.col("q").cast("string").alias("dst"))


_add("g11_layers_of_rings", lambda spark, d: graph.layers(_rings(spark, d), projection.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"))), "select p_partkey::varchar as node, 3 - p_partkey // 5 % 4 as layer from part", raw=True)
