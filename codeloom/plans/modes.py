"""The analytical modes: functions from a catalog and parameters to a DataFrame.

Where the engine this one stands in for has a known defect, the default is what
was meant; `compat=True` gives what it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..catalog import Catalog
from ..functions import scalars
from ..functions.paths import is_test, top_dir
from ..operators import aggregates as agg, calltree
from ..operators import graph, joins, lookup, search
from ..storage import Store



def _top(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first `limit` rows in an order, or all: a top-k keeps room for its whole limit in memory, so no large number stands for "all"."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


# Search -------------------------------------------------------------------


def search_symbols(c: Catalog, query: str, kind=None, language=None, limit: int = 20, file_pattern=None) -> DataFrame:
    return lookup.search_symbols(c, query, kind, file_pattern, language, limit)


def search_files(c: Catalog, query: str = "", language=None, limit: int = 20, file_pattern=None, detailed: bool = False) -> DataFrame:
    """Files by path; `detailed` adds their number of symbols, of exported ones, and names by kind."""
    files = lookup.search_files(c, query, language, limit, file_pattern)
    if not detailed:
        return files
    here = lookup.among(c.symbols, "file_path", files.select("path"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("line", "id", "name"))), lambda x: x["name"])
    kinds = here.groupBy("file_path", "kind").agg(names.alias("names")).groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("kind", "names"))).alias("kinds"))
    counts = here.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported"))
    return files.join(counts, "path", "left").join(kinds, "path", "left").na.fill(0, ["symbols", "exported"]).orderBy("path")


def semantic_search(c: Catalog, query: str, vector=None, kind=None, language=None, limit: int = 20, file_pattern=None) -> DataFrame:
    """Fused text and vector search; text alone without a vector."""
    if vector is None:
        return search_symbols(c, query, kind, language, limit, file_pattern).select(*c.symbols.columns, F.lit(None).cast("double").alias("score"))
    found = search.hybrid(c, query, vector, kind, file_pattern, language, limit)
    return c.symbols.join(F.broadcast(found), "id").select(*c.symbols.columns, "score").orderBy(F.desc("score"), "id")  # at most `limit` rows


def assign_mode(query: str) -> str:
    return "file_compact" if "/" in query or "\\" in query else "semantic" if len(query.split()) > 3 else "symbol"


# Read ---------------------------------------------------------------------


def read_definition(sources: DataFrame, symbol: DataFrame, most: int = 10) -> DataFrame:
    """(id, text): the lines of symbols in (path, content); without an end line, the first `most` and a mark."""
    lines = F.split("content", "\n", -1)
    known = F.col("end_line").isNotNull()
    count = F.when(known, F.col("end_line") - F.col("line") + 1).otherwise(most)
    text = F.array_join(F.slice(lines, F.col("line") + 1, F.greatest(count, F.lit(0))), "\n")
    cut = ~known & (F.size(lines) > F.col("line") + most)
    return symbol.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path").select("id", F.when(cut, F.concat(text, F.lit("\n... (truncated)"))).otherwise(text).alias("text"))


def read_snippet(sources: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Lines start to end, from 1 and with both, as far as the file has them."""
    lines = F.split("content", "\n", -1)
    first = max(start, 1)
    return sources.filter(F.col("path") == path).select("path", F.array_join(F.slice(lines, first, F.greatest(F.least(F.size(lines), F.lit(end)) - first + 1, F.lit(0))), "\n").alias("text"))


def read_summary(c: Catalog, path: str) -> DataFrame:
    """(part, name, kind, line, detail): a file's symbols, its imports, and its importers."""
    none = F.lit(None).cast("int")
    symbols = c.symbols.filter(F.col("file_path") == path).select(F.lit("symbol").alias("part"), "name", "kind", "line", F.col("signature").alias("detail"))
    mine = c.imports.filter(F.col("file_path") == path).select(F.lit("import").alias("part"), F.col("sourceModule").alias("name"), F.col("importKind").alias("kind"), none.alias("line"), F.array_join("importedNames", ", ").alias("detail"))
    theirs = lookup.importers(c, path).select(F.lit("importer").alias("part"), F.col("file_path").alias("name"), F.col("importKind").alias("kind"), none.alias("line"), F.array_join("importedNames", ", ").alias("detail"))
    return symbols.unionByName(mine).unionByName(theirs).orderBy("part", F.asc_nulls_first("line"), "name", "detail")


# Symbols ------------------------------------------------------------------


def references(c: Catalog, name: str, calls: bool = True, imports: bool = True, inheritance: bool = True, compat: bool = False) -> DataFrame:
    """(ref_kind, file_path, name, line): callers, imports and heirs of a name."""
    parts = []
    if calls:
        parts.append(joins.calling(c, c.symbols.filter(F.lower("name") == name.lower())).select(F.lit("call").alias("ref_kind"), F.col("caller_file").alias("file_path"), F.col("caller_name").alias("name"), F.col("caller_line").alias("line")).distinct())
    if imports:
        parts.append(lookup.imports_by_name(c, name, compat=compat).select(F.lit("import").alias("ref_kind"), "file_path", F.col("sourceModule").alias("name"), F.lit(None).cast("int").alias("line")))
        if "/" in name or "." in name:
            parts.append(lookup.importers(c, name).select(F.lit("module").alias("ref_kind"), "file_path", F.col("sourceModule").alias("name"), F.lit(None).cast("int").alias("line")))
    if inheritance:
        parts.append(joins.inheriting(c, name=name).select(F.lit("inherits").alias("ref_kind"), "file_path", "name", "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("ref_kind", "file_path", F.asc_nulls_first("line"), "name")


def importance(c: Catalog, limit: int = 20, kind=None, exclude_tests: bool = True, compat: bool = False) -> DataFrame:
    """Symbols by PageRank over calls. `compat` filters only the first five times `limit`."""
    ranks = graph.pagerank(graph.call_graph(c)).withColumnRenamed("node", "id")
    if compat:
        ranks = ranks.orderBy(F.desc(F.round("rank", 9)), "id").limit(5 * limit)
    out = ranks.join(c.symbols, "id")
    if kind:
        out = lookup.among(out, "kind", kind)
    if exclude_tests:
        out = out.filter(~is_test("file_path"))
    return out.select("id", "name", "kind", "file_path", "line", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)


def resolve_type(c: Catalog, name: str, limit: int | None = 20) -> DataFrame:
    """(role, id): definitions of a type, callables that return or take it, and heirs; each at most `limit`."""
    like = f"%{name}%"
    where = {
        "definition": F.col("kind").isin("type", "interface", "class") & (F.col("name") == name),
        "producer": F.col("return_type").ilike(like),
        "consumer": F.col("parameters_json").ilike(like) | F.col("signature").ilike(like),
    }
    parts = {role: c.symbols.filter(ok) for role, ok in where.items()} | {"inheritor": joins.inheriting(c, name=name)}
    out = None
    for role, df in parts.items():
        part = df.select(F.lit(role).alias("role"), "id", "name", "kind", "file_path", "line")
        part = _top(part, limit, "file_path", "line", "id")
        out = part if out is None else out.unionByName(part)
    return out


def class_hierarchy(c: Catalog, id_: str) -> DataFrame:
    """(relation, id, name, kind, file_path, line) of a symbol's enclosing symbols, bases, members and heirs."""
    here = c.symbols.filter(F.col("id") == id_)
    cols = ["name", "kind", "file_path", "line"]
    up = graph.ancestors(c, id_).select(F.lit("ancestor").alias("relation"), "id", *cols)
    base = here.select(F.explode("inheritence").alias("b")).select(F.lit("base").alias("relation"), F.col("b.inherits_from_id").alias("id"), F.col("b.inherits_from_name").alias("name"), F.col("b.inheritence_type").alias("kind"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line"))
    kids = lookup.children(c, id_).select(F.lit("member").alias("relation"), "id", *cols)
    heirs = joins.inheriting(c, id_=id_).select(F.lit("heir").alias("relation"), "id", *cols)
    return up.unionByName(base).unionByName(kids).unionByName(heirs)


# Call graph ---------------------------------------------------------------


def trace(c: Catalog, ids: list[str], direction: str = "out", depth: int = 3) -> DataFrame:
    """(src, dst, depth, call_line): the calls within `depth` steps of the symbols, each at the step that first meets it."""
    edges = joins._edges_with_sites(c).filter("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "call_line")
    flat = edges if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = c.spark.createDataFrame([(i,) for i in ids], "node string")
    found = graph.reach(flat, seeds, depth - 1)
    end = "src" if direction == "out" else "dst"
    return edges.join(found.select(F.col("node").alias(end), (F.col("depth") + 1).alias("depth")), end).groupBy("src", "dst", "depth").agg(F.min("call_line").alias("call_line")).orderBy("depth", "src", "call_line", "dst")


#: Lines of a call tree that are shown at a time.
PAGE = 1000


def trace_tree(c: Catalog, id_: str, direction: str = "out", depth: int = 3, limit: int = PAGE, offset: int = 0) -> list[tuple[int, str, str]]:
    """(level, id, mark): `limit` lines of `calltree.call_lines`, after `offset` ones; no more reach the driver."""
    page = calltree.call_lines(c, id_, direction, depth).orderBy("path").offset(offset).limit(limit)
    return [(r.level, r.id, r.mark) for r in page.select("level", "id", "mark").collect()]


def blast_radius(c: Catalog, name: str, file_pattern: str | None = None, by_name: bool = False) -> DataFrame:
    """Symbols that call a symbol, or one of its children, directly or not; `by_name` merges all of one name, without case."""
    start = c.symbols.filter(F.lower("name") == name.lower()) if by_name else c.symbols.filter(F.col("name") == name)
    if file_pattern:
        start = start.filter(F.contains("file_path", F.lit(file_pattern)))
    if by_name:
        edges = joins._edges_with_sites(c)
        called = edges.select("caller_id", F.lower("callee_name").alias("src")).unionByName(edges.join(c.symbols.select(F.col("id").alias("callee_id"), F.lower("name").alias("src")), "callee_id").select("caller_id", "src"))
        kids = c.symbols.filter("parent_id is not null").select(F.col("id").alias("child"), F.lower("name").alias("low"), F.col("parent_id").alias("id")).join(c.symbols.select("id", F.lower("name").alias("src")), "id")
        below = edges.join(kids, F.col("callee_id") == F.col("child")).select("caller_id", "src").unionByName(edges.join(kids, F.lower("callee_name") == F.col("low")).select("caller_id", "src"))
        pairs = called.unionByName(below).join(c.symbols.select(F.col("id").alias("caller_id"), F.lower("name").alias("dst")), "caller_id").select("src", "dst")
        found = graph.reach(pairs, start.select(F.lower("name").alias("node")))
        hit = c.symbols.withColumn("node", F.lower("name")).join(found.filter("depth > 0"), "node")
    else:
        hit = c.symbols.join(graph.blast_radius(c, start.select(F.col("id").alias("node"))).filter("depth > 0").withColumnRenamed("node", "id"), "id")
    return hit.filter(F.col("name") != schema.MODULE).select("id", "name", "kind", "file_path", "line", "depth").orderBy("depth", "file_path", "line", "id")


def related_tests(c: Catalog, symbol_or_path: str) -> DataFrame:
    """(path, reasons) of test files that call a symbol, import it, or import a file."""
    if "/" in symbol_or_path:
        found = c.imports.filter(lookup.contains("resolvedPath", symbol_or_path) | lookup.contains("sourceModule", symbol_or_path)).select(F.col("file_path").alias("path"), F.lit("imports file").alias("reason"))
    else:
        called = joins.calling(c, c.symbols.filter(F.lower("name") == symbol_or_path.lower())).select(F.col("caller_file").alias("path"), F.lit("calls symbol").alias("reason"))
        found = called.unionByName(lookup.imports_by_name(c, symbol_or_path).select(F.col("file_path").alias("path"), F.lit("imports symbol").alias("reason")))
    return found.filter(is_test("path")).groupBy("path").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).orderBy("path")


def _flow(c: Catalog, owned: DataFrame, name: str | None) -> DataFrame:
    if name is None:
        return owned.withColumn("scope", F.lit("all"))
    reach = graph.reachable_symbols(c, name).withColumnRenamed("id", "symbol_id")
    return owned.join(reach, "symbol_id", "left_semi").withColumn("scope", F.when(F.lower("symbol_name") == name.lower(), "direct").otherwise("downstream"))


def required_env_vars(c: Catalog, name: str | None = None) -> DataFrame:
    """Environment variables that a symbol, or what it calls, reads; of all symbols without a name."""
    return _flow(c, joins.all_env_vars(c), name)


def error_flow(c: Catalog, name: str | None = None) -> DataFrame:
    """Exceptions that a symbol, or what it calls, raises."""
    return _flow(c, joins.all_exceptions(c), name)


def data_flow(c: Catalog, id_: str, limit: int = 15) -> DataFrame:
    """(role, name, file_path, line): a symbol's parameters and return type, callers and callees."""
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    here = c.symbols.filter(F.col("id") == id_)
    params = here.select(F.explode(scalars.parameters(F.col("parameters_json"))).alias("p")).select(F.lit("parameter").alias("role"), F.col("p.name").alias("name"), F.col("p.type").alias("file_path"), none_i.alias("line"))
    returns = here.filter("return_type is not null").select(F.lit("return").alias("role"), F.col("return_type").alias("name"), none_s.alias("file_path"), none_i.alias("line"))
    callers = joins.calling(c, c.symbols.filter(F.col("id") == id_)).select(F.lit("caller").alias("role"), F.col("caller_name").alias("name"), F.col("caller_file").alias("file_path"), F.col("caller_line").alias("line")).distinct().orderBy("file_path", "line", "name").limit(limit)
    out = joins.outbound(c, [id_]).join(c.symbols.select(F.col("id").alias("callee_id"), F.col("name").alias("s_name"), F.col("file_path").alias("s_file")), "callee_id", "left")
    out = out.join(c.imports.select(F.col("id").alias("imports_id"), F.col("sourceModule").alias("i_module")), "imports_id", "left")
    callees = out.select(F.lit("callee").alias("role"), F.coalesce("s_name", "callee_name").alias("name"), F.coalesce("s_file", "i_module").alias("file_path"), F.col("call_line").alias("line")).orderBy("line", "name", "file_path").limit(limit)
    return params.unionByName(returns).unionByName(callers).unionByName(callees)


# Architecture -------------------------------------------------------------


def dir_dependencies(c: Catalog, depth: int = 1) -> DataFrame:
    """(src, dst): folders whose symbols call into other folders."""
    site = joins._edges_with_sites(c).filter("callee_id is not null").select(top_dir("caller_file_path", depth).alias("src"), F.col("callee_id").alias("id"))
    return site.join(c.symbols.select("id", top_dir("file_path", depth).alias("dst")), "id").filter("src <> dst").select("src", "dst").distinct()


def codebase_map(c: Catalog, depth: int = 1, max_key_symbols: int = 5, file_pattern: str | None = None) -> DataFrame:
    """A row for each folder: its files, layer, targets, and most called public symbols."""
    files = c.files.filter(F.contains("path", F.lit(file_pattern))) if file_pattern else c.files
    store = Store(c.spark, "map")
    dirs = store.keep(files.groupBy(top_dir("path", depth).alias("dir")).agg(F.count("*").alias("files")), "dirs")
    edges = store.keep(dir_dependencies(c, depth), "edges")
    layer = graph.layers(edges, dirs.select(F.col("dir").alias("node")).unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))))
    best = Window.partitionBy("dir").orderBy(F.desc("call_count"), "id")
    keys = joins.key_symbols(c, limit=None).withColumn("dir", top_dir("file_path", depth)).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= max_key_symbols)
    keys = keys.groupBy("dir").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "kind", "call_count"))), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["call_count"].alias("call_count"))).alias("key_symbols"))
    targets = edges.groupBy(F.col("src").alias("dir")).agg(F.array_sort(F.collect_set("dst")).alias("depends_on"))
    return dirs.join(layer.withColumnRenamed("node", "dir"), "dir", "left").join(targets, "dir", "left").join(keys, "dir", "left").orderBy(F.desc("layer"), "dir")


def entry_points(c: Catalog, kind=None, file_pattern: str | None = None, exclude_tests: bool = True, only_unreferenced: bool = False) -> DataFrame:
    out = joins.entrypoint_symbols(c, kind or schema.ENTRY_KINDS)
    if file_pattern:
        out = out.filter(F.contains("file_path", F.lit(file_pattern)))
    if exclude_tests:
        out = out.filter(~is_test("file_path"))
    if only_unreferenced:
        names = c.imports.select(F.explode(scalars.original_names(F.col("importedNames"), types=True)).alias("name"))
        out = out.join(names.distinct(), "name", "left_anti")
    return out.select("id", "name", "kind", "file_path", "line").orderBy("file_path", "line", "id")


def explore(c: Catalog, file_pattern: str | None = None, kind=None, max_nodes: int = 80) -> DataFrame:
    """The symbols that matter most for a picture: by degree, by being an entry point, and by being reachable from one."""
    edges = graph.call_graph(c).distinct()
    entry = joins.entrypoint_symbols(c).select("id")
    seen = graph.reach(edges, entry.withColumnRenamed("id", "node")).select(F.col("node").alias("id"), F.lit(1).alias("reached"))
    out = c.symbols if not kind else lookup.among(c.symbols, "kind", kind)
    if file_pattern:
        out = out.filter(F.contains("file_path", F.lit(file_pattern)))
    out = out.join(agg.degrees(edges).withColumnRenamed("node", "id"), "id").join(seen, "id", "left").join(entry.withColumn("entry", F.lit(1)), "id", "left").na.fill(0, ["reached", "entry"])
    score = (F.col("degree") + 1000 * F.col("entry") + 100 * F.col("reached")).alias("score")
    return out.select("id", "name", "kind", "file_path", "degree", "entry", "reached", score).orderBy(F.desc("score"), "id").limit(max_nodes)


def explore_edges(c: Catalog, nodes: DataFrame, include_unresolved: bool = False) -> DataFrame:
    """(src, dst, kind) between the nodes (id) of a picture; with the names that unresolved calls lead to, if asked."""
    ids = nodes.select("id")
    edges = graph.call_graph(c).distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumn("kind", F.lit("call"))
    if include_unresolved:
        ghosts = joins.edges_with_sites(c, unresolved=True).join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").select(F.col("caller_id").alias("src"), F.col("callee_name").alias("dst"), F.lit("unresolved").alias("kind")).distinct()
        edges = edges.unionByName(ghosts)
    return edges


def coupling_metrics(c: Catalog, sort_by: str = "distance", limit: int = 30, min_symbols: int = 1, file_pattern: str | None = None, compat: bool = False) -> DataFrame:
    column = {"distance": "distance", "instability": "instability", "afferent": "ca", "efferent": "ce"}[sort_by]
    return agg.coupling(c, min_symbols, file_pattern, compat).orderBy(F.desc(column), "file_path").limit(limit)


# Quality ------------------------------------------------------------------


def dead_code(c: Catalog, kind=None, exclude_tests: bool = True, limit: int | None = 50, compat: bool = False) -> DataFrame:
    """Exported symbols that nothing imports or calls, and internal callables that nothing calls.

    `compat` takes imported names as written, with aliases, and counts constructors towards the limit before it drops them.
    """
    c = joins.resolved(c.with_(imports=Store(c.spark, "dead-code").keep(c.imports.select("id", "importedNames"), "imports")))
    names = c.imports.select(F.explode("importedNames" if compat else scalars.original_names(F.col("importedNames"), types=True)).alias("name")).distinct()
    alive = joins.called_ids(c).unionByName(joins.inheritance_covered(c, written=True))
    exports = joins.entrypoint_symbols(c, kind).join(names, "name", "left_anti").withColumn("part", F.lit(0))
    inner = joins.internal_callables(c).withColumn("part", F.lit(1))
    out = exports.select("part", *c.symbols.columns).unionByName(inner.select("part", *c.symbols.columns)).join(alive, "id", "left_anti")
    if exclude_tests:
        out = out.filter(~is_test("file_path"))
    order = ["part", "file_path", "line", "id"]
    made = (F.col("kind") == "method") & F.col("name").isin("constructor", "__init__", "new")
    out = _top(out, limit, *order).filter(~made) if compat else _top(out.filter(~made), limit, *order)
    return out.select("id", "name", "kind", "file_path", "line", F.when(F.col("part") == 0, "exported").otherwise("internal").alias("part"))


def untested(c: Catalog, kind=None, limit: int | None = 50) -> DataFrame:
    return _top(joins.untested_symbols(c, kind).select("id", "name", "kind", "file_path", "line"), limit, "file_path", "line", "id")


def similar_patterns(c: Catalog, symbol, match_on=("kind", "return_type", "decorator", "inheritance", "params"), limit: int = 20) -> DataFrame:
    """Symbols like a given one (a row of symbols) in all the ways asked for that it has."""
    out = c.symbols.filter(F.col("id") != symbol["id"])
    if "kind" in match_on:
        out = out.filter(F.col("kind") == symbol["kind"])
    if "return_type" in match_on and symbol["return_type"]:
        out = out.filter(lookup.contains("return_type", symbol["return_type"]))
    if "decorator" in match_on and symbol["decorator"]:
        out = out.filter(F.col("decorator") == symbol["decorator"])
    if "inheritance" in match_on and symbol["inheritence"]:
        names = F.array(*[F.lit(b["inherits_from_name"]) for b in symbol["inheritence"]])
        out = out.filter(F.arrays_overlap(F.transform("inheritence", lambda x: x["inherits_from_name"]), names))
    if "params" in match_on and symbol["parameters_json"]:
        here = F.size(scalars.parameters(F.lit(symbol["parameters_json"])))
        out = out.filter(F.size(scalars.parameters(F.col("parameters_json"))) == here)
    return out.select("id", "name", "kind", "file_path", "line").orderBy("file_path", "line", "id").limit(limit)


def hotspots(c: Catalog, history: DataFrame, limit: int = 20, file: str | None = None) -> DataFrame:
    out = agg.hotspot_scores(c, history)
    return out.filter(F.col("path") == file) if file else out.orderBy(F.desc("score"), "path").limit(limit)


# Imports and index --------------------------------------------------------


def dependency_cycles(c: Catalog, max_cycles: int = 20) -> DataFrame:
    """(size, members) of groups of indexed files that import each other in circles; imports of files that are not indexed do not count."""
    return cycles(agg.import_edges(c), max_cycles)


def cycles(edges: DataFrame, max_cycles: int = 20) -> DataFrame:
    found = graph.cyclic_components(edges).groupBy("scc").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return found.select(F.size("members").alias("size"), F.array_join("members", " ").alias("members")).orderBy(F.desc("size"), "members").limit(max_cycles)


def stale_references(c: Catalog, documents: DataFrame) -> DataFrame:
    """(path, kind, ref): paths and symbols that texts (path, content) name and the index does not have."""
    paths = documents.select("path", F.explode(scalars.path_refs(F.col("content"))).alias("ref"))
    known = c.files.select(F.col("path").alias("ref"))
    symbols = documents.select("path", F.explode(scalars.symbol_refs(F.col("content"))).alias("ref"))
    names = c.symbols.select(F.col("name").alias("ref")).distinct()
    gone = paths.join(known, "ref", "left_anti").select("path", F.lit("path").alias("kind"), "ref")
    return gone.unionByName(symbols.join(names, "ref", "left_anti").select("path", F.lit("symbol").alias("kind"), "ref")).distinct()


def token_savings(c: Catalog) -> DataFrame:
    """Usage by tool, with a total row (tool_name null) and its approximate cost."""
    total = agg.usage_totals(c).select(F.lit(None).cast("string").alias("tool_name"), "calls", "tokens_saved", "source_tokens", "response_tokens")
    return total.unionByName(agg.usage_by_tool(c)).withColumn("cost", scalars.approximate_cost(F.col("tokens_saved"))).orderBy(F.asc_nulls_first("tool_name"))


def index_health(c: Catalog) -> DataFrame:
    return agg.health_counts(c)
