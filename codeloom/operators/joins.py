"""Joins between calls, symbols, imports and files.

Conditions of the form "by id or by name" are written as unions of equi
joins, which Spark can hash or sort; as one condition they would be nested loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from ..functions.paths import is_test
from ..storage import Store, counted
from .lookup import among

#: Rows of a result of pairs that a task makes: some TILE_ROWS, or more where there would be over TASKS tasks; children that it holds for a name: some PART, in arrays of some BLOCK.
TILE_ROWS, TASKS, PART, BLOCK = 1 << 21, 2048, 1 << 16, 256


def _edges_with_sites(c: Catalog) -> DataFrame:
    sites = c.call_sites.select(F.col("id").alias("call_site_id"), "caller_file_path", "call_text", "callee_name", "callee_expression", "call_kind", "call_line", "call_column")
    return c.call_edges.join(sites, "call_site_id")


def outbound(c: Catalog, ids) -> DataFrame:
    """Calls made by the symbols, with their sites, in source order."""
    out = among(_edges_with_sites(c), "caller_id", ids).withColumn("is_lang_feature", F.col("target_kind") == "builtin")
    return out.orderBy("caller_file_path", "call_line", "id")


def edges_with_sites(c: Catalog, unresolved: bool = False) -> DataFrame:
    """Edges with their sites; `unresolved` takes those that lead to neither a symbol nor an import."""
    open_ = F.col("callee_id").isNull() & F.col("imports_id").isNull()
    return _edges_with_sites(c).filter(open_ if unresolved else ~open_)


def _caller(c: Catalog) -> DataFrame:
    return c.symbols.select(F.col("id").alias("caller_id"), F.col("file_path").alias("caller_file"), F.col("name").alias("caller_name"), F.col("line").alias("caller_line"))


def callers(c: Catalog, name: str) -> DataFrame:
    """Distinct callers of a name: by the resolved callee's name, or by the name at the site if any symbol has it."""
    edges = _edges_with_sites(c).select("caller_id", "callee_id", "callee_name")
    named = c.symbols.filter(F.col("name") == name).select("id")
    by_id = edges.join(named.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi").select("caller_id")
    known = c.symbols.filter(F.col("name") == name).select(F.col("name").alias("callee_name"))
    by_name = edges.filter(F.col("callee_name") == name).join(known, "callee_name", "left_semi").select("caller_id")
    return by_id.unionByName(by_name).join(_caller(c), "caller_id").distinct().select("caller_file", "caller_name", "caller_line", "caller_id")


def named_calls(c: Catalog, met: DataFrame | None = None) -> DataFrame:
    """(caller_id, callee_id, called): what distinguishes calls when callers are looked for, the name at the site in lower case; each once.

    With symbols `met` (t, called), only calls of one of them by id or by name: edges and sites of others are dropped before edges meet sites.
    """
    edges = c.call_edges.select("call_site_id", "caller_id", "callee_id")
    sites = c.call_sites.select(F.col("id").alias("call_site_id"), F.lower("callee_name").alias("called"))
    if met is None:
        return edges.join(sites, "call_site_id").select("caller_id", "callee_id", "called").distinct()
    store = Store(c.spark, "named-calls")
    ids, names = met.select(F.col("t").alias("callee_id")).distinct(), met.select("called").distinct()
    by_id = store.keep(edges.join(counted(ids), "callee_id", "left_semi"), "by_id")
    by_name = store.keep(sites.join(counted(names), "called", "left_semi"), "by_name")
    calls = sites.join(counted(by_id), "call_site_id").select("caller_id", "callee_id", "called")
    return calls.unionByName(edges.join(counted(by_name), "call_site_id").select("caller_id", "callee_id", "called")).distinct()


def _children(c: Catalog, t: DataFrame) -> DataFrame:
    """Members of the symbols (t), with their name in lower case as `called`."""
    kids = c.symbols.select(F.col("id").alias("child"), F.col("name").alias("child_name"), F.col("file_path").alias("child_file"), F.col("line").alias("child_line"), F.col("parent_id").alias("t"), F.lower("name").alias("called"))
    return kids.join(t.distinct(), "t").distinct()


def _paired(pairs: DataFrame, caller: DataFrame, kids: DataFrame) -> DataFrame:
    """Each caller of a name with each child of that name, from distinct `pairs` (caller_id, called) and distinct `kids`.

    Names are few and their pairs many, so work is dealt out by the rows to come, which counts tell:
    callers of a name fall into slices, its children into parts, and each slice meets each part in one task.
    """
    each = pairs.groupBy("called").agg(F.count("*").alias("n")).join(kids.groupBy("called").agg(F.count("*").alias("n_kids")), "called")
    each = each.withColumn("n_rows", F.col("n") * F.col("n_kids"))
    total = each.agg(F.sum("n_rows")).first()[0] or 0
    made = pairs.join(caller, "caller_id")
    if total <= TILE_ROWS:
        return made.join(kids, "called")
    parts, blocks = F.ceil(F.col("n_kids") / PART), F.ceil(F.col("n_kids") / BLOCK)
    slices = F.ceil(F.col("n_rows") / parts / max(TILE_ROWS, total // TASKS))
    each = Store(pairs.sparkSession, "paired").keep(each.select("called", slices.alias("slices"), parts.alias("parts"), blocks.alias("blocks")), "tiles")
    child = [x for x in kids.columns if x != "called"]
    some = kids.join(counted(each), "called").groupBy("called", "slices", "parts", F.pmod(F.xxhash64(*child), "blocks").alias("block")).agg(F.collect_list(F.struct(*child)).alias("some"))
    some = some.select("called", "some", F.pmod("block", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    made = made.join(counted(each), "called").select("called", *caller.columns, F.pmod(F.xxhash64("caller_id"), "slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tasks, at = min(TASKS, total // TILE_ROWS + 1), ["called", "slice", "part"]
    return made.repartition(tasks, *at).join(some.repartition(tasks, *at).hint("merge"), at).select(*caller.columns, F.inline("some"))


def nested_callers(c: Catalog, targets: DataFrame, keep_module: bool = False, with_ids: bool = False) -> DataFrame:
    """Callers of the target symbols (id, name) or of their children, with the child called if it is one.

    A call that reaches a target and one of its children alike counts as the child's.
    Names compare without case. `with_ids` adds the target `t` and the `child`, for targets that are looked at together.

    Many symbols share few names, so callers of a name are never paired with
    what bears it, unless the pairs are the result: its rows come from distinct
    callers of a name and distinct children, by `_paired`, and are not shuffled again.
    """
    store = Store(c.spark, "callers")
    target = store.keep(targets.select(F.col("id").alias("t"), F.lower("name").alias("t_name")).distinct(), "targets")
    kids = store.keep(_children(c, target.select("t")), "children")
    met = target.withColumnRenamed("t_name", "called").unionByName(kids.select(F.col("child").alias("t"), "called"))
    calls = store.keep(named_calls(c, met), "calls")
    ids = ["t", "child"] if with_ids else []
    child = ["child_name", "child_file", "child_line", *ids]

    # Calls of children by id that no call of the caller makes by name.
    pairs = counted(store.keep(calls.select("caller_id", "called").distinct(), "pairs"))
    held = calls.withColumnRenamed("called", "_called").join(kids, F.col("callee_id") == F.col("child")).filter(~F.coalesce(F.col("_called") == F.col("called"), F.lit(False)))
    held = held.join(pairs, ["caller_id", "called"], "left_anti").select("caller_id", *child)

    # Calls of a target that reach none of its children.
    own = kids.select("t", F.col("called").alias("t_name")).distinct()
    free = target.join(own, ["t", "t_name"], "left_anti").withColumnRenamed("t_name", "called")
    inside = kids.select("t", F.col("child").alias("callee_id")).distinct()
    by_id = calls.join(target.select(F.col("t").alias("callee_id"), "t").distinct(), "callee_id").join(own.withColumnRenamed("t_name", "called"), ["t", "called"], "left_anti").join(inside, ["t", "callee_id"], "left_anti")
    if with_ids:
        by_name = calls.join(free, "called").join(inside, ["t", "callee_id"], "left_anti")
    else:
        # Some target of the name is reached unless the callee is a child of every one.
        covered = inside.join(free, "t").groupBy("called", "callee_id").agg(F.count("*").alias("covered"))
        by_name = calls.join(free.groupBy("called").agg(F.count("*").alias("n")), "called").join(covered, ["called", "callee_id"], "left").filter(F.col("n") > F.coalesce("covered", F.lit(0)))
    none = {"child_name": F.lit(None).cast("string"), "child_file": F.lit(None).cast("string"), "child_line": F.lit(None).cast("int"), "child": F.lit(None).cast("string")}
    plain = by_id.select("caller_id", *ids[:1]).unionByName(by_name.select("caller_id", *ids[:1])).withColumns(none).select("caller_id", *child)
    caller = _caller(c).distinct()
    caller = caller if keep_module else caller.filter(F.col("caller_name") != schema.MODULE)
    few = held.unionByName(plain).distinct().join(caller, "caller_id")
    shown = ["caller_file", "caller_name", "caller_line", "caller_id", *child]
    if kids.isEmpty():
        return few.select(*shown)
    many = _paired(pairs, caller, kids.select("called", *child).distinct())
    return few.select(*shown).unionByName(many.select(*shown))


def calling(c: Catalog, targets: DataFrame, keep_module: bool = False) -> DataFrame:
    """(caller_file, caller_name, caller_line, caller_id) of `nested_callers`, each once, whatever child they call."""
    store = Store(c.spark, "calling")
    target = store.keep(targets.select(F.col("id").alias("t"), F.lower("name").alias("called")).distinct(), "targets")
    met = store.keep(_children(c, target.select("t")).select(F.col("child").alias("t"), "called").unionByName(target), "met")
    calls = store.keep(named_calls(c, met), "calls")
    by_name = calls.join(met.select("called").distinct(), "called", "left_semi").select("caller_id")
    by_id = calls.join(met.select(F.col("t").alias("callee_id")).distinct(), "callee_id", "left_semi").select("caller_id")
    found = by_name.unionByName(by_id).distinct().join(_caller(c).distinct(), "caller_id").select("caller_file", "caller_name", "caller_line", "caller_id")
    return found if keep_module else found.filter(F.col("caller_name") != schema.MODULE)


def callers_nested(c: Catalog, name: str) -> DataFrame:
    return nested_callers(c, c.symbols.filter(F.lower("name") == name.lower()))


def callers_nested_by_id(c: Catalog, id_: str) -> DataFrame:
    return nested_callers(c, c.symbols.filter(F.col("id") == id_))


def dependency_files(c: Catalog, paths) -> DataFrame:
    """Files outside of `paths` that calls from inside lead to."""
    inside = among(_edges_with_sites(c), "caller_file_path", paths).select("callee_id")
    found = c.symbols.join(inside.withColumnRenamed("callee_id", "id"), "id", "left_semi").select("file_path")
    if isinstance(paths, DataFrame):
        outside = found.join(paths.select(F.col(paths.columns[0]).alias("file_path")), "file_path", "left_anti")
    else:
        outside = found.filter(~F.col("file_path").isin(list(paths)))
    return outside.distinct()


def exported_parents(c: Catalog) -> DataFrame:
    return c.symbols.filter("exported").select(F.col("id").alias("parent_id"))


def public_symbols(c: Catalog) -> DataFrame:
    """Exported symbols, and children of exported ones."""
    return c.symbols.filter("exported").unionByName(c.symbols.filter("not exported").join(exported_parents(c), "parent_id", "left_semi").select(*c.symbols.columns))


def key_symbols(c: Catalog, paths=None, limit: int | None = 30) -> DataFrame:
    """Public symbols with their number of resolved inbound calls, most called first."""
    public = public_symbols(c) if paths is None else among(public_symbols(c), "file_path", paths)
    calls = c.call_edges.filter(F.col("callee_id").isNotNull()).groupBy(F.col("callee_id").alias("id")).agg(F.count("*").alias("call_count"))
    out = public.select("id", "name", "kind", "file_path", "line").join(calls, "id", "left").withColumn("call_count", F.coalesce("call_count", F.lit(0)))
    return out if limit is None else out.orderBy(F.desc("call_count"), "id").limit(limit)


def entrypoint_symbols(c: Catalog, kinds=None) -> DataFrame:
    """Exported symbols directly below a module."""
    modules = c.symbols.filter(F.col("name") == schema.MODULE).select(F.col("id").alias("parent_id"))
    out = c.symbols.filter("exported").join(modules, "parent_id", "left_semi").select(*c.symbols.columns)
    return among(out, "kind", kinds) if kinds else out


def internal_callables(c: Catalog) -> DataFrame:
    """Callables that are not exported and whose parent is not."""
    return among(c.symbols.filter("not exported"), "kind", schema.CALLABLE_KINDS).join(exported_parents(c), "parent_id", "left_anti").select(*c.symbols.columns)


def inheriting(c: Catalog, id_: str | None = None, name: str | None = None) -> DataFrame:
    """Symbols with a base of the id and the name, as far as they are given."""

    def base(x):
        ok = F.lit(True)
        if id_ is not None:
            ok = ok & (x["inherits_from_id"] == id_)
        if name is not None:
            ok = ok & (x["inherits_from_name"] == name)
        return F.coalesce(ok, F.lit(False))

    if id_ is None and name is None:
        return c.symbols.limit(0)
    return c.symbols.filter(F.exists("inheritence", base))


def needing_embeddings(c: Catalog, paths=None) -> DataFrame:
    out = c.symbols.join(c.vec_symbols.select(F.col("symbol_id").alias("id")), "id", "left_anti").select(*c.symbols.columns)
    return among(out, "file_path", paths) if paths is not None else out


def _owned(c: Catalog, table: DataFrame, value: str) -> DataFrame:
    owner = c.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
    out = table.select(F.col("id"), "symbol_id", "file_path", value, "line", "column").join(owner, "symbol_id", "left")
    return out.withColumn("symbol_name", F.coalesce("symbol_name", F.lit("Unknown")))


def all_exceptions(c: Catalog) -> DataFrame:
    return _owned(c, c.exceptions, "exception_type")


def all_env_vars(c: Catalog) -> DataFrame:
    return _owned(c, c.env_vars, "name")


def pending_sites(c: Catalog) -> DataFrame:
    """Call sites without an edge, or with one that a later pass may resolve."""
    edges = c.call_edges.select(F.col("call_site_id").alias("id"), "resolution_source", "callee_id", F.lit(True).alias("has_edge"))
    joined = c.call_sites.join(edges, "id", "left")
    open_ = F.col("has_edge").isNull() | (F.col("resolution_source") == "unresolved") | ((F.col("resolution_source") == "source_import") & F.col("callee_id").isNull())
    return joined.filter(open_).select(*c.call_sites.columns).distinct()


def implementations_at(c: Catalog, places: DataFrame) -> DataFrame:
    """Symbols at the (file_path, line) pairs of `places`."""
    return c.symbols.join(places.select("file_path", "line").distinct(), ["file_path", "line"], "left_semi").select(*c.symbols.columns)


def resolved(c: Catalog) -> Catalog:
    """The catalog with the ends of its resolved calls written, for what looks at them several times."""
    ends = c.call_edges.filter("callee_id is not null or imports_id is not null").select("call_site_id", "callee_id", "imports_id")
    return c.with_(call_edges=Store(c.spark, "resolved").keep(ends, "edges"))


def via_imports(c: Catalog, types: DataFrame | None = None) -> DataFrame:
    """(type_name, callee_name): names that an import brings in, with what is called through it, where no symbol was found; only those of `types` (type_name), if given.

    The calls through imports of these are then written and counted, so that all other sites are not shuffled to meet them.
    """
    names = c.imports.select(F.col("id").alias("imports_id"), F.explode("importedNames").alias("type_name"))
    if types is None:
        edges = _edges_with_sites(c).filter("callee_id is null and imports_id is not null").select("imports_id", "callee_name")
        return edges.join(names, "imports_id").select("type_name", "callee_name").distinct()
    store = Store(c.spark, "via-imports")
    names = counted(store.keep(names.join(types, "type_name", "left_semi"), "names"))
    calls = c.call_edges.filter("callee_id is null and imports_id is not null").join(names, "imports_id").select("call_site_id", "type_name")
    sites = c.call_sites.select(F.col("id").alias("call_site_id"), "callee_name")
    return sites.join(counted(store.keep(calls, "calls")), "call_site_id").select("type_name", "callee_name").distinct()


def called_ids(c: Catalog) -> DataFrame:
    return c.call_edges.filter("callee_id is not null").select(F.col("callee_id").alias("id")).distinct()


def inheritance_covered(c: Catalog, written: bool = False) -> DataFrame:
    """Ids of members that a call through a base reaches: the base's name and the member's were called together.

    Only the first listed base of a type that has any called method counts. `written` says that the catalog is one of `resolved`.
    """
    c, store = c if written else resolved(c), Store(c.spark, "covered")
    bases = c.symbols.filter("inheritence is not null").select(F.col("id").alias("parent_id"), F.posexplode("inheritence").alias("at", "base")).select("parent_id", "at", F.col("base.inherits_from_name").alias("type_name"))
    wanted = counted(store.keep(bases.select("type_name").filter("type_name is not null").distinct(), "bases"))
    called = c.symbols.join(called_ids(c), "id", "left_semi").filter("parent_id is not null").select("parent_id", F.col("name").alias("callee_name"))
    parents = c.symbols.select(F.col("id").alias("parent_id"), F.col("name").alias("type_name")).join(wanted, "type_name", "left_semi")
    own = called.join(parents, "parent_id").select("type_name", "callee_name")
    through = store.keep(own.unionByName(via_imports(c, wanted)), "through")
    usable = bases.join(through.select("type_name").distinct(), "type_name", "left_semi")
    first = usable.groupBy("parent_id").agg(F.min_by("type_name", "at").alias("type_name"))
    members = c.symbols.filter("parent_id is not null").select("id", "parent_id", F.col("name").alias("callee_name"))
    return members.join(first, "parent_id").join(counted(through), ["type_name", "callee_name"], "left_semi").select("id").distinct()


def test_covered_files(c: Catalog) -> DataFrame:
    """Files that are tests, or that a test imports."""
    tests = c.files.filter(is_test("path")).select("path")
    return tests.unionByName(among(c.imports, "file_path", tests).filter("resolvedPath is not null").select(F.col("resolvedPath").alias("path"))).distinct()


def untested_symbols(c: Catalog, kinds=None) -> DataFrame:
    """Exported top-level symbols in indexed files that are neither tests nor imported by one."""
    free = c.files.select("path").join(test_covered_files(c), "path", "left_anti")
    return among(entrypoint_symbols(c, kinds or (*schema.CALLABLE_KINDS, "class")), "file_path", free)
