"""Modes on hand-made catalogs."""

from graphs import calls, catalog

from codeloom.operators import aggregates, changes, joins, lookup, resolve, search
from codeloom.plans import modes


def ids(df):
    return [r.id for r in df.collect()]


def test_dead_code(spark):
    symbols = [
        {"id": "m", "name": "<module>", "kind": "module"},
        {"id": "A", "name": "A", "exported": True, "parent_id": "m"}, {"id": "B", "name": "B", "exported": True, "parent_id": "m"}, {"id": "C", "name": "C", "exported": True, "parent_id": "m"},
        {"id": "d", "name": "d", "parent_id": "m"}, {"id": "e", "name": "e", "parent_id": "m"}, {"id": "z", "name": "constructor", "kind": "method", "parent_id": "m"}, {"id": "al", "name": "al", "exported": True, "parent_id": "m"},
    ]
    c = calls(spark, [("A", "B"), ("A", "d")], symbols).with_(imports=catalog(spark, imports=[{"id": "i", "importedNames": ["A", "type al as other"]}]).imports)
    assert ids(modes.dead_code(c)) == ["C", "e"]
    assert ids(modes.dead_code(c, compat=True)) == ["C", "al", "e"]


def test_nested_callers_prefer_the_child(spark):
    symbols = [{"id": "T", "name": "T", "kind": "class"}, {"id": "m", "name": "m", "kind": "method", "parent_id": "T"}, {"id": "x", "name": "x"}, {"id": "y", "name": "y"}]
    c = catalog(spark, symbols=symbols, call_sites=[{"id": "s", "caller_id": "x", "callee_name": "T"}, {"id": "t", "caller_id": "y", "callee_name": "t"}], call_edges=[{"id": "e", "call_site_id": "s", "caller_id": "x", "callee_id": "m"}, {"id": "f", "call_site_id": "t", "caller_id": "y"}])
    assert {(r.caller_id, r.child_name) for r in joins.callers_nested(c, "t").collect()} == {("x", "m"), ("y", None)}


def test_coupling(spark):
    symbols = [{"id": f"{f}{i}", "file_path": f, "kind": k} for f, ks in (("f1", ["function"]), ("f2", ["function"]), ("f3", ["interface", "function"])) for i, k in enumerate(ks)]
    imports = [{"id": f"{a}{b}", "file_path": a, "resolvedPath": b} for a, b in (("f1", "f2"), ("f1", "f3"), ("f2", "f3"), ("f3", "f3"))]
    got = {r.file_path: (r.ce, r.ca, r.instability, r.abstractness, r.distance) for r in aggregates.coupling(catalog(spark, symbols=symbols, imports=imports)).collect()}
    assert got == {"f1": (2, 0, 1, 0, 0), "f2": (1, 1, 0.5, 0, 0.5), "f3": (0, 2, 0, 0.5, 0.5)}


def test_rank_fusion(spark):
    frame = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "id string, position int")
    got = {r.id: round(r.score, 9) for r in search.fuse(frame("xy"), frame("xz")).collect()}
    assert got == {"x": 0.032786885, "y": 0.016129032, "z": 0.016129032}
    assert got == {r.id: round(r.score, 9) for r in search.fuse(frame("xz"), frame("xy")).collect()}


def test_cascade_gives_one_edge_for_each_site(spark):
    symbols = [
        {"id": "m", "name": "<module>", "kind": "module"}, {"id": "f", "name": "f"}, {"id": "f2", "name": "f", "line": 9}, {"id": "far", "name": "g", "file_path": "b.ts"}, {"id": "deep", "name": "h", "file_path": "c.ts"},
        {"id": "K", "name": "K", "kind": "class"}, {"id": "k1", "name": "one", "kind": "method", "parent_id": "K"}, {"id": "k2", "name": "two", "kind": "method", "parent_id": "K"}, {"id": "kp", "name": "box", "kind": "property", "parent_id": "K"},
        {"id": "v", "name": "obj", "kind": "const", "parent_id": "f"},
    ]
    imports = [
        {"id": "i1", "file_path": "a.ts", "importedNames": ["f", "g as g2", "g", "h"], "resolvedPath": "b.ts", "resolvedKind": "source", "importKind": "named", "edgeKind": "import"},
        {"id": "i2", "file_path": "b.ts", "importedNames": ["h"], "resolvedPath": "c.ts", "resolvedKind": "source", "importKind": "named", "edgeKind": "re-export"},
        {"id": "i3", "file_path": "a.ts", "importedNames": ["lib"], "resolvedKind": "package", "importKind": "default", "edgeKind": "import"},
        {"id": "i4", "file_path": "a.ts", "importedNames": ["only"], "resolvedPath": "b.ts", "resolvedKind": "source", "importKind": "type-only", "edgeKind": "import"},
    ]
    method = lambda id_, name, base, caller="f": {"id": id_, "caller_id": caller, "callee_name": name, "callee_base": base, "call_kind": "method_call"}
    sites = [
        {"id": "1", "caller_id": "m", "callee_name": "f"}, {"id": "2", "caller_id": "m", "callee_name": "g"}, {"id": "3", "caller_id": "m", "callee_name": "h"}, method("4", "get", "lib"), {"id": "5", "caller_id": "m", "callee_name": "only"},
        {"id": "6", "caller_id": "m", "callee_name": "parseInt"}, method("7", "log", "console"), {"id": "8", "caller_id": "m", "callee_name": "x", "call_kind": "dynamic_call"}, method("9", "two", "this", "k1"), method("10", "push", "this.box", "k1"),
        method("11", "run", "obj"), method("12", "run", "obj", "K"), {"id": "13", "caller_id": "m", "callee_name": "K", "call_kind": "constructor_call"},
    ]
    c = catalog(spark, symbols=symbols, imports=imports, call_sites=sites)
    got = {r.call_site_id: (r.resolution_source, r.target_kind, r.callee_id, r.imports_id, r.confidence) for r in resolve.resolve_calls(c).collect()}
    assert got == {
        "1": ("same_file", "project_symbol", "f", None, 80), "2": ("source_import", "project_symbol", "far", "i1", 90), "3": ("source_import", "project_symbol", "deep", "i1", 90), "4": ("external_import", "import", None, "i3", 70),
        "5": ("unresolved", "unresolved", None, None, 0), "6": ("builtin_list", "builtin", None, None, 80), "7": ("builtin_list", "builtin", None, None, 80), "8": ("dynamic_pattern", "dynamic", None, None, 100), "9": ("same_class", "project_symbol", "k2", None, 75),
        "10": ("same_class_property", "project_symbol", "kp", None, 72), "11": ("same_file", "project_symbol", "v", None, 80), "12": ("unresolved", "unresolved", None, None, 0), "13": ("same_file", "project_symbol", "K", None, 80),
    }


def test_changes(spark):
    c = calls(spark, [("a", "b"), ("b", "c")]).with_(vec_symbols=spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "symbol_id string, embedding array<float>"))
    new = c.symbols.filter("id <> 'c'")
    after = changes.upsert_symbols(c, new, spark.createDataFrame([("a.ts",)], "path string"))
    assert sorted(ids(after.symbols)) == ["a", "b"] and [r.symbol_id for r in after.vec_symbols.collect()] == ["a"]
    assert {(r.id, r.callee_id) for r in after.call_edges.collect()} == {("e0", "b"), ("e1", None)}
    gone = changes.delete_files(c, spark.createDataFrame([("a.ts",)], "path string"))
    assert gone.symbols.count() == gone.call_edges.count() == gone.vec_symbols.count() == 0
    row = changes.usage_row(c.with_(files=spark.createDataFrame([("p", "h", 1, "ts", 3)], "path string, hash string, indexed_at long, language string, estimated_tokens long")), "t", ["p"], 17, 5).first()
    assert (row.source_tokens, row.response_tokens, row.tokens_saved) == (3, 5, 0)


def test_lookups(spark):
    c = catalog(spark, symbols=[{"id": str(i), "name": n} for i, n in enumerate(["Alpha", "alphabet", "beta"])], imports=[{"id": "1", "sourceModule": "./lib/add", "importedNames": ["add"]}, {"id": "2", "sourceModule": "./lib/address", "importedNames": ["address"]}])
    assert ids(lookup.search_symbols(c, "alpha")) == ["0"] and ids(lookup.search_symbols(c, "ALPHA**")) == ["0", "1"]
    assert ids(lookup.imports_by_name(c, "add")) == ["1"] and sorted(ids(lookup.imports_by_name(c, "add", compat=True))) == ["1", "2"]
    assert ids(lookup.importers(c, "lib/address.ts")) == ["2"] and lookup.importers(c, ".hidden").count() == 0
    assert lookup.among(c.symbols, "id", [str(i) for i in range(500)]).count() == 3
