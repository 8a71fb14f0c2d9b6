"""Signatures, hovers and implementation hits on hand-written cases."""

import pytest
from graphs import catalog
from pyspark.sql import functions as F

from codeloom.operators import enhance, resolve


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", make(F.col("v")).alias("out"))
    return [r.out for r in sorted(df.collect(), key=lambda r: r.k)]


def test_split_outside(spark):
    texts = ["a, b", "f(x, y), [1, 2], {a: 1, b: 2}", "Map<A, B>, (x: C) => D, E", "", "a)b, c", None]
    want = [["a", " b"], ["f(x, y)", " [1, 2]", " {a: 1, b: 2}"], ["Map<A, B>", " (x: C) => D", " E"], [""], ["a)b", " c"], None]
    assert column(spark, texts, enhance.split_outside) == want


@pytest.mark.parametrize("kind,signature,want", [
    ("class", "class A<T extends B> extends C.D<E, F> implements G, H<I> {", [("C.D", "extends"), ("G", "implements"), ("H", "implements")]),
    ("class", "export class A", []),
    ("class", "class A<T extends B> {", []),
    ("interface", "interface A extends B,\n  C<D>", [("B", "extends"), ("C", "extends")]),
    ("type", "type A = B & { x: C & D } & E", [("B", "intersection"), ("E", "intersection")]),
    ("type", "type A = B | C<D | E> | 'f'", [("B", "union"), ("C", "union")]),
    ("type", "type A = Readonly<B>", [("B", "extends")]),
    ("type", "type A = string", []),
])
def test_bases(spark, kind, signature, want):
    got = column(spark, [signature], lambda v: enhance.bases(F.lit(kind), v))[0]
    assert [(b.name, b.type) for b in got] == want


def test_hover_parts(spark):
    texts = ["(method) A.f(a: B, c: D): E", "```python\n(function) def f(x: int) -> str\n```\ntext: more", "const x: Foo", "nothing", None, "(alias) g(): \n"]
    got = column(spark, texts, enhance.hover_parts)
    assert [(g.name, g.type) if g else None for g in got] == [("a: B, c: D", "E"), ("x: int", "str"), ("const x", "Foo"), None, None, ("", "")]


def test_enhancement(spark):
    symbols = [{"id": i, "name": i, "kind": k, "file_path": "a.ts", "line": n, "column": 0, "signature": s} for n, (i, k, s) in enumerate([("A", "class", "class A extends B, Gone"), ("B", "interface", None), ("C", "class", "class C extends Gone"), ("f", "function", None)])]
    c = catalog(spark, symbols=symbols)
    bases = {r.id: [b.inherits_from_name for b in r.inheritence or []] for r in enhance.enhance_bases(c).symbols.collect()}
    assert bases == {"A": ["B", "Gone"], "B": [], "C": [], "f": []}
    hits = spark.createDataFrame([("B", "a.ts", 2), ("B", "a.ts", 1), ("B", "b.ts", 2)], "interface_id string, file_path string, line int")
    faces = {r.id: [(b.inherits_from_name, b.inherits_from_id, b.inheritence_type) for b in r.inheritence or []] for r in enhance.enhance_implementations(c, hits).symbols.collect()}
    assert faces == {"A": [], "B": [], "C": [("B", "B", "implements")], "f": []}
    hovers = spark.createDataFrame([("f", "f(a: X<Y, Z>, b): W"), ("A", "A(): Q")], "id string, text string")
    made = {r.id: (r.parameters_json, r.return_type) for r in enhance.enhance_callables(c, hovers).symbols.collect()}
    assert made["f"] == ('[{"name":"a","type":"X<Y, Z>"},{"name":"b","type":"any"}]', "W") and made["A"] == (None, None)


def test_definitions_and_hovers_are_optional(spark):
    symbols = [{"id": "f", "name": "f", "kind": "function", "file_path": "b.ts", "line": 3, "column": 2}]
    sites = [{"id": f"s{n}", "caller_id": "x", "caller_file_path": "a.ts", "language_name": "typescript", "callee_expression": e, "callee_name": e.split(".")[-1], "call_kind": "method_call"} for n, e in enumerate(("q.f", "q.g", "Box.h", "w.k", "v.z"))]
    imports = [{"id": "i", "file_path": "a.ts", "importedNames": ["Box"], "resolvedPath": "lib/box.ts", "edgeKind": "import"}]
    c = catalog(spark, symbols=symbols, call_sites=sites, imports=imports)
    where = spark.createDataFrame([("s0", "b.ts", 3, 2), ("s1", "node/x.d.ts", 1, 1), ("s2", "far/y.ts", 0, 0)], "call_site_id string, path string, line int, column int")
    hovers = spark.createDataFrame([("s3", 0, "const w: Box"), ("s4", 0, "const v: Other"), ("s0", 0, "x: Box")], "call_site_id string, n int, text string")
    shown = lambda df: {r.call_site_id: (r.target_kind, r.callee_id, r.imports_id, r.resolution_source) for r in df.collect()}
    only = (resolve.unresolved,)
    none = ("unresolved", None, None, "unresolved")
    assert set(shown(resolve.resolve_calls(c, stages=only)).values()) == {none}
    assert shown(resolve.resolve_calls(c, stages=only, definitions=where, hovers=hovers, builtin_paths=("node/",))) == {
        "s0": ("project_symbol", "f", None, "lsp_definition"), "s1": ("builtin", None, None, "lsp_definition"), "s2": ("import", None, "i", "lsp_definition"), "s3": ("import", None, "i", "lsp_hover"), "s4": none,
    }


def test_a_hover_text_is_read_once_however_many_sites_show_it(spark):
    names = ["Box", "Far"]
    sites = [{"id": f"s{i}", "caller_id": "f", "callee_name": "go"} for i in range(400)]
    imports = [{"id": "i", "file_path": "a.ts", "importedNames": ["Box"], "resolvedPath": "b.ts"}]
    c = catalog(spark, call_sites=sites, imports=imports, symbols=[{"id": "f", "name": "f"}])
    hovers = spark.createDataFrame([(f"s{i}", 0, f"const v: {names[i % 2]}") for i in range(400)], "call_site_id string, n int, text string")
    seen = spark.sparkContext.accumulator(0)
    whole = enhance.hover_parts

    def counted(text):
        def count(x):
            seen.add(1)
            return x

        return whole(F.udf(count, "string")(text))

    enhance.hover_parts = counted
    try:
        got = {r.call_site_id: r.imports_id for r in resolve.resolve_calls(c, stages=(resolve.unresolved,), hovers=hovers).collect()}
    finally:
        enhance.hover_parts = whole
    assert got == {f"s{i}": None if i % 2 else "i" for i in range(400)}
    assert seen.value < 40  # two texts, in a few expressions and runs; one for each of 400 sites before


def test_locations_are_gone_through_once_for_all_languages(spark, monkeypatch):
    symbols = [{"id": "f", "name": "f", "kind": "function", "file_path": "b.ts", "line": 3, "column": 2}, {"id": "v", "name": "v", "kind": "var", "file_path": "b.ts", "line": 4, "column": 0}]
    says = [("s0", "typescript", "q.f"), ("s1", "typescript", "w?.k"), ("s2", "python", "w?.k"), ("s3", None, "Box!.h"), ("s4", "python", "a.Box"), ("s5", "typescript", None), ("s6", "typescript", "w.k"), ("s6", "typescript", "w.k"), ("s7", "typescript", "w.k")]
    sites = [{"id": i, "caller_id": f"of {i}", "caller_file_path": "a.ts", "language_name": l, "callee_expression": e} for i, l, e in says]
    imports = [{"id": "i1", "file_path": "a.ts", "importedNames": ["Box", "w"], "resolvedPath": "lib/box.ts", "edgeKind": "import"}, {"id": "i0", "file_path": "a.ts", "importedNames": ["w"], "resolvedPath": "lib/c.ts", "edgeKind": "import"}, {"id": "i2", "file_path": "a.ts", "importedNames": [None], "resolvedPath": None, "edgeKind": "import"}]
    places = [
        ("s0", 0, "far/y.ts", 0, 0), ("s0", 1, "b.ts", 3, 2), ("s1", 0, "b.ts", 3, 2), ("s1", 1, "far/y.ts", 0, 0), ("s2", 0, "b.ts", 4, 0), ("s3", 2, "far/y.ts", 0, 0), ("s3", None, "node/x", 0, 0), ("s4", 0, "node/x", 1, 1),
        ("s4", 0, "far/y.ts", 1, 1), ("s5", 0, "lib/z.ts", 1, 1), ("s5", 1, None, 1, 1), ("s6", 0, "lib/z.ts", 1, 1), ("s6", 0, "far/y.ts", 1, 1), ("s7", None, "b.ts", 3, 2), ("s7", None, "far/y.ts", 3, 2), (None, 0, "b.ts", 3, 2), ("gone", 0, "b.ts", 3, 2),
    ]
    c = catalog(spark, symbols=symbols, call_sites=sites, imports=imports)
    where = spark.createDataFrame(places, "call_site_id string, n int, path string, line int, column int")
    calls, whole = [], resolve.prefixes.imports_of_definitions
    monkeypatch.setattr(resolve.prefixes, "imports_of_definitions", lambda *a, **b: calls.append(1) or whole(*a, **b))
    found = resolve.by_definition(c.call_sites.withColumnRenamed("id", "site"), c, where, builtin_paths=("node/",))
    got = {r.call_site_id: (r.caller_id, r.target_kind, r.callee_id, r.imports_id) for r in found.collect()}
    own = lambda s, *x: {s: (f"of {s}", *x)}
    assert got == own("s0", "project_symbol", "f", None) | own("s1", "import", None, "i1") | own("s3", "import", None, "i1") | own("s4", "builtin", None, None) | own("s5", "import", None, "i1") | own("s6", "import", None, "i1") | own("s7", "import", None, "i1")
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [x for x in (leaves.apply(i).toString() for i in range(leaves.size())) if "member#" in x]
    assert len(calls) == 1 and len(read) == 2  # once for what a location leads to by itself, once for imports; six times before
