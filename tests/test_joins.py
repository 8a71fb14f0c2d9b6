"""Interval, prefix and nearest-ancestor joins against plain loops."""

import os
import random
import time

import pytest

from codeloom.catalog import Catalog
from codeloom.operators import nearest, prefixes, spans

HELD = "file_path string, id string, first int, first_column int, last int, last_column int"
ASKED = "position long, file_path string, line int, column int"


def plans(df):
    text = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("seed,most", [(0, 40), (1, 5000)])
def test_innermost_span(spark, seed, most):
    rng = random.Random(seed)
    held = []
    for k in range(400):
        a = rng.randrange(most)
        held.append((rng.choice(["a", "b", "c"]), f"s{k:03}", a, rng.randrange(9), a + rng.choice([0, 0, 1, 2, 3, 7, 8, 63, 64, 65, most]), rng.randrange(9)))
    held = [h for h in held if (h[2], h[3]) <= (h[4], h[5])]
    asked = [(k, rng.choice(["a", "b", "c", "d"]), rng.randrange(most + 50), rng.randrange(9)) for k in range(300)] + [(900, None, 1, 1), (901, "a", None, 1)]
    want = {}
    for p, f, line, column in asked:
        around = [(-a, -ac, b, bc, i) for g, i, a, ac, b, bc in held if g == f and line is not None and (a, ac) <= (line, column) <= (b, bc)]
        if around:
            want[p] = min(around)[4]
    out = spans.innermost(spark.createDataFrame(asked, ASKED), spark.createDataFrame(held, HELD))
    plans(out)
    assert {r.position: r.id for r in out.collect()} == want


def test_many_spans_of_one_file(spark, tmp_path):
    held = spark.range(100_000).selectExpr("'f' file_path", "concat('s', id) id", "cast(id * 3 as int) first", "0 first_column", "cast(id * 3 + id % 3 as int) last", "9 last_column")
    asked = spark.range(20_000).selectExpr("id position", "'f' file_path", "cast(id * 15 as int) line", "4 column")
    for name, df in (("held", held), ("asked", asked)):
        df.write.parquet(str(tmp_path / name))
    began = time.time()
    out = spans.innermost(spark.read.parquet(str(tmp_path / "asked")), spark.read.parquet(str(tmp_path / "held")))
    plans(out)
    assert out.count() == 20_000 and time.time() - began < 60


def test_types_at(spark):
    c = Catalog.empty(spark)
    row = lambda id_, kind, line, end, **k: {n: k.get(n, {"id": id_, "name": id_, "kind": kind, "file_path": "f.ts", "line": line, "column": 0, "end_line": end, "end_column": 5}.get(n)) for n in c.symbols.columns}
    c = c.with_(symbols=spark.createDataFrame([row("A", "class", 1, 30), row("m", "method", 3, 9, signature="m(x: int): str"), row("v", "const", 5, None, return_type="int"), row("w", "let", 40, 39)], c.symbols.schema))
    asked = spark.createDataFrame([(1, "f.ts", 2, 0), (2, "f.ts", 4, 0), (3, "f.ts", 5, 80), (4, "f.ts", 31, 0), (5, "f.ts", 9, 6), (6, "g.ts", 4, 0)], ASKED)
    hovers = spark.createDataFrame([(4, "number")], "position long, type string")
    got = {r.position: (r.id, r.type) for r in spans.types_at(c, asked, hovers).collect()}
    assert got == {1: ("A", "class A"), 2: ("m", "m(x: int): str"), 3: ("v", "v: int"), 4: (None, "number"), 5: ("A", "class A"), 6: (None, None)}
    assert {r.position: r.id for r in spans.symbols_at(c, asked, ["class"]).collect()} == {1: "A", 2: "A", 3: "A", 5: "A"}


def test_prefix_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abA") for _ in range(rng.randrange(5)))
    left = [(f"l{k}", rng.choice("xy"), word()) for k in range(150)] + [("l0", "x", None)]
    right = [(f"r{k}", rng.choice("xyz"), word(), k % 7) for k in range(150)]
    want = {(a, b, n) for a, g, u in left for b, h, v, n in right if g == h and u and v and (v.lower().startswith(u.lower()) or u.lower().startswith(v.lower()))}
    out = prefixes.prefix_pairs(spark.createDataFrame(left, "id string, grp string, word string"), spark.createDataFrame(right, "id string, grp string, word string, rank int"))
    plans(out)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def _imports(spark, rows):
    c = Catalog.empty(spark)
    made = [{n: dict(zip(("id", "file_path", "importedNames", "resolvedPath", "edgeKind", "sourceModule"), r)).get(n) for n in c.imports.columns} for r in rows]
    return c.with_(imports=spark.createDataFrame(made, c.imports.schema))


def test_imports_of_types_and_definitions(spark):
    c = _imports(spark, [("i1", "a.ts", ["Foo"], "lib/foo.ts", "import", "x"), ("i2", "a.ts", ["FooBar", "q as baz"], "lib/bar.ts", "import", "x"), ("i3", "a.ts", ["util"], "far/u.ts", "re-export", "x"), ("i4", "b.ts", ["Foo"], None, "import", "x")])
    types = spark.createDataFrame([("t1", "a.ts", ["foobarbaz"]), ("t2", "a.ts", ["FO"]), ("t3", "a.ts", ["none"]), ("t4", "b.ts", ["food", ""]), ("t5", "c.ts", ["Foo"])], "id string, file_path string, names array<string>")
    assert {r.id: r.imports_id for r in prefixes.imports_of_types(c, types).collect()} == {"t1": "i2", "t2": "i2", "t4": "i4"}
    sites = [("s1", "a.ts", "lib/zzz.ts", "x.y"), ("s2", "a.ts", "far/u.ts", "baz?.go"), ("s3", "a.ts", "far/u.ts", "nothing.q"), ("s4", "b.ts", "lib/foo.ts", "a.Foo"), ("s5", "a.ts", None, "Foo!.baz")]
    out = prefixes.imports_of_definitions(c, spark.createDataFrame(sites, "site string, file_path string, definition_path string, callee_expression string"))
    assert {r.site: r.imports_id for r in out.collect()} == {"s1": "i2", "s2": "i2", "s4": "i4", "s5": "i2"}


def test_nearest_folder(spark):
    rng = random.Random(4)
    path = lambda: "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 7)))
    paths, dirs = {path() + "/f.ts" for _ in range(80)} | {"f.ts"}, {path() for _ in range(10)} | {""}
    want = {p: max((d for d in dirs if d == "" or p.startswith(d + "/")), key=len) for p in paths}
    out = nearest.nearest(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(d,) for d in dirs], "dir string"))
    plans(out)
    assert {r.path: r.dir for r in out.collect()} == want


def test_alias_targets(spark):
    settings = [("", None, [("@/*", ["src/*", "./lib/*"]), ("@/x/*", ["deep/*"]), ("exact", ["one/two"]), ("*.css", ["styles/*.css"])]), ("pkg", "./base", [("~/*", ["../*"])]), ("none", None, None)]
    frame = spark.createDataFrame(settings, "dir string, base_url string, paths array<struct<pattern:string,targets:array<string>>>")
    imports = [("1", "a.ts", "@/m"), ("2", "q/a.ts", "@/x/m"), ("3", "a.ts", "exact"), ("4", "pkg/s/a.ts", "~/m"), ("5", "pkg/a.ts", "@/m"), ("6", "a.ts", "./rel"), ("7", "none/a.ts", "@/m"), ("8", "a.ts", "main.css"), ("9", "a.ts", "react")]
    out = nearest.alias_targets(spark.createDataFrame(imports, "id string, file_path string, sourceModule string"), frame)
    got = sorted((r.id, r.at, r.target) for r in out.collect())
    assert got == [("1", 0, "src/m"), ("1", 1, "lib/m"), ("2", 0, "deep/m"), ("3", 0, "one/two"), ("4", 0, "pkg/m"), ("4", 1, "pkg/base/~/m"), ("5", 0, "pkg/base/@/m"), ("8", 0, "styles/main.css")]


def test_nested_settings_of_a_tree(spark, tmp_path):
    from codeloom.extract.run import index

    for path, text in {
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}} // top', "src/m.ts": "export function m() {}", "app/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["own/*",]}}}',
        "app/own/m.ts": "export function m() {}", "a.ts": 'import { m } from "@/m"', "app/b.ts": 'import { m } from "@/m"\nimport { o } from "own/m"', "app/deep/er/c.ts": 'import { m } from "@/m"',
    }.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {(r.file_path, r.sourceModule): r.resolvedPath for r in index(spark, str(tmp_path)).imports.collect()}
    assert got == {("a.ts", "@/m"): "src/m.ts", ("app/b.ts", "@/m"): "app/own/m.ts", ("app/b.ts", "own/m"): "app/own/m.ts", ("app/deep/er/c.ts", "@/m"): "app/own/m.ts"}
