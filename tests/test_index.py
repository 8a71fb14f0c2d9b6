"""From a source tree to an index, its changes, and the command line."""

import os
import shutil
import subprocess
import time

import pytest

from codeloom import config as settings
from codeloom.engine import NO_RESULTS, Engine, document_missing, embed_missing, hash_embedding, render
from codeloom.extract.run import extract_file, index
from codeloom.buckets import BucketedIndex
from codeloom.streaming.watch import Snapshots, debounced, last_events, process_batch, watch

PROJECT = os.path.join(os.path.dirname(__file__), "project")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tree") / "project")
    shutil.copytree(PROJECT, at)
    for path in ("node_modules/lib/a.ts", "build/x.ts", "ignored.ts"):
        os.makedirs(os.path.dirname(f"{at}/{path}"), exist_ok=True)
        with open(f"{at}/{path}", "w") as f:
            f.write("export const a = 1")
    return at


@pytest.fixture(scope="module")
def made(spark, tree, tmp_path_factory):
    return index(spark, tree, now_millis=7).save(str(tmp_path_factory.mktemp("saved") / "index"))


def names(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_files(made):
    assert names(made.files, "path", "language") == {("shapes.ts", "typescript"), ("util/text.ts", "typescript"), ("store.py", "python"), ("pkg/other.py", "python"), ("tests/shapes.test.ts", "typescript")}
    assert {r.indexed_at for r in made.files.collect()} == {7}


def test_symbols(made):
    got = names(made.symbols.filter("file_path = 'shapes.ts'"), "kind", "name", "exported")
    want = {
        ("module", "<module>", False), ("const", "UNIT", True), ("let", "count", False), ("interface", "Sized", True), ("type", "Pair", True), ("enum", "Side", True), ("namespace", "Geo", True), ("function", "mid", True), ("function", "hidden", True),
        ("class", "Square", True), ("property", "side", False), ("property", "made", False), ("method", "constructor", False), ("property", "name", False), ("property", "depth", False), ("method", "area", False), ("method", "scale", False),
        ("method", "twice", False), ("arrowFunction", "g", False), ("arrowFunction", "double", True), ("function", "run", True), ("const", "s", False),
    }
    assert got == want
    square = made.symbols.filter("name = 'Square'").first()
    assert [(b.inherits_from_name, b.inheritence_type) for b in square.inheritence] == [("Base", "extends"), ("Sized", "implements"), ("Other", "implements")]
    assert square.inheritence[1].inherits_from_id == made.symbols.filter("name = 'Sized'").first().id and square.decorator == "sealed"
    docs = {r.name: r.docstring for r in made.symbols.filter("docstring is not null").collect()}
    assert docs["UNIT"] == "The unit square." and docs["double"] == "twice as much" and docs["area"] == "Squares the side." and docs["_open"] == "Opens a path."
    python = names(made.symbols.filter("file_path = 'store.py'"), "kind", "name", "exported")
    assert {("class", "Store", True), ("function", "_open", True), ("method", "size", False), ("property", "root", False), ("var", "LIMIT", True), ("method", "inner", False), ("function", "make", True)} <= python


def test_imports(made):
    got = names(made.imports, "file_path", "sourceModule", "resolvedKind", "resolvedPath", "importKind")
    assert ("shapes.ts", "./util/text", "source", "util/text.ts", "named") in got and ("shapes.ts", "node:path", "builtin", None, "namespace") in got
    assert ("shapes.ts", "./types", "unresolved", None, "type-only") in got and ("store.py", ".pkg.other", "source", "pkg/other.py", "type-only") in got
    assert ("store.py", "os", "stdlib", None, "default") in got and ("tests/shapes.test.ts", "../shapes", "source", "shapes.ts", "named") in got


def test_calls(made):
    s = {r.id: r for r in made.symbols.collect()}
    sites = {r.id: r for r in made.call_sites.collect()}
    got = {(s[e.caller_id].name, sites[e.call_site_id].callee_name): (e.resolution_source, s[e.callee_id].name if e.callee_id else None) for e in made.call_edges.collect()}
    assert made.call_edges.count() == made.call_sites.count()
    assert got["side", "clamp"] == ("source_import", "clamp") and got["area", "scale"] == ("same_class", "scale") and got["run", "Square"] == ("same_file", "Square")
    assert got["run", "parseInt"] == ("builtin_list", None) and got["run", "log"] == ("builtin_list", None) and got["scale", "times"] == ("unresolved", None)
    assert got["make", "_open"] == ("same_file", "_open") and got["_open", "helper" if ("_open", "helper") in got else "assist"][0] == "source_import" and got["count", "x"] == ("dynamic_pattern", None)
    assert got["size", "count"] == ("same_class", "count") and got["<module>", "Square"] == ("source_import", "Square")


def test_facts(made):
    assert names(made.exceptions, "file_path", "exception_type") == {("shapes.ts", "RangeError"), ("store.py", "ValueError")}
    assert names(made.env_vars, "name") == {("UNIT_SIZE",), ('"RUN_MODE"',), ("STORE_TOKEN",)}


def test_files_without_rows():
    for language in ("typescript", "python", "rust"):
        assert not extract_file("", "a", language).symbols
    assert not extract_file("def (", "a.py", "python").symbols and extract_file("export const = {", "a.ts", "typescript").path == "a.ts"


def test_engine(spark, made, tree):
    e = Engine(made, tree, hash_embedding(16))
    assert [r.name for r in e.run("search_codebase", "auto", query="Squ*").collect()] == ["Square"]
    assert e.run("read_code", "definition", name="double", file="shapes.ts").first().text.startswith("export const double")
    assert e.run("read_code", "snippet", file="util/text.ts", start=-3, end=1).first().text == "export function clamp(v: number, lo: number): number {"
    assert {r.path for r in e.run("analyze_change_impact", "related_tests", name="Square").collect()} == {"tests/shapes.test.ts"}
    assert {r.env_name if "env_name" in r else r.name for r in e.run("analyze_change_impact", "required_env_vars", name="run").collect()} >= {'"RUN_MODE"'}
    assert {r.name for r in e.run("analyze_quality", "untested_symbols").collect()} == {"clamp", "_open", "Store", "make", "helper"}
    assert {r.role for r in e.run("analyze_change_impact", "data_flow", name="scale", file="shapes.ts").collect()} == {"parameter", "return", "caller", "callee"}
    tree_ = [(r.level, r.name) for r in e.run("trace_code_graph", "calls", name="run", file="shapes.ts", depth=2).collect()]
    assert tree_[0] == (0, "run") and (1, "Square") in tree_
    assert render(e.run("inspect_imports", "import_by_id", id="none")) == NO_RESULTS and "Square" in render(e.run("search_codebase", "symbol", query="*quare"))
    assert e.run("audit_index", "index_health").filter("check = 'orphan_call_sites'").first().n == 0
    for bad in (lambda: e.run("search_codebase", "nonsense"), lambda: e.run("read_code", "summary", file="nowhere")):
        with pytest.raises((ValueError, LookupError)):
            bad()
    assert e.run("explore_architecture", "codebase_map").count() >= 3 and len(Engine.modes()) >= 35
    e.record("search_codebase", ["shapes.ts"], "x" * 9, 5)
    assert e.run("audit_index", "token_savings").filter("tool_name is null").first().response_tokens == 3


def test_embeddings_and_docstrings(spark, made):
    c = embed_missing(made, hash_embedding(16))
    assert c.vec_symbols.count() == made.symbols.count() and embed_missing(c, hash_embedding(16)).vec_symbols.count() == made.symbols.count()
    assert embed_missing(made, lambda text: None).vec_symbols.count() == 0
    found = Engine(c, None, hash_embedding(16)).run("search_codebase", "semantic", query="Square", limit=5)
    assert found.first().name == "Square"
    assert document_missing(made, lambda prompt: "Made." if "helper" in prompt else None).symbols.filter("docstring = 'Made.'").count() == 1


def test_incremental(spark, made, tree, tmp_path):
    work = str(tmp_path / "work")
    shutil.copytree(tree, work)
    with open(f"{work}/util/text.ts", "a") as f:
        f.write("export function more() { return clamp(1, 2) }\n")
    os.remove(f"{work}/pkg/other.py")
    events = spark.createDataFrame([("util/text.ts", "upsert", 1), ("pkg/other.py", "upsert", 1), ("pkg/other.py", "unlink", 2), ("store.py", "upsert", 2)], "path string, kind string, seq long")
    assert {(r.path, r.kind) for r in last_events(events).collect()} == {("util/text.ts", "upsert"), ("pkg/other.py", "unlink"), ("store.py", "upsert")}
    after = process_batch(spark, made, events, work, settings.Config(), 9)
    assert {r.path: r.indexed_at for r in after.files.collect()} == {"shapes.ts": 7, "util/text.ts": 9, "store.py": 7, "tests/shapes.test.ts": 7}
    fresh = index(spark, work, now_millis=9)
    key = ("name", "kind", "file_path", "line")
    assert names(after.symbols, *key) == names(fresh.symbols, *key) and names(after.call_edges, "id", "resolution_source", "callee_id") == names(fresh.call_edges, "id", "resolution_source", "callee_id")


def test_debounce(spark):
    at = lambda ms: f"2024-01-01 00:00:0{ms // 1000}.{ms % 1000:03}"
    df = spark.createDataFrame([(at(0), "p", "upsert"), (at(200), "p", "unlink"), (at(450), "p", "upsert"), (at(2000), "p", "unlink")], "ts string, path string, kind string").selectExpr("cast(ts as timestamp) ts", "path", "kind")
    assert [r.kind for r in debounced(df).orderBy("start").collect()] == ["upsert", "unlink"]


@pytest.mark.parametrize("kind", [Snapshots, BucketedIndex])
def test_watch(spark, tmp_path, kind):
    root, store = str(tmp_path / "root"), kind(spark, str(tmp_path / "store"))
    os.makedirs(root)
    with open(f"{root}/a.py", "w") as f:
        f.write("def one():\n    pass\n")
    store.put(index(spark, root, now_millis=1), 1)
    running = watch(spark, root, store, str(tmp_path / "checkpoint"), now=lambda: 2)
    try:
        time.sleep(4)
        with open(f"{root}/b.py", "w") as f:
            f.write("def two():\n    pass\n")
        for _ in range(60):
            if max(store.numbers()) > 1:
                break
            time.sleep(1)
            assert running.query.exception() is None
    finally:
        running.stop(drain=True)
    assert not running.query.isActive
    assert {r.path for r in store.current().files.collect()} == {"a.py", "b.py"}


def test_history(spark, tmp_path):
    from codeloom.sources import history

    lines = spark.createDataFrame([(x,) for x in ["abc", "", "3\t1\ta.ts", "-\t-\tb.png", "2\t0\ta.ts"]], "value string")
    assert sorted(map(tuple, history.numstat(lines).collect())) == [("a.ts", 5, 1, 2), ("b.png", 0, 0, 1)]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.ts").write_text("one\ntwo\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    assert [(r.path, r.added) for r in history.churn(spark, str(tmp_path)).collect()] == [("a.ts", 2)]
    assert "first" in history.symbol_history(str(tmp_path), "a.ts", 1, 2) and history.symbol_history(str(tmp_path), "no.ts", 1, 2) == ""


def test_settings(tmp_path):
    assert settings.load(str(tmp_path)) == settings.Config()
    assert settings.save(str(tmp_path)) and not settings.save(str(tmp_path))
    (tmp_path / settings.FILE_NAME).write_text('{"ignore": ["x/"], "embeddings": "yes", "languages": {"python": [".pyx"]}}')
    got = settings.load(str(tmp_path))
    assert got.ignore == ["x/"] and got.embeddings is False and got.extensions[".pyx"] == "python" and ".ts" in got.extensions
    (tmp_path / settings.FILE_NAME).write_text("{")
    assert settings.load(str(tmp_path)) == settings.Config()


def test_types_put_together():
    got = {s["name"]: [(b["inherits_from_name"], b["inheritence_type"]) for b in s["inheritence"] or []] for s in extract_file("type A = B & C<D>\ntype E =\n  | 'x'\n  | F\ntype G = Partial<H>\ntype I = { a: J | K }\n", "a.ts", "typescript").symbols}
    assert got == {"<module>": [], "A": [("B", "intersection"), ("C", "intersection")], "E": [("F", "union")], "G": [("H", "extends")], "I": []}


def test_aliases(spark, tmp_path):
    from codeloom.sources import walk
    from codeloom.sources.files import settings

    (tmp_path / "web" / "lib").mkdir(parents=True)
    (tmp_path / "tsconfig.json").write_text('{ // root\n "compilerOptions": {"paths": {"~/*": ["./*"],}}}')
    (tmp_path / "web" / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}')
    (tmp_path / "web" / "lib" / "a.ts").write_text("export const a = 1")
    (tmp_path / "web" / "b.ts").write_text("import { a } from '@lib/a'\nimport { a as c } from 'lib/a'")
    (tmp_path / "d.ts").write_text("import { a } from '~/web/lib/a'\nimport { a as e } from '@lib/a'")
    assert {(r.dir, r.base_url): [(x.pattern, x.targets) for x in r.paths] for r in settings(spark, str(tmp_path), walk.walk(spark, str(tmp_path))).collect()} == {("", None): [("~/*", ["./*"])], ("web", "."): [("@lib/*", ["lib/*"])]}
    got = names(index(spark, str(tmp_path)).imports, "file_path", "sourceModule", "resolvedPath")
    assert got == {("web/b.ts", "@lib/a", "web/lib/a.ts"), ("web/b.ts", "lib/a", "web/lib/a.ts"), ("d.ts", "~/web/lib/a", "web/lib/a.ts"), ("d.ts", "@lib/a", None)}


def test_workspace_and_log(tmp_path):
    from codeloom.functions.workspace import inside, path_type, resolve_path
    from codeloom.logs import file_logger

    (tmp_path / "a").mkdir()
    assert inside(str(tmp_path), "a/../a") == os.path.realpath(tmp_path / "a") and path_type(str(tmp_path / "a")) == "directory" and resolve_path("x", "/y/z/..") == "/y/x"
    with pytest.raises(ValueError):
        inside(str(tmp_path / "a"), "../b")
    log = file_logger(str(tmp_path / "l.log"), "codeloom-test", most=200, backups=3)
    for i in range(60):
        log.info("line %d", i)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("l.log")) == ["l.log", "l.log.1", "l.log.2", "l.log.3"]


def test_sql_functions(spark):
    from codeloom.extract.udtf import register

    register(spark)
    got = spark.sql("select tab, get_json_object(row, '$.name') as name from codeloom_extract('a.py', 'def f():\\n    g()', 'python')").collect()
    assert ("symbols", "f") in {tuple(r) for r in got} and {r.tab for r in got} == {"symbols", "call_sites"}
    assert spark.sql("select codeloom_type_names('A<B>, C') as x").first().x == ["A", "C"]


def test_comments_of_calls():
    ts = extract_file("function f() {\n  // why\n  g(1)\n  h() // then\n  const x = k()\n}\n", "a.ts", "typescript").call_sites
    assert {c["callee_name"]: c["docstring"] for c in ts} == {"g": "why", "h": "then", "k": None}
    py = extract_file("def f():\n    # why\n    # so\n    g(1)\n    h()  # then\n    s = k('#')\n", "a.py", "python").call_sites
    assert {c["callee_name"]: c["docstring"] for c in py} == {"g": "why\nso", "h": "then", "k": None}


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.ts").write_bytes(b"export const a = '\xff\xfe'\n")
    assert index(spark, str(tmp_path)).symbols.filter("name = 'a'").count() == 1
