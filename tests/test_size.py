"""Work that grows with the input: few names with many bearers and many calls, by the rows that are shuffled; and the same results by plain Python."""

import random

import pytest
from graphs import catalog

from codeloom.operators import joins


def shuffled(spark, run):
    """What `run` gives, and the rows that its stages shuffled."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    count = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in _list(store.stageList(None, False, False, none, None))}
    before = count()
    out = run()
    return out, sum(n for k, n in count().items() if k not in before)


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]


def named(spark, n_calls, n_bearers, names, parents=0, seed=1):
    rng = random.Random(seed)
    tops = [{"id": f"t{i}", "name": rng.choice(names), "line": i} for i in range(n_bearers)]
    kids = [{"id": f"k{i}", "name": rng.choice(names), "line": i % 3, "parent_id": f"t{rng.randrange(n_bearers)}"} for i in range(parents)]
    symbols = tops + kids
    pick = lambda: rng.choice([None, None, rng.choice(symbols)["id"]])
    sites = [{"id": f"s{i}", "caller_id": f"t{rng.randrange(n_bearers)}", "callee_name": rng.choice([*names, "Other"])} for i in range(n_calls)]
    edges = [{"id": f"e{i}", "call_site_id": s["id"], "caller_id": s["caller_id"], "callee_id": pick()} for i, s in enumerate(sites)]
    return symbols, sites, edges


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nested_callers_by_plain_python(spark, seed):
    symbols, sites, edges = named(spark, 25, 8, ["Aa", "aA", "b"], 9, seed)
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)
    at, site = {s["id"]: s for s in symbols}, {s["id"]: s for s in sites}
    want, with_ids = set(), set()
    for e in edges:
        called = site[e["call_site_id"]]["callee_name"].lower()
        for t in (s for s in symbols if s["name"].lower() == "aa"):
            kids = [k for k in symbols if k.get("parent_id") == t["id"] and (k["id"] == e["callee_id"] or k["name"].lower() == called)]
            if kids or t["id"] == e["callee_id"] or called == "aa":
                for k in kids or [{}]:
                    want.add((e["caller_id"], k.get("name"), k.get("line")))
                    with_ids.add((e["caller_id"], t["id"], k.get("id")))
    got = [(r.caller_id, r.child_name, r.child_line) for r in joins.callers_nested(c, "AA").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [(r.caller_id, r.t, r.child) for r in joins.nested_callers(c, c.symbols.filter("lower(name) = 'aa'"), with_ids=True).collect()]
    assert len(got) == len(set(got)) and set(got) == with_ids
    assert sorted(r.caller_id for r in joins.calling(c, c.symbols.filter("lower(name) = 'aa'")).collect()) == sorted({x for x, *_ in want})


def test_callers_of_a_common_name_are_not_paired_with_its_bearers(spark):
    symbols, sites, edges = named(spark, 600, 500, ["a"])
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)
    got, rows = shuffled(spark, lambda: joins.callers_nested(c, "a").count())
    assert got > 0 and rows < 20_000  # 600 calls, 500 symbols; their pairs were 150,000 rows


@pytest.mark.parametrize("with_ids", [False, True])
def test_callers_and_children_of_a_common_name_meet_in_many_tasks(spark, monkeypatch, with_ids):
    from pyspark.sql import functions as F

    for name, n in (("TILE_ROWS", 500), ("PART", 64), ("BLOCK", 16)):
        monkeypatch.setattr(joins, name, n, raising=False)
    kids = [{"id": f"k{i}", "name": "A" if i % 10 else "b", "line": i if i % 7 else None, "file_path": f"{i % 3}.ts", "parent_id": "top"} for i in range(200)]
    symbols = [{"id": "top", "name": "top"}, *kids, *({"id": f"c{i}", "name": f"c{i}"} for i in range(80))]
    sites = [{"id": f"s{i}", "caller_id": f"c{i % 80}", "callee_name": "b" if i % 5 == 0 else "a"} for i in range(160)]
    edges = [{"id": f"e{i}", "call_site_id": s["id"], "caller_id": s["caller_id"], "callee_id": f"k{i}" if i % 11 == 0 else None} for i, s in enumerate(sites)]
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)
    row = lambda caller, k: (caller, k["name"], k["file_path"], k["line"], *((k["id"],) if with_ids else ()))
    want = {row(e["caller_id"], k) for e, s in zip(edges, sites) for k in kids if k["id"] == e["callee_id"] or k["name"].lower() == s["callee_name"]}
    found = joins.nested_callers(c, c.symbols.filter("id = 'top'"), with_ids=with_ids)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    got = [(r.caller_id, r.child_name, r.child_file, r.child_line, *((r.child,) if with_ids else ())) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want
    by_task = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert max(by_task) < len(rows) / 2  # all rows of a name used to come from one task


def test_sites_of_a_common_name_are_not_paired_with_its_bearers(spark):
    from codeloom.operators import resolve

    symbols, sites, _ = named(spark, 600, 500, ["a"])
    imports = [{"id": f"i{i}", "file_path": "a.ts", "importedNames": ["Other"], "resolvedPath": "a.ts", "resolvedKind": "source", "importKind": "named", "edgeKind": "import"} for i in range(200)]
    c = catalog(spark, symbols=symbols, call_sites=sites, imports=imports)
    got, rows = shuffled(spark, lambda: {(r.call_site_id, r.callee_id, r.imports_id) for r in resolve.resolve_calls(c).collect()})
    want = min(((s["line"], s["id"]) for s in symbols))[1]
    assert got == {(s["id"], want, None) if s["callee_name"] == "a" else (s["id"], None, "i0") for s in sites}
    assert rows < 20_000  # 600 sites, 500 symbols, 200 imports; their pairs were some 200,000 rows


def test_rounds_send_nothing_to_the_driver(spark):
    from codeloom.operators import graph

    runs = spark._jsparkSession.sharedState().statusStore()
    before = runs.executionsCount()
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n3", "n1")], "src string, dst string")
    nodes = edges.selectExpr("src as node").union(edges.selectExpr("dst"))
    assert graph.reach(edges, nodes.filter("node = 'n0'")).count() == 7
    assert {r.node: r.layer for r in graph.layers(edges, nodes).collect()} == {"n0": 4, "n1": 3, "n2": 3, "n3": 3, "n4": 2, "n5": 1, "n6": 0}
    plans = [e.physicalPlanDescription() for e in _list(runs.executionsList(before, 10_000))]
    assert plans and not [p for p in plans if "BroadcastExchange" in p]


def test_folders_of_a_map_are_paired_once(spark):
    from pyspark.sql import functions as F

    from codeloom.plans import modes

    symbols = [{"id": f"{d}{i}", "name": f"{d}{i}", "file_path": f"{d}/x.ts", "exported": True} for d in "ab" for i in range(100)]
    sites = [{"id": f"s{i}", "caller_id": f"a{i}", "callee_name": f"b{i}", "caller_file_path": "a/x.ts"} for i in range(100)]
    edges = [{"id": f"e{i}", "call_site_id": f"s{i}", "caller_id": f"a{i}", "callee_id": f"b{i}"} for i in range(100)]
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges, files=[{"path": f"{d}/x.ts"} for d in "ab"])
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    c = c.with_(call_sites=c.call_sites.withColumn("caller_file_path", F.udf(count, "string")("caller_file_path")))
    got = {r.dir: (r.files, r.layer, r.depends_on) for r in modes.codebase_map(c).collect()}
    assert got == {"a": (1, 1, ["b"]), "b": (1, 0, None)}
    assert seen.value <= 300  # 100 sites, looked at once; a few expressions may each call for the value


def test_calls_of_other_names_are_dropped_before_repeats_are_looked_for(spark):
    symbols, sites, edges = named(spark, 3000, 300, [f"n{i}" for i in range(60)])
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)
    ids = {s["id"] for s in symbols if s["name"] == "n7"}
    want = {e["caller_id"] for e, s in zip(edges, sites) if s["callee_name"] == "n7" or e["callee_id"] in ids}
    got, rows = shuffled(spark, lambda: {r.caller_id for r in joins.callers_nested(c, "n7").collect()})
    assert got == want and ids
    assert rows < 8_000  # the join of calls and sites; the distinct calls of all names came on top


def test_a_tree_of_callers_takes_only_calls_that_lead_to_it(spark):
    from codeloom.operators import calltree

    symbols, sites, edges = named(spark, 3000, 300, [f"n{i}" for i in range(60)])
    symbols += [{"id": x, "name": x} for x in ("root", "up", "top")]
    sites += [{"id": f"r{i}", "caller_id": a, "callee_name": b} for i, (a, b) in enumerate([("up", "root"), ("top", "up")])]
    edges += [{"id": f"re{i}", "call_site_id": f"r{i}", "caller_id": a, "callee_id": b} for i, (a, b) in enumerate([("up", "root"), ("top", "up")])]
    c = catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)
    got, rows = shuffled(spark, lambda: [(r.level, r.id, r.mark) for r in calltree.call_lines(c, "root", "in", 3).orderBy("path").collect()])
    assert got == [(0, "root", ""), (1, "up", ""), (2, "top", "")]
    assert rows < 2_000  # two calls lead to it; the distinct ones of all were 3,000 rows and more


def test_tables_of_the_projection_are_not_sent_through_the_driver(spark, monkeypatch):
    from codeloom import storage
    from codeloom.sources import projection

    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    assert "BroadcastExchange" not in plan(projection.project(spark, "/root/testdata/sf0.001").call_edges)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 10, raising=False)
    c = projection.project(spark, "/root/testdata/sf0.001")
    assert "BroadcastExchange" not in plan(c.call_sites) and "BroadcastExchange" not in plan(c.imports)


def test_sites_are_not_shuffled_to_meet_the_names_they_share(spark):
    from codeloom.operators import resolve

    symbols, sites, _ = named(spark, 4000, 200, ["a"])
    symbols += [{"id": f"u{i}", "name": f"u{i}", "kind": "function" if i % 2 else "const"} for i in range(3000)]  # no site calls them
    imports = [{"id": "i0", "file_path": "a.ts", "importedNames": ["Other"], "resolvedPath": "a.ts", "resolvedKind": "source", "importKind": "named", "edgeKind": "import"}]
    c = catalog(spark, symbols=symbols, call_sites=sites, imports=imports)
    rounds = [resolve.same_file, resolve.by_import]
    kept = resolve.Store(spark, "t").keep(c.call_sites.withColumnRenamed("id", "site"), "sites")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # as with symbols beyond the limit
    try:
        got, rows = shuffled(spark, lambda: sum(stage(kept, c).count() for stage in rounds))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == 4000
    assert rows < 1_000  # sites and symbols were 4,000 and 3,000 rows, in each join


def test_nodes_that_nothing_leads_to_are_not_shuffled_in_each_step(spark):
    from codeloom.operators import graph

    edges = [(f"s{i}", f"t{i % 3}") for i in range(600)] + [("t0", "t1"), ("t0", "t1"), ("t0", "t2"), ("t1", "t1"), ("t1", None), (None, "t2"), (None, None), ("t2", "end")]
    nodes = {x for e in edges for x in e}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(graph.ITERATIONS):
        after = dict.fromkeys(nodes, 0.0)
        for src, dst in edges:
            if src is not None:
                after[dst] += want[src] / sum(s == src for s, _ in edges) if src[0] == "t" else want[src]
        want = {v: (1 - graph.DAMPING) / len(nodes) + graph.DAMPING * x for v, x in after.items()}
    got, rows = shuffled(spark, lambda: {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string")).collect()})
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert rows < 12_000  # five times 600 edges and some; the 600 nodes went through each of 30 steps as well before
    few = graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), iterations=1).collect()
    none = graph.pagerank(spark.createDataFrame(edges, "src string, dst string"), iterations=0).collect()
    assert len(few) == len(none) == len(nodes) and {r.rank for r in none} == {1 / len(nodes)}


@pytest.mark.parametrize("few", [200_000, 0])
def test_sites_of_imports_that_bring_in_no_base_are_not_shuffled(spark, monkeypatch, few):
    from codeloom import storage
    from codeloom.plans import modes

    base = lambda *names: [(n, None, None, "extends") for n in names]
    tops = [{"id": "Base", "name": "Base"}, {"id": "Free", "name": "Free"}, {"id": "H1", "inheritence": base("Nope", "Base", "Lib")}, {"id": "H2", "inheritence": base(None, "Lib")}, {"id": "H3", "inheritence": base("Silent", "Base")}, {"id": "H4", "inheritence": []}]
    kids = [{"id": f"{t}.{n}", "name": n, "parent_id": t, "kind": "method"} for t in ("Base", "Free", "H1", "H2", "H3", "H4") for n in ("run", "go", None)]
    symbols = [*tops, *kids, kids[6], {"id": "gone.run", "name": "run", "parent_id": "gone"}]
    imports = [{"id": "i", "importedNames": ["Lib", "Other"]}, {"id": "i", "importedNames": ["Lib"]}, {"id": "s", "importedNames": ["Silent", None]}, {"id": "o", "importedNames": ["Other"]}, {"id": "n", "importedNames": None}]
    calls = [("Base.run", None, "run"), ("Free.go", "i", "go"), ("Base.None", None, None), (None, "i", "go"), (None, "i", None), (None, "s", None), (None, None, "run"), (None, "gone", "run"), (None, "n", "run")] + [(None, "o", f"x{i}") for i in range(2000)]
    sites = [{"id": f"s{i}", "callee_name": n} for i, (_, _, n) in enumerate(calls)]
    edges = [{"id": f"e{i}", "call_site_id": f"s{i}", "callee_id": s, "imports_id": m} for i, (s, m, _) in enumerate(calls)] + [{"id": "lost", "call_site_id": "lost", "imports_id": "s"}, {"id": "twice", "call_site_id": "s3", "imports_id": "i"}]
    c = catalog(spark, symbols=symbols, imports=imports, call_sites=sites, call_edges=edges)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", few)
    got, rows = shuffled(spark, lambda: sorted(r.id for r in joins.inheritance_covered(c).collect()))
    assert got == ["H1.run", "H2.go"]  # nothing of H3, as its first base is called by no name
    if few:
        assert rows < 2000  # some 2,000 sites and as many edges; they were shuffled more than once before
    assert {r.id for r in modes.dead_code(c, limit=None).collect()} == {"Base.go", "Free.run", "H1.go", "H2.run", "H3.run", "H3.go", "H4.run", "H4.go", "gone.run", "Base", "Free", "H1", "H2", "H3", "H4"}
