"""Small hand-made catalogs."""

from codeloom import schema
from codeloom.catalog import Catalog


def rows(spark, table, given):
    s = schema.TABLES[table]
    defaults = {"line": 0, "column": 0, "exported": False, "language": "typescript", "kind": "function", "file_path": "a.ts", "confidence": 0, "call_kind": "function_call", "language_name": "typescript", "caller_file_path": "a.ts", "call_line": 1, "resolution_source": "same_file", "target_kind": "project_symbol"}
    return spark.createDataFrame([tuple(g.get(f.name, defaults.get(f.name) if f.name not in g else None) for f in s.fields) for g in given], s)


def catalog(spark, **tables):
    c = Catalog.empty(spark)
    return c.with_(**{t: rows(spark, t, g) for t, g in tables.items()})


def calls(spark, pairs, symbols=None):
    """Symbols and calls a->b by letters."""
    names = sorted({x for p in pairs for x in p})
    symbols = symbols or [{"id": n, "name": n} for n in names]
    sites = [{"id": f"s{i}", "caller_id": a, "callee_name": b, "call_line": i + 1} for i, (a, b) in enumerate(pairs)]
    edges = [{"id": f"e{i}", "call_site_id": f"s{i}", "caller_id": a, "callee_id": b} for i, (a, b) in enumerate(pairs)]
    return catalog(spark, symbols=symbols, call_sites=sites, call_edges=edges)


G = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e")]
