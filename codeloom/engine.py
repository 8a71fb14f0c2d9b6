"""The engine's endpoints by name: a mode, its parameters, and what it answers.

An answer is a DataFrame; `render` makes text of one. Lookups that find
nothing answer with an empty DataFrame, which renders as NO_RESULTS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import changes, lookup
from .plans import modes
from .sources import history
from .sources.files import all_sources

NO_RESULTS = "No results."
AGENT_FILES = ("AGENTS.md", "README.md", "CONTRIBUTING.md", ".cursorrules", ".github/copilot-instructions.md")


class Engine:
    """Answers questions over a catalog, and over the source tree where it is given."""

    def __init__(self, catalog: Catalog, root: str | None = None, embed: Callable[[str], list[float]] | None = None):
        self.c, self.root, self.embed = catalog, root, embed

    @property
    def spark(self) -> SparkSession:
        return self.c.spark

    def run(self, tool: str, mode: str, **params) -> DataFrame:
        try:
            answer = getattr(self, f"{tool}__{mode}")
        except AttributeError:
            raise ValueError(f"unknown mode {tool} / {mode}; known are {', '.join(self.modes())}") from None
        return answer(**params)

    @classmethod
    def modes(cls) -> list[str]:
        return [n.replace("__", " ") for n in dir(cls) if "__" in n.strip("_") and not n.startswith("_")]

    def _one(self, symbol_id=None, name=None, file=None):
        return lookup.resolve_symbol(self.c, symbol_id, name, file)

    def _sources(self) -> DataFrame:
        if self.root is None:
            raise ValueError("this mode reads source files; give the engine a root")
        return all_sources(self.spark, self.root)

    # search_codebase
    def search_codebase__symbol(self, query, **p):
        return modes.search_symbols(self.c, query, **p)

    def search_codebase__file_compact(self, query="", **p):
        return modes.search_files(self.c, query, **p)

    def search_codebase__file_detailed(self, query="", **p):
        return modes.search_files(self.c, query, detailed=True, **p)

    def search_codebase__semantic(self, query, **p):
        return modes.semantic_search(self.c, query, self.embed(query) if self.embed else None, **p)

    def search_codebase__auto(self, query, **p):
        return self.run("search_codebase", modes.assign_mode(query), query=query, **p)

    # read_code
    def read_code__definition(self, **p):
        return modes.read_definition(self._sources(), lookup.definition(self.c, self._one(**p)["id"]))

    def read_code__snippet(self, file, start, end):
        return modes.read_snippet(self._sources(), lookup.resolve_file(self.c, file), start, end)

    def read_code__summary(self, file):
        return modes.read_summary(self.c, lookup.resolve_file(self.c, file))

    # inspect_symbol
    def inspect_symbol__definition(self, **p):
        return self.read_code__definition(**p)

    def inspect_symbol__type_at_location(self, file, line, column):
        """The types of what is defined at a place that counts from 1."""
        at = lookup.at_location(self.c, lookup.resolve_file(self.c, file), line - 1, column - 1)
        return at.select("id", "name", "kind", "signature", "parameters_json", "return_type")

    def inspect_symbol__references(self, name, **p):
        return modes.references(self.c, name, **p)

    def inspect_symbol__importance(self, **p):
        return modes.importance(self.c, **p)

    def inspect_symbol__history(self, include_diff=False, **p):
        s = self._one(**p)
        text = history.symbol_history(self.root or ".", s["file_path"], s["line"] + 1, (s["end_line"] if s["end_line"] is not None else s["line"]) + 1, include_diff)
        return self.spark.createDataFrame([(s["id"], text)] if text else [], "id string, text string")

    def inspect_symbol__resolve_type(self, name, **p):
        return modes.resolve_type(self.c, name, **p)

    def inspect_symbol__class_hierarchy(self, **p):
        return modes.class_hierarchy(self.c, self._one(**p)["id"])

    # trace_code_graph
    def trace_code_graph__calls(self, direction="out", depth=3, **p):
        """The walk over calls as lines; both directions, one after the other, if asked."""
        id_, lines = self._one(**p)["id"], []
        for d in ("in", "out") if direction == "both" else (direction,):
            lines += [(d, n, *x) for n, x in enumerate(modes.trace_tree(self.c, id_, d, depth))]
        out = self.spark.createDataFrame(lines, "direction string, n int, level int, id string, mark string")
        return out.join(self.c.symbols.select("id", "name", "kind", "file_path", "line"), "id", "left").orderBy("direction", "n")

    # analyze_change_impact
    def analyze_change_impact__blast_radius(self, name, **p):
        return modes.blast_radius(self.c, name, **p)

    def analyze_change_impact__related_tests(self, name):
        return modes.related_tests(self.c, name)

    def analyze_change_impact__required_env_vars(self, name=None):
        return modes.required_env_vars(self.c, name)

    def analyze_change_impact__error_flow(self, name=None):
        return modes.error_flow(self.c, name)

    def analyze_change_impact__data_flow(self, limit=15, **p):
        return modes.data_flow(self.c, self._one(**p)["id"], limit)

    # explore_architecture
    def explore_architecture__codebase_map(self, **p):
        return modes.codebase_map(self.c, **p)

    def explore_architecture__entry_points(self, **p):
        return modes.entry_points(self.c, **p)

    def explore_architecture__explore(self, **p):
        return modes.explore(self.c, **p)

    def explore_architecture__coupling_metrics(self, **p):
        return modes.coupling_metrics(self.c, **p)

    # analyze_quality
    def analyze_quality__dead_code(self, **p):
        return modes.dead_code(self.c, **p)

    def analyze_quality__untested_symbols(self, **p):
        return modes.untested(self.c, **p)

    def analyze_quality__similar_patterns(self, match_on=("kind", "return_type", "decorator", "inheritance", "params"), **p):
        return modes.similar_patterns(self.c, self._one(**p), match_on)

    def analyze_quality__importance(self, **p):
        return modes.importance(self.c, **p)

    def analyze_quality__hotspots(self, **p):
        return modes.hotspots(self.c, history.churn(self.spark, self.root or "."), **p)

    # inspect_imports
    def inspect_imports__imports_for_file(self, file, limit=100):
        return lookup.imports_like(self.c, file, limit)

    def inspect_imports__import_by_id(self, id):
        return lookup.import_by_id(self.c, id)

    def inspect_imports__dependency_cycles(self, **p):
        return modes.dependency_cycles(self.c, **p)

    # audit_index
    def audit_index__agent_config(self):
        import os

        found = []
        for name in AGENT_FILES:
            path = os.path.join(self.root or ".", name)
            if os.path.isfile(path):
                with open(path, errors="replace") as f:
                    found.append((name, f.read()))
        return modes.stale_references(self.c, self.spark.createDataFrame(found, "path string, content string"))

    def audit_index__token_savings(self):
        return modes.token_savings(self.c)

    def audit_index__index_health(self):
        return modes.index_health(self.c)

    def record(self, tool: str, paths: list[str], answer: str, now_millis: int) -> None:
        """Notes what an answer saved."""
        self.c = changes.record_usage(self.c, changes.usage_row(self.c, tool, paths, len(answer), now_millis))


def render(df: DataFrame, most: int = 200) -> str:
    """At most `most` rows as a table of text."""
    rows = df.limit(most + 1).collect()
    if not rows:
        return NO_RESULTS
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows[:most]]]
    widths = [min(60, max(len(r[k]) for r in cells)) for k in range(len(df.columns))]
    lines = ["  ".join(v[:60].ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join(lines + (["…"] if len(rows) > most else []))


def hash_embedding(width: int = 768) -> Callable[[str], list[float]]:
    """An embedding that needs no model: signed counts of hashed words, of length 1."""
    import math
    import re
    import zlib

    def embed(text: str) -> list[float]:
        out = [0.0] * width
        for w in re.findall(r"[A-Za-z][a-z]+|[A-Z]+|\d+", text or ""):
            h = zlib.crc32(w.lower().encode())
            out[h % width] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / norm for x in out]

    return embed


def embed_missing(c: Catalog, embed: Callable[[str], list[float] | None]) -> Catalog:
    """Adds vectors of symbols that lack one; what `embed` gives none for stays without."""
    import pandas as pd

    from .operators.joins import needing_embeddings
    from .operators.search import embedding_text

    def run(batches):
        for b in batches:
            vectors = [embed(t) for t in b["text"]]
            keep = [v is not None for v in vectors]
            yield pd.DataFrame({"symbol_id": b["id"][keep], "embedding": pd.Series([v for v in vectors if v is not None], index=b.index[keep], dtype=object)})

    wanted = embedding_text(c.with_(symbols=needing_embeddings(c)))
    return changes.upsert_vectors(c, wanted.mapInPandas(run, "symbol_id string, embedding array<float>"))


def document_missing(c: Catalog, provide: Callable[[str], str | None], kinds=("function", "method", "class")) -> Catalog:
    """Adds docstrings that a provider writes for symbols that lack one."""
    import pandas as pd

    prompt = F.concat_ws("\n", F.lit("Describe in one sentence what this does:"), F.concat_ws(" ", "kind", "name"), "signature")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "docstring": [provide(p) for p in b["prompt"]]})

    wanted = lookup.without_docstring(c, kinds).select("id", prompt.alias("prompt"))
    made = wanted.mapInPandas(run, "id string, docstring string").filter("docstring is not null")
    return changes.update_symbols(c, made)
