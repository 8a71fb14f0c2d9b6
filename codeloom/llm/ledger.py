"""Secret scan over an incremental blob ledger.

A version of a file is content-addressed by SHA-256. The ledger is a folder
of tables that holds, for each blob and rule version ever scanned, the spans
found (perhaps none). A scan takes only blobs that lack a pair with some
current rule, appends what it finds to the ledger, and joins the ledger back to
all paths and versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    #: Characters that `group` must have for a match to count.
    group: int = 0
    least: int = 1
    #: A cheap test that every text with a match passes.
    hint: str = ""


#: Matches whose places are summed together.
TOGETHER = 128

#: Patterns of the base kinds and of further kinds that this scan adds, in the order of kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, hint=r"(?i:passw|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hint="AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]+", least=24, hint="[0-9a-f]{24}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox[abprs]-"),
)


def spans(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches that count, as array<struct<at, end>> of code points.

    The pieces between matches and the matches themselves alternate, so
    running sums of their lengths give the places. Sums run within groups of
    TOGETHER matches, then over the groups, so that no list is copied once for
    each match however many a text has.
    """
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sized = F.filter(F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(counted, F.length).alias("part")), lambda x: x["size"].isNotNull())
    none = F.array().cast("array<struct<at:int,end:int,part:int>>")

    def group(xs: Column) -> Column:
        step = lambda acc, x: F.struct((acc["end"] + x["gap"] + x["size"]).alias("end"), F.concat(acc["out"], F.array(F.struct((acc["end"] + x["gap"]).alias("at"), (acc["end"] + x["gap"] + x["size"]).alias("end"), x["part"].alias("part")))).alias("out"))
        return F.aggregate(xs, F.struct(F.lit(0).alias("end"), none.alias("out")), step)

    # Arrays that several functions read go through a lambda variable each, so that they are worked out once.
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    grouped = once(sized, lambda xs: F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(TOGETHER)), lambda i: group(F.slice(xs, i, TOGETHER)))).otherwise(F.array().cast("array<struct<end:int,out:array<struct<at:int,end:int,part:int>>>>")))
    offsets = lambda gs: F.aggregate(gs, F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["end"])))
    moved = lambda gs: F.flatten(F.transform(F.arrays_zip(gs.alias("g"), F.slice(offsets(gs), 1, F.size(gs)).alias("o")), lambda z: F.transform(F.filter(z["g"]["out"], lambda m: m["part"] >= rule.least), lambda m: F.struct((m["at"] + z["o"]).alias("at"), (m["end"] + z["o"]).alias("end")))))
    return F.when(text.rlike(rule.hint or rule.pattern), once(grouped, moved)).otherwise(F.array().cast("array<struct<at:int,end:int>>"))


def _rules_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, kind, version, spans) for each blob of (blob, text) and each rule."""
    found = blobs.select("blob", F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")) for r in rules]).alias("all"))
    return found.select("blob", F.inline("all"))


def update(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """What a scan of (blob, text) rows has to add to the ledger: unseen blob and rule-version pairs only."""
    if ledger is None:
        return scan(versions.groupBy("blob").agg(F.first("text").alias("text")), rules)
    wanted = F.broadcast(_rules_table(versions.sparkSession, rules))  # a row per rule
    seen = ledger.select("blob", "kind", "version").join(wanted, ["kind", "version"], "left_semi")
    whole = seen.groupBy("blob").agg(F.countDistinct("kind").alias("n")).filter(F.col("n") == len(rules))
    unseen = versions.join(whole, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    return scan(unseen, rules).join(seen, ["blob", "kind", "version"], "left_anti")


def address(docs: DataFrame) -> DataFrame:
    """`docs` with `blob`, the SHA-256 of the text, in place of a column of that name; null counts as empty."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2(common.utf8(F.col("text")), 256))


class Ledger:
    """(blob, kind, version, spans) rows in a folder, which grows by what each scan adds."""

    SCHEMA = "blob string, kind string, version int, spans array<struct<at:int,end:int>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        """All rows so far; None before the first scan."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else None

    def extend(self, versions: DataFrame, rules=RULES) -> None:
        """Scans what is unseen of (blob, text) rows; a job that fails adds nothing."""
        update(versions, self.read(), rules).write.mode("append").option("compression", "zstd").parquet(self.path)


def findings(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Columns of `paths` (which has `blob`) with `found`: array of (at, rank, end, kind) for current rules, in order; null where nothing was found.

    A row of `paths` gives a row here, repeated ones too; its other columns are
    kept, whatever their names but `found`.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    rank = order[F.concat_ws(":", "kind", F.col("version").cast("string"))]
    hits = (
        ledger.withColumn("rank", rank)
        .filter(F.col("rank").isNotNull() & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.sort_array(F.flatten(F.collect_list(F.transform("spans", lambda x: F.struct(x["at"].alias("at"), F.col("rank").alias("rank"), x["end"].alias("end"), F.col("kind").alias("kind")))))).alias("found"))
    )
    return paths.join(hits, "blob", "left")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from a ledger that takes documents in by two arrivals; a text is scanned once whatever the number of copies."""
    ledger = Ledger(spark, f"{common.Scratch(spark, 'op6').at}/ledger")
    docs = address(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    arrival = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(2))
    for k in range(2):
        ledger.extend(docs.filter(arrival == k).select("blob", "text"))
    found = findings(docs.select("doc_id", "blob"), ledger.read())
    base = ("assign", "access", "hex")
    tagged = lambda xs: F.coalesce(F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ","), F.lit(""))
    number = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0))
    counts = [F.when(F.col("found").isNull(), 0).otherwise(number(k)).cast("long").alias(f"n_{k}") for k in base]
    based = tagged(F.filter("found", lambda x: x["kind"].isin(*base)))
    return found.select("doc_id", *counts, F.sha2(based.cast("binary"), 256).alias("base_sha256"), tagged(F.col("found")).alias("spans"))
