"""A corpus pipeline of five stages, from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read back as the next stage's documents. All stages but the
last return the columns of documents. Rows are matched by doc_id and a hash of
what the stage looks at, so that rows with a null doc_id, and different texts
under one doc_id, are kept apart from each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common, decontam, mixing, neardup, quality, tokens

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.5
#: Rows of ids (with a count) that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: The same for rows of ids and row keys.
BROADCAST_KEYED = 1_000_000


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, which is already written, as a broadcast side if its rows allow."""
    return F.broadcast(df) if df.count() <= most else df


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a classifier of labelled quality rejects.

    A null text counts as empty and is scored like any other; very long texts
    are scored whole. Rows that repeat, or have no id, are judged one by one;
    equal texts have equal scores, and a score of LEAST_QUALITY is kept. Without
    labels nothing is learned, every score is 0.5, and all documents stay. An
    empty table gives an empty one. All columns of `docs` are kept, whatever
    their names.
    """
    weights = quality.train(quality.labelled(docs, common.read(spark, sf_dir, "labels")))
    return quality.scored(docs, weights).filter(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of near-duplicates; of rows that repeat an id and its text, one.

    Texts that are null or without words are alike to none, so their rows stay,
    and so do rows without an id. Different texts under one id are different
    documents; of equal ids the smaller text hash comes first. An empty table
    gives an empty one.
    """
    scratch = common.Scratch(spark, "near-dedup")
    again = scratch.keep(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        found = scratch.keep(neardup.near_duplicates(docs, scratch), "components")
        gone = scratch.keep(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
        return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)

    # An id that repeats does not name a text, so every id and text gets a number of its own; null ids get none, and stay.
    keyed, few = docs.withColumn("__row", common.row_key("text")), _small(again)
    keyed = keyed.join(few, "doc_id", "left_anti").unionByName(keyed.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "__row"]))
    numbers = keyed.filter("doc_id is not null").select("doc_id", "__row").withColumn("__number", F.monotonically_increasing_id())
    numbers = scratch.keep(numbers, "numbers")
    numbered = scratch.keep(keyed.join(_small(numbers, BROADCAST_KEYED), ["doc_id", "__row"], "left"), "numbered")
    found = scratch.keep(neardup.near_duplicates(numbered.select(F.col("__number").alias("doc_id"), "text"), scratch), "components")
    parts = found.filter("doc_id is not null").select(F.col("doc_id").alias("__number"), "component_id")
    first = parts.join(numbers, "__number").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row", "__number")).alias("first"))
    gone = scratch.keep(parts.join(first.select("first.__number"), "__number", "left_anti").select("__number"), "gone")
    return numbered.join(_small(gone), "__number", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item.

    Items of fewer than five words are searched as they are; null or empty
    items, and texts, match nothing. Rows are told apart by id and text, so of
    documents that share an id, or have none, only those that hold an item go;
    of equal rows all go or stay. An empty table of items removes nothing.
    """
    scratch = common.Scratch(spark, "decontamination")
    found = scratch.keep(decontam.held(docs, common.read(spark, sf_dir, "benchmark")), "found")
    return decontam.without(docs, _small(found, BROADCAST_KEYED)).select(*docs.columns)


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their targets; a document occurs once for each copy taken.

    A null source is a source of its own. Documents without words have no part
    in a target and are dropped. Ties of size are in order of a hash of id and
    text; equal rows are one document that is repeated for all of them. An
    empty table gives an empty one.
    """
    scratch = common.Scratch(spark, "mixing")
    row = common.row_key(*docs.columns)
    mixed = mixing.mix(docs.withColumn("__row", row), scratch, keys=("__row",)).groupBy(F.col("doc_id").alias("__taken"), F.col("__row").alias("__taken_row"))
    copies = scratch.keep(mixed.agg(F.sum("copies").alias("__copies"), (F.count("*") > 1).alias("__again")).filter("__copies > 0"), "copies")
    taken = docs.join(_small(copies, BROADCAST_KEYED), F.col("doc_id").eqNullSafe(F.col("__taken")) & (row == F.col("__taken_row")))
    if not copies.filter("__again").isEmpty():  # equal rows: one of them is repeated for all
        taken = taken.filter("not __again").unionByName(taken.filter("__again").dropDuplicates(docs.columns))
    return taken.withColumn("__copies", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files, and returns every document's place in them.

    A null or empty text is its end id alone. Documents are in the order of
    ids, null first; equal ids, such as copies from mixing, in the order of
    a hash of their text. An empty table gives no rows and no tokens.
    """
    return tokens.token_table(docs, f"{common.Scratch(spark, 'token-output').at}/ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", minhash_near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mixing_to_target_weights),
    ("token output", token_output),
]

#: The stages need a fitted classifier, sketches and a tokenizer; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
    return docs
