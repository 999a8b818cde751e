"""Documents to packed sequences: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.llm import best_fit_packing, near_dedup, quality_classifier, quality_rules, secret_scan
from panelweave.llm.text import GAP_CHARS
from panelweave.plans.staging import stage
from panelweave.session import ship


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, without the lines that fail them; blank lines stay. Null and blank texts do not
    pass. Rows are judged one by one, repeated ones alike, and keep all their columns, whatever these are called; an empty
    table gives an empty table."""
    ship(spark)
    return quality_rules.cleaned(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good, as they are. A null text is judged as an empty one, and
    rows without doc_id like others (they have no label); repeated rows are judged alike; columns may have any name; an
    empty table gives an empty table."""
    ship(spark)
    return quality_classifier.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


NEAR_PERCENT = 80  # the rule for stages: five words, a similarity of 0.8 or more


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more on five words): the one with the smallest doc_id.

    A document is a doc_id with a text. Of an id with several texts, one (not blank, if any is) stands under the id itself and
    the others come after all ids, so each stays unless it resembles a document before it. Rows that repeat id and text are
    one document; the one whose other columns come first as JSON stays. Rows without doc_id, and documents without words,
    stay. Other columns may have any name and type; an empty table gives an empty table."""
    ship(spark)
    blank = F.translate(F.coalesce("text", F.lit("")), GAP_CHARS, "") == ""
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), "text"
    ).select("row", "id", "text", F.struct(blank.alias("blank"), F.xxhash64("text").alias("h")).alias("by"))
    several = keyed.filter("id IS NOT NULL").groupBy("id").agg(F.min("by").alias("lo"), F.max("by").alias("hi")).filter("lo <> hi")
    several = stage(several.select("id", "lo"), "several")
    if several.isEmpty():
        keyed = keyed.select("row", "text", F.col("id").alias("key"))
    else:
        most = keyed.agg(F.max("id")).first()[0] or 0
        later = F.lit(most) + 1 + F.pmod(F.xxhash64("id", "by.h"), F.lit(max((1 << 63) - 2 - most, 1)))
        keyed = keyed.join(several, "id", "left").select(
            "row", "text", F.when(F.col("lo").isNull() | (F.col("by") == F.col("lo")), F.col("id")).otherwise(later).alias("key")
        )
    judged = stage(near_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), percent=NEAR_PERCENT), "judged")
    dropped = judged.filter("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    again = judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("key"))
    again = stage(again, "again")
    left = keyed.join(dropped, "key", "left_anti").select("row", "key")
    if again.isEmpty():
        return left.select("row.*")
    once = left.join(again, "key", "left_anti").select("row.*")
    first = left.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(first)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret. A null text stays null, repeated rows stay, columns may have any
    name; an empty table gives an empty table."""
    ship(spark)
    return secret_scan.redacted(docs)


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the packed sequences. A null or empty text is a piece of one end token;
    rows without doc_id and repeated rows are packed like others; further columns are ignored; an empty table gives an empty
    table."""
    ship(spark)
    return best_fit_packing.packed_documents(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

# A compression classifier and a tokenizer cannot be said in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
