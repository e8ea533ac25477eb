"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import near_duplicates, packing, personal_data, quality_rules, toxicity
from flowgauge.llm.workers import import_on_workers
from flowgauge.session import scratch_path


def _judged(docs: DataFrame) -> DataFrame:
    """What an operator may see: the text, beside all other columns in one, which thus cannot clash with new ones."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), "text")


def _restored(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` in their order; if the text is another, so is its length."""
    changed = {"text": F.col(text)} | ({"n_chars": F.length(text).cast("long")} if text != "text" else {})
    return found.select(*(changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; rows and texts of the others are unchanged.

    Null, empty and blank texts have no severity and stay, repeated rows are judged alike, an empty table gives an empty table.
    """
    import_on_workers(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(toxicity.score(_judged(docs), model).where("NOT toxic"), docs)


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines.

    Null and empty texts, having under 20 words, go; repeated rows are judged alike; an empty table gives an empty table.
    """
    return _restored(quality_rules.quality_rules(_judged(docs)).where("kept"), docs, "clean_text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near duplication, the one with the smallest id, null ids last.

    Rows are told apart by a number of their own, so different texts with equal or null ids all stay, and of repeated rows one
    does. Null and empty texts are linked with nothing and stay; an empty table gives an empty table.
    """
    import_on_workers(spark)
    path = scratch_path(spark, "numbered")
    packed_rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    packed_rows.withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    found = near_duplicates.near_duplicates(spark, numbered.select(F.col("number").alias("doc_id"), "row.text"))
    ids = numbered.select("number", F.col("row.doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "number"))["number"]
    chosen = found.join(ids, found["doc_id"] == ids["number"]).groupBy("component_id").agg(first.alias("number"))
    return numbered.join(chosen, "number", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def masked_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; null and empty texts stay as they are."""
    import_on_workers(spark)
    return _restored(personal_data.personal_data(_judged(docs)), docs, "masked_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a training sequence; a null or empty text is its closing id alone."""
    import_on_workers(spark)
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality_rules", good_lines),
    ("near_duplicates", one_of_each_group),
    ("personal_data", masked_personal_data),
    ("packing", packed),
]

#: The severity model and the tokenizer cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of a folder; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
