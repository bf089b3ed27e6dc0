"""The corpus pipeline: documents in, packed sequences out, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, line_frequency, packing, pseudonyms, size_aware_join
from tallyspark.llm.common import table
from tallyspark.llm.queries import QUERY_KEY, vocabulary
from tallyspark.session import stage_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: sets of five-word shingles with a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _as_documents(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines."""
    return _as_documents(line_frequency.judge(docs, carry=["lang", "source"]).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: the one with the least id. Rows without id all stay."""
    classes = size_aware_join.join_classes(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    # Joined on the id, rows of one id lie together, so repeated rows go without a shuffle.
    kept = docs.join(first, "doc_id").dropDuplicates(["doc_id"]).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    found = decontaminate.contaminated(docs, table(spark, folder, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data."""
    return _as_documents(pseudonyms.pseudonymise(docs, QUERY_KEY, carry=["lang", "source"]))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary(), with_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("best-fit packing", packed),
]

#: Keyed pseudonyms and a tokenizer's ids cannot be expressed in SQL; the run is tested against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES:
        path = stage_path(spark, name.replace(" ", "-"))
        step(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
