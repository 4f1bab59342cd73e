"""A training-corpus pipeline out of five of the llm operators.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import mixing, neardup, packing, pii, quality
from strandweave.llm.common import documents, written

MOST_REPEATS = 1.25


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts have a score like any; repeated rows stay or go together."""
    rows = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_name="_score", predicted_name="_predicted")
    return rows.where("_predicted = 1").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id.

    Rows that repeat a doc_id and its text count once; rows of one doc_id with different texts are one document and stay or go
    together. Rows without a doc_id and documents without words stay.
    """
    kept = neardup.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return one.unionByName(docs.where("doc_id IS NULL"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text (null: null). No row is dropped."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources moved towards even weights by repeating small ones: the budget is what keeps every document of the largest.

    No document is dropped; a document of a small source is there once or twice. A null source is a source of its own; all columns stay as they are.
    """
    rows = mixing.copies(docs, budget_share=None, most_repeats=MOST_REPEATS, whole_rows=True)
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens filled with lexical neighbours, as pieces. Null and empty texts are the single id 1; copies are packed each."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("near duplicates", one_of_each), ("personal data", redact_personal), ("mixing", mix), ("packing", pack)]

#: SQL cannot train the classifier or tokenise; the tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
