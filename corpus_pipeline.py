"""A corpus pipeline of four stages. Each works on all that the one before it kept, and returns the columns of documents; the last packs."""

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import near_copies, packing, quality, toxicity
from logweave.llm.common import cut_lineage, held_out, table

#: Neither a forest, nor a network, nor XXH64 fingerprints, nor a plan for packing can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rules and the forest keep. Rows are judged one by one: repeated ids, null ids and null texts are like any others."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that aren't predicted toxic, judged one by one; learned from the rows of docs that aren't held out. Texts without words stay."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    return toxicity.clean_rows(docs, docs.filter(~held_out("doc_id", 3, 1)), labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more. Rows that agree in doc_id and text are one
    document; null and empty texts are copies of each other, and one of them stays."""
    return near_copies.without_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences, as packing.pack gives them. Repeated rows are packed each; null texts have the end id alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("SimHash near-dedup", near_duplicates), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
