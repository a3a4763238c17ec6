"""Documents to packed training sequences: language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Null ids and texts, repeated rows, empty tables and extra columns are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.lang_id import identify, train
from tessera.llm.minhash import near_duplicates
from tessera.llm.packing import digest_pieces, pack
from tessera.llm.secret_scan import redact
from tessera.llm.token_counts import default_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages; those without letters or far from every language go."""
    docs = docs.select(*COLUMNS)
    return identify(docs, train(docs), tuple(c for c in COLUMNS if c != "text"), with_text=True).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8); of rows with equal doc_id and text one."""
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs, k=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("of")).distinct()
    one = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("of"), "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds."""
    return redact(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return digest_pieces(pack(docs.select(*COLUMNS), default_tokenizer()))


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("secrets", secrets), ("packing", packing)]
#: No stage but the third is expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else materialise(docs, f"stage-{i}"), sf_dir)
    return docs
