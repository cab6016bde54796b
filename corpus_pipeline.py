"""The corpus pipeline: language ID, near-duplicates, decontamination, surrogates, packing.

Each stage gets what its predecessor kept, written as Parquet and read again; all but the last return the columns of
documents, and columns of other names as they are. An empty table stays empty through all stages. Rows that repeat are
treated alike by each stage but the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, langid, neardup, packing, pii
from marlstone.llm.queries import PII_KEY, table
from marlstone.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts are such), or of no learned language by their trigrams, go. A text of
    any length is judged whole; a null lang teaches nothing and is no reason to go."""
    return langid.keep_known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; of rows that repeat it, one. Texts without words
    are no one's copies. A null id stays only where its class has no other."""
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go, wherever in the text it is; null and empty texts have none and stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; every document stays, null and empty texts as they are. n_chars follows the text."""
    from pyspark.sql import functions as F

    out = pii.replace(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence. A null or empty text is its end token alone; only a document
    longer than a sequence is cut; of equally full sequences any may be taken."""
    return packing.pack(docs)


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("surrogates", surrogates), ("pack", pack)]

#: The classifier, the signatures and the tokenizer have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
