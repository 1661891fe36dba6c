"""The corpus pipeline. Each stage reads the documents that its predecessor kept and written as Parquet.

Toxic documents go; of every group of near duplicates one document stays; documents that overlap with a benchmark go;
personal data in the texts is generalised; what is left is encoded. All stages but the last return the columns of
documents.

For every stage: null texts are read as empty ones and stay null; empty texts stay; long texts are read whole; columns
besides doc_id and text pass unchanged, whatever their names; an empty table gives no rows. Each stage's docstring says
what becomes of ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.bpe import encode_documents
from windrow.llm.common import delete, scratch, table
from windrow.llm.decontamination import decontaminated
from windrow.llm.ngram_join import one_of_each
from windrow.llm.pii import sanitise
from windrow.llm.toxicity import fit, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the grammar is learnt from the labels of the documents given.

    Repeated rows go or stay together. A score of exactly one half goes.
    """
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group linked at 0.8 over five-word shingles.

    Of rows of equal doc_id and text one stays; null and empty texts are linked with nothing. Rows without doc_id come last.
    """
    return one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item. Repeated rows go or stay together."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text generalised to its kind; n_chars is the new text's length.

    Repeated rows are changed alike; overlapping spans are replaced as one, by the kind of the first.
    """
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, for every row; of null texts there are no tokens."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("pii", pii), ("bpe", bpe)]
#: Learnt scores and byte-level merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every stage but the last is written to the shared folder and read again.

    A stage's output is deleted once the next stage's is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
