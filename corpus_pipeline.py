"""Corpus pipeline: documents to packed training sequences, one written table per stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from pyspark.sql import DataFrame, SparkSession

from roomtrace.llm import mixing, near_dedup, packing, quality, secrets
from roomtrace.llm.common import table
from roomtrace.plans.scratch import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labelled rows of all documents that are not held out."""
    net = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(COLUMNS), net)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return near_dedup.keep_one(docs).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs.select(COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix_to_weights(docs.select(COLUMNS), mixing.TARGETS).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; each row of the mix is a document of its own."""
    import public_tokenizers

    return packing.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: The classifier, the signatures, the secret lexer and the tokeniser have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
