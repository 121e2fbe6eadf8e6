"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import kept_in_worker, plain, table
from roomtrace.llm.vocabulary import Encoder, parted

#: Bytes of text handed to the library together.
BATCH_BYTES = 1 << 20


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, one narrow pass.

    Batches hold about ``batch_bytes`` of text whatever the number of rows; a longer text goes through in parts cut where
    no token can cross.  Null and empty texts have 0 tokens.  Null ids, repeated ids and repeated rows each keep their own
    row.  Other columns are not read, so their names cannot clash.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches):
        encoder = kept_in_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))
        for batch in batches:
            texts = plain(batch.column(1))
            tokens = np.zeros(len(texts), dtype=np.int64)
            for first, some, part in parted(texts, batch_bytes):
                tokens[first : first + len(some)] += encoder.lengths(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens)], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def op10_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """Tokens of every document under the lower-casing word vocabulary."""
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
