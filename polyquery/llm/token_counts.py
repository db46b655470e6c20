"""Token counts by the whole-token shortcut (see pieces.TokenCounter)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyquery.llm.pieces import TokenCounter
from polyquery.llm.shared import documents, ready
from polyquery.llm.words import text_bytes


@lru_cache
def counter(model: str, proof: tuple[bool, bytes] | None = None) -> TokenCounter:
    return TokenCounter(model, proof)


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, repeated rows included.

    A null text counts as empty: 0 bytes and 0 tokens. A null id stays null. Other columns of docs,
    whatever their names, play no part. An empty table gives an empty table.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    proof = counter(model).proof

    def run(batches):
        count = counter(model, proof)
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            n = count.counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)
