"""The registered queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm.alignment import align_documents
from panelmill.llm.bpe import token_digests
from panelmill.llm.collocations import SQL as COLLOCATIONS
from panelmill.llm.collocations import collocations
from panelmill.llm.common import table
from panelmill.llm.embedding_dedup import link_vectors
from panelmill.llm.fingerprints import fingerprint_documents
from panelmill.llm.line_dedup import ALL_LINES, dedup_lines
from panelmill.llm.ngram_join import link_documents
from panelmill.llm.packing import pack_documents
from panelmill.llm.passages import SQL as PASSAGES
from panelmill.llm.passages import repeat_digests
from panelmill.llm.quality import quality_scores
from panelmill.llm.sharding import shard_documents
from panelmill.llm.token_counts import document_token_counts
from panelmill.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lambda spark, d: dedup_lines(table(spark, d, "documents"), ALL_LINES),
    "op2_fingerprints": lambda spark, d: fingerprint_documents(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_embedding_dedup": lambda spark, d: link_vectors(table(spark, d, "embeddings")),
    "op5_sharding": lambda spark, d: shard_documents(table(spark, d, "documents")),
    "op6_token_counts": lambda spark, d: document_token_counts(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 50256
    ),
    "op7_ngram_join": lambda spark, d: link_documents(table(spark, d, "documents")),
    "op8_bpe": lambda spark, d: token_digests(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ),
    "op9_packing": lambda spark, d: pack_documents(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "pipeline": corpus_pipeline.run,
    "op11_alignment": lambda spark, d: align_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "op12_collocations": lambda spark, d: collocations(table(spark, d, "documents")),
    "op13_passages": lambda spark, d: repeat_digests(table(spark, d, "documents")),
    "op10_quality": lambda spark, d: quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
}

SQL: dict[str, str] = {"op12_collocations": COLLOCATIONS, "op13_passages": PASSAGES}
