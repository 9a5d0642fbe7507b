"""Token counts of documents in flat token files without an index: a vectorised search for separators, block by block."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.llm.bpe import encoding
from panelmill.llm.common import slices
from panelmill.session import cut_lineage, shared_folder

#: Tokens per block, the unit of work of the scan.
BLOCK_TOKENS = 1 << 21


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end: int, width: int = 2) -> DataFrame:
    """Write the ids of all texts, each followed by ``end``, as flat little-endian unsigned files; one file per task.

    Returns the stored manifest file, size (bytes), ordinal (0, 1, ... in the file), doc_id. A file's name holds the attempt, and only files
    of the attempts that Spark committed are in the manifest, so a repeated task does no harm. ``folder`` is any place that
    Arrow's file systems open from all tasks. NULL texts are empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, coder = TaskContext.get(), encoding(path, pattern)
        store, place = pafs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name = f"tokens-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        ids: list[pa.Array] = []
        size = 0
        with store.open_output_stream(f"{place}/{name}") as out:
            for part, texts in slices(batches):
                for text in texts:
                    data = np.array([*coder.encode_ordinary(text), end], f"<u{width}").tobytes()
                    out.write(data)
                    size += len(data)
                ids.append(part.column(0))
        doc_ids = pa.concat_arrays(ids) if ids else pa.array([], pa.int64())
        n = len(doc_ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"] * n, pa.string()), pa.array(np.full(n, size)), pa.array(np.arange(n)), doc_ids], ["file", "size", "ordinal", "doc_id"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(rows.mapInArrow(write, "file string, size long, ordinal long, doc_id long"))


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """file and size of all files of a folder; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def count_tokens(files: DataFrame, end: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start (token place of the first id), n_tokens (without the separator), terminated.

    ``files``: file and size. Files are cut into blocks of ``block_tokens``, which are read and searched apart; a document may span any
    number of blocks. A prefix scan over the blocks of a file gives each the documents before it and the last separator
    before it. What follows the last separator is a document that is not terminated; nothing follows: no document. An empty
    file has none. A size that is no multiple of ``width`` raises. Repeated files are scanned once.
    """
    kind = f"<u{width}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size % width:
                    raise ValueError(f"{file} has {size} bytes, no multiple of {width}")
                store, place = pafs.FileSystem.from_uri(file)
                begin = block * block_tokens
                with store.open_input_file(place) as data:
                    data.seek(begin * width)
                    raw = data.read(min(block_tokens * width, size - begin * width))
                ends = np.flatnonzero(np.frombuffer(raw, kind) == end) + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([size // width]), pa.array([block]), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "tokens", "block", "ends"]
                )

    blocks = files.where("size > 0").select("file", "size").distinct()
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block_tokens * width}"))))
    found = cut_lineage(blocks.repartition("file", "block").mapInArrow(scan, "file string, tokens long, block long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry")
    )
    ended = found.join(carried, ["file", "block"]).select("file", "docs_before", "carry", "ends", F.posexplode("ends").alias("i", "end"))
    previous = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1))
    ended = ended.select(
        "file", (F.col("docs_before") + F.col("i")).alias("ordinal"), (previous + 1).alias("start"), (F.col("end") - previous - 1).alias("n_tokens"), F.lit(True).alias("terminated")
    )
    totals = found.groupBy("file").agg(F.max("tokens").alias("tokens"), F.sum(F.size("ends")).alias("docs"), F.max(F.array_max("ends")).alias("last"))
    rest = totals.withColumn("start", F.coalesce(F.col("last") + 1, F.lit(0))).where("start < tokens")
    return ended.union(rest.select("file", "docs", "start", F.col("tokens") - F.col("start"), F.lit(False)))


def document_token_counts(docs: DataFrame, path: str, pattern: str, end: int) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, start of every document, counted in flat files that are written first.

    The files stay in the shared folder, like all stored intermediates.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/panelmill/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, path, pattern, end)
    counted = count_tokens(manifest.select("file", "size"), end)
    joined = manifest.join(counted, ["file", "ordinal"])
    return joined.select("doc_id", "n_tokens", F.regexp_extract("file", r"tokens-(\d+)-", 1).cast("int").alias("file"), "ordinal", "start")
