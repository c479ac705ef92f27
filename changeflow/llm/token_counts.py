"""Token counts of documents from flat token files without an index.

A flat token file is one long run of ids in which an end-of-document id closes
each document. It is kept as the rows of its blocks (file_id, block_no, payload)
of a fixed number of ids, because Spark's writers have no raw binary sink and
nothing but Spark may reach the store. ``scan_blocks`` searches each block for
the separator with one vector comparison and keeps what lies inside it; the
documents that cross blocks are stitched by a prefix scan over the blocks'
summaries, in two levels, so that one huge file isn't one task.

Defined results: a null or empty text counts 0; repeated rows are counted one by
one; an empty table gives no row; columns besides ``doc_id`` and ``text`` are not
read. The separator's string in a text is ordinary text, so a text can't end its
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm import bpe, common

FILE_SCHEMA = "file_id long, block_no long, payload binary, doc_ids array<long>, first_document long"
SCAN_SCHEMA = ("file_id long, block_no long, n_ids long, n_separators long, first_separator long, "
               "last_separator long, inner array<long>")


def width_of(coder: bpe.ByteBPE) -> str:
    """The type of an id in a flat file: two bytes, if all ids of the vocabulary fit."""
    return "<u2" if coder.n_vocab <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, tokenizer: str, separator: str = "<|endoftext|>",
                      block_ids: int = 65_536) -> DataFrame:
    """Flat token files, one per task, in the shared folder. Rows with ``payload``
    are blocks; rows with ``doc_ids`` name the documents in the order written."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, file_id = bpe.load(tokenizer, special=False), TaskContext.get().partitionId()
        width = width_of(coder)
        end = np.array([coder.special_ids[separator]], width).tobytes()
        size = block_ids * len(end)
        held, block_no, written = bytearray(), 0, 0

        def block(payload: bytes) -> pa.RecordBatch:
            return _rows([file_id], [block_no], [payload], [None], [None])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for text in batch.column(1):
                held += np.frombuffer(coder.encode(text.as_py()), "<u4").astype(width).tobytes() + end
                while len(held) >= size:
                    yield block(bytes(held[:size]))
                    del held[:size]
                    block_no += 1
            yield _rows([file_id], [None], [None], [ids], [written])
            written += len(ids)
        if held:
            yield block(bytes(held))

    def _rows(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = pa.schema([("file_id", pa.int64()), ("block_no", pa.int64()), ("payload", pa.binary()),
                        ("doc_ids", pa.list_(pa.int64())), ("first_document", pa.int64())])
    return common.saved(docs.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA), "token-files")


def scan_blocks(blocks: DataFrame, separator_id: int, width: str = "<u2") -> DataFrame:
    """Per block of ids of type ``width``: its ids, its separators, the first's and last's
    place in it, and the lengths of the documents that begin and end between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer(), width)
                at = np.flatnonzero(ids == separator_id)
                rows.append((len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None,
                             np.diff(at) - 1))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 pa.array(cols[4], pa.list_(pa.int64()))],
                names=["file_id", "block_no", "n_ids", "n_separators", "first_separator", "last_separator", "inner"])

    return blocks.select("file_id", "block_no", "payload").mapInArrow(run, SCAN_SCHEMA)


def stitch(scan: DataFrame, block_ids: int, group: int = 1024) -> DataFrame:
    """Document lengths of each file: (file_id, document, n_tokens), documents
    numbered from 0. Blocks are summed up in groups; the groups' prefix sums give
    the number of documents before a block and the last separator before it."""
    b = scan.withColumns({"grp": F.expr(f"block_no div {group}"),
                          "first_abs": F.col("block_no") * block_ids + F.col("first_separator"),
                          "last_abs": F.col("block_no") * block_ids + F.col("last_separator")})
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = b.groupBy("file_id", "grp").agg(F.sum("n_separators").alias("n"), F.max("last_abs").alias("last"))
    over = before("file_id").orderBy("grp")
    groups = groups.select("file_id", "grp", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("docs_before"),
                           F.coalesce(F.max("last").over(over), F.lit(-1)).alias("sep_before"))
    inside = before("file_id", "grp").orderBy("block_no")
    b = b.withColumns({"in_docs": F.coalesce(F.sum("n_separators").over(inside), F.lit(0)),
                       "in_sep": F.coalesce(F.max("last_abs").over(inside), F.lit(-1))})
    b = b.filter("n_separators > 0").join(groups, ["file_id", "grp"])
    first = F.col("first_abs") - F.greatest("in_sep", "sep_before") - 1
    return b.select("file_id", (F.col("in_docs") + F.col("docs_before")).alias("base"),
                    F.posexplode(F.concat(F.array(first), "inner")).alias("pos", "n_tokens")).select(
        "file_id", (F.col("base") + F.col("pos")).alias("document"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, separator: str = "<|endoftext|>",
                 block_ids: int = 65_536) -> DataFrame:
    """(doc_id, file_id, document, n_tokens): writes the flat files, scans them, and
    names each document by the order in which it was written. The separator's id and
    the width of ids are those of the tokenizer's file."""
    coder = bpe.load(tokenizer, special=False)
    files = write_token_files(docs, tokenizer, separator, block_ids)
    counts = stitch(scan_blocks(files.filter("payload is not null"), coder.special_ids[separator], width_of(coder)), block_ids)
    names = files.filter("doc_ids is not null").select(
        "file_id", "first_document", F.posexplode("doc_ids").alias("pos", "doc_id")).select(
        "file_id", (F.col("first_document") + F.col("pos")).alias("document"), "doc_id")
    return names.join(counts, ["file_id", "document"]).select("doc_id", "file_id", "document", "n_tokens")
