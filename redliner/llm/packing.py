"""Packing documents into fixed windows of tokens: concatenate and cut.

Pass 1 encodes every document once and writes the ids with the document's offset inside its input
segment (a split of a file, or a partition where rows come from no file).  The segments' token totals,
one row for each segment, are summed up to global segment offsets.  Pass 2 adds a document's two offsets
and cuts it at the multiples of the window: a document inside one window is one piece, a document over
a boundary has a piece on either side.  Segments follow the order of file names and of rows in a file,
so an order given to the input by an earlier stage is the order of the packed stream.

The segment totals are a written table, one row for each input split; their sums run over one ordered task,
which is bounded by the number of splits, not of rows.  At most ``BROADCAST_SEGMENTS`` of them (a path and three numbers each)
are broadcast to the rows; more are joined by shuffle.

Defined results: a null or empty text is its end id alone; every row is packed, repeated rows and equal or
null ids too; texts of any length are cut wherever windows end; an empty table gives no pieces; other
columns are not read, so their names cannot clash.  Only the last sequence can be short: it is to be padded
to the window unless its length is a power of two.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redliner.llm.common import TEXT_ROWS, Staged
from redliner.llm.tokens import encoder as worker_encoder
from redliner.llm.tokens import tokenizer_path

BROADCAST_SEGMENTS = 20_000
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.input_file_name().alias("file"),
        F.expr("input_file_block_start()").alias("block"),
    )


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """Pass 1: ``(file, block, part, doc_id, at, ids)``, ``at`` the offset in the segment."""

    def run(batches):
        encoder, context = worker_encoder(path), TaskContext.get()
        part, segment, at = context.partitionId() if context else 0, None, 0
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            ids, offsets = [], []
            files, blocks = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for text, where in zip(batch.column(1).cast(pa.binary()).to_pylist(), zip(files, blocks, strict=True), strict=True):
                if where != segment:
                    segment, at = where, 0
                own = encoder.encode(text) + end
                ids.append(own)
                offsets.append(at)
                at += len(own) // encoder.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    batch.column(3),
                    pa.array([part] * len(ids), pa.int32()),
                    batch.column(0),
                    pa.array(offsets, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64()),
                ],
                names=["file", "block", "part", "doc_id", "at", "ids", "n"],
            )

    try:
        rows = _located(docs, id_col, text_col)
    except AnalysisException:  # rows of several tables have no file of their own; a written table's rows have
        rows = _located(Staged(docs.sparkSession, "packing-in").put(docs.select(id_col, text_col)), id_col, text_col)
    return rows.mapInArrow(run, "file string, block long, part int, doc_id long, at long, ids binary, n long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    path: str | None = None,
) -> DataFrame:
    """One row for each piece of a document; ``start`` counts the document's ids before the piece."""
    path = path or tokenizer_path()
    staged = Staged(docs.sparkSession, "packing")
    table = staged.put(encoded(docs, id_col, text_col, path, end_id), batch_rows=TEXT_ROWS)
    key = ["file", "block", "part"]
    totals = staged.put(table.groupBy(*key).agg(F.max(F.col("at") + F.col("n")).alias("total")))
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*key, F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    if totals.count() <= BROADCAST_SEGMENTS:
        bases = F.broadcast(bases)
    placed = table.join(bases, key).select("doc_id", (F.col("at") + F.col("base")).alias("at"), "ids", "n")

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width, start = len(ids) // n, 0
                while start < n:
                    offset = at % window
                    length = min(window - offset, n - start)
                    piece = np.frombuffer(ids, f"<u{width}", length, start * width).astype("<u4")
                    for column, value in zip(
                        out, (doc, start, length, zlib.crc32(piece.tobytes()), n, at // window, offset), strict=True
                    ):
                        column.append(value)
                    at, start = at + length, start + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(cut, PIECES)
