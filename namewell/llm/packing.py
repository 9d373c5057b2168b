"""Packing along a space-filling curve.

Words of a document are hashed into a signed vector of ``width`` counts (square-rooted), brought to unit length and
projected on ``dims`` fixed orthonormal directions; the grid point's Hilbert key orders the corpus by one range sort.
Documents are then laid end to end along the curve and the line is cut every ``capacity`` words, so that each pack but
the last is full and holds neighbours.  A document that a cut meets continues at the start of the next pack.

Result: (doc_id, pack_id, slot, doc_start, length, hilbert): one row a piece; ``slot`` is the piece's first word in its pack.
Null and word-less texts give no piece.  Null ids are kept as null.  Repeated rows are packed as often as they come, ties
on the key go by id.  Very long texts are read whole and cut as the line is.  An empty table gives no row; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text, ranked
from .hilbert import axes, hilbert_key, quantise
from .textkernel import words_of

CAPACITY, WIDTH, DIMS, BITS, SEED = 4096, 256, 4, 15, 11


def curve_keys(texts: pa.Array, width: int = WIDTH, dims: int = DIMS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(Hilbert keys, word counts) of texts."""
    w = words_of(texts)
    n = len(w.bounds) - 1
    cell = w.doc_of_word() * width + (w.hash % np.uint64(width)).astype(np.int64)
    sign = 1.0 - 2.0 * ((w.hash >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    v = np.bincount(cell, sign, n * width).reshape(n, width)
    v = np.sign(v) * np.sqrt(np.abs(v))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    # a projection of a unit vector rarely leaves 4 standard deviations
    return hilbert_key(quantise(v @ axes(width, dims, SEED), bits, reach=4 / np.sqrt(width)), bits).astype(np.int64), w.counts


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        key, count = curve_keys(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array(count.astype(np.int64))], names=["doc_id", "hilbert", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    line = ranked(map_text(rows, "text", keyed, "doc_id long, hilbert long, n long").where("n > 0"), ["hilbert", "doc_id", "n"], "n")
    first, last = F.expr(f"_at div {capacity}"), F.expr(f"(_at + n - 1) div {capacity}")
    pieces = line.select("*", F.explode(F.sequence(first, last)).alias("pack_id"))
    begin, end = F.greatest(F.col("_at"), F.col("pack_id") * capacity), F.least(F.expr("_at + n"), (F.col("pack_id") + 1) * capacity)
    return pieces.select("doc_id", "pack_id", (begin - F.col("pack_id") * capacity).alias("slot"), (begin - F.col("_at")).alias("doc_start"), (end - begin).alias("length"), "hilbert")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
