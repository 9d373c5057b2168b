"""Intermediate tables in the shared folder, global ranks and exact selections without a global sort in one task."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A broadcast table takes some times its bytes on the driver.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one for a single-machine session, an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("namewell.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="namewell-")
        spark.conf.set("namewell.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, width: int = 100) -> DataFrame:
    """``df`` marked for broadcast where its counted ``rows`` of about ``width`` bytes are few, else marked for a shuffle: files are small beside the rows that they hold."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df.hint("shuffle_merge")


def ranked(df: DataFrame, keys: list[str], into: str = "ord") -> DataFrame:
    """``df`` with the 0-based rank of each row in the order of ``keys``: one range shuffle, of each partition one number on the driver."""
    made = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    start, at = [], 0
    for r in made.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        start.append((r["_part"], at))
        at += r["n"]
    offsets = made.sparkSession.createDataFrame(start, "_part int, _start long")
    # a partition's ids count from its number shifted by 33 bits
    return made.join(F.broadcast(offsets), "_part").withColumn(into, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_start")


def rank_groups(df: DataFrame, digest: Column, tie: Column, cuts: list[int], into: str) -> DataFrame:
    """``df`` with the number of ``cuts`` that the row's 0-based rank by (digest, tie) reaches; ``digest`` is a hexadecimal string.

    Rows are counted by the digest's first four digits (65,536 counts on the driver); only the rows of the few digits in
    which a cut falls are ranked.
    """
    marked = df.withColumn("_d", digest).withColumn("_b", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))
    counts = {r["_b"]: r["count"] for r in marked.groupBy("_b").count().collect()}
    start, at = {}, 0
    for b in sorted(counts):
        start[b] = at
        at += counts[b]
    inside = {b for b in counts for c in cuts if start[b] < c < start[b] + counts[b]}
    reach = lambda first: sum(c <= first for c in cuts)
    edges = sorted(counts)
    whole = F.lit(0)
    for c in range(1, len(cuts) + 1):  # the first digit group whose start reaches c cuts
        b = next((b for b in edges if reach(start[b]) >= c), None)
        if b is not None:
            whole = F.when(F.col("_b") >= b, c).otherwise(whole)
    plain = marked.where(~F.col("_b").isin(*inside) if inside else F.lit(True)).withColumn(into, whole)
    if inside:
        n = F.row_number().over(Window.partitionBy("_b").orderBy("_d", tie)) - 1
        first = F.coalesce(*[F.when(F.col("_b") == b, F.lit(start[b])) for b in sorted(inside)])
        part = marked.where(F.col("_b").isin(*inside)).withColumn("_n", n + first)
        part = part.withColumn(into, sum((F.when(F.col("_n") >= c, 1).otherwise(0) for c in cuts), F.lit(0))).drop("_n")
        plain = plain.unionByName(part)
    return plain.drop("_d", "_b")


def enumerate_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """``lines`` (file, block, value) numbered within (file, block) in the order in which tasks read them, blank values left out: (columns, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            pos = np.zeros(b.num_rows, np.int64)
            for i, k in enumerate(keys):
                pos[i] = seen.get(k, 0)
                seen[k] = pos[i] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos)], names=[*columns, "pos"])

    kinds = dict(lines.dtypes)
    return lines.select(*columns).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", pos long")
