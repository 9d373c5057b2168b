"""What the corpus operators share: intermediate tables, Arrow mapping, ranks and components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import by_bytes

#: Bytes (counted rows times the width that the caller states) up to which one side of a join is broadcast.
BROADCAST_BYTES = 128 << 20
#: Rows that Spark hands to Python at once: texts are long, and a batch lives in both processes.
ARROW_ROWS = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with the row limit of Arrow batches under which every operator here runs, whichever ran before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset, a temporary one for a single-machine session (tests), an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("namewell.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="namewell-")
        spark.conf.set("namewell.dir", known)
    return known.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = 1 << 21) -> DataFrame:
    """``fn`` over slices of about ``limit`` bytes of the column ``text``; no row is ever split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text, limit):
                yield fn(part)

    prepared(df.sparkSession)
    return df.mapInArrow(run, schema)


def join_by_size(left: DataFrame, right: DataFrame, rows: int, on: object, how: str, width: int = 64) -> DataFrame:
    """Broadcast ``right`` only while its counted ``rows`` of about ``width`` bytes are few; beyond that a shuffle join that adaptive execution splits by skew."""
    return left.join(F.broadcast(right) if rows * width <= BROADCAST_BYTES else right, on, how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores in front until ``df`` has no such column (names are compared as Spark does, without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def ranked(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """``df`` in the order of ``keys`` with the column ``_at``: how many rows (or how much ``weight``) precede in the whole table.

    One range shuffle. Only one number a partition goes through the driver; rows that tie on every key are ordered arbitrarily.
    """
    made = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranked")
    sums = made.groupBy("_part").agg(F.sum(weight or F.lit(1)).cast("long").alias("n")).collect()
    start, at = {}, 0
    for r in sorted(sums, key=lambda r: r["_part"]):
        start[r["_part"]] = at
        at += r["n"] or 0
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file split holds whole row groups of one partition's file; sort order inside a file is kept by the reader
        seen: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(b.schema.get_field_index("_part")).to_numpy()
            w = np.ones(b.num_rows, np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.zeros(b.num_rows, np.int64)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                c = np.cumsum(w[rows])
                at[rows] = seen.get(p, start[p]) + c - w[rows]
                seen[p] = int(seen.get(p, start[p]) + c[-1])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(at)], names=[*columns, "_at"])

    whole = made.repartition(max(1, len(start)), "_part").sortWithinPartitions("_part", *keys)
    return whole.mapInArrow(run, df.withColumn("_at", F.lit(0).cast("long")).schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component of ``edges(a, b)``, over nodes that an edge names.

    Minimum labels with pointer jumping; each round is written to the shared folder. Empty edges give no row.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("best"))
        step = label.join(near, label.node == near.a).select("node", F.least("root", "best").alias("root"), F.col("root").alias("was"))
        step = cut(step, "labels")
        jump = step.alias("x").join(step.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("root") == F.col("n2"), "left")
        done = cut(jump.select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"), "labels")
        changed = done.where("root <> was").limit(1).count()
        label = done.select("node", "root")
        if not changed:
            return label
