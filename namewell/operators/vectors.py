"""Vector providers: deterministic stub vectors and the encoder's forward pass, over Arrow batches."""

import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewell.operators.tables import cut


def source_text(title, abstract):
    """``title [SEP] abstract``, or the one of them that is there; null and blank ones are not."""
    return F.concat_ws(" [SEP] ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(abstract), F.lit("")))


def stub_vector(text: str, size: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(size).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-12)


def stub_vectors(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(text, vector) of every different text: one unit vector each, the same on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            made = [stub_vector(t, size).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(made, pa.list_(pa.float32()))], names=["text", "vector"])

    return df.select(F.col(text_col).alias("text")).where("text is not null").distinct().mapInArrow(run, "text string, vector array<float>")


def with_vectors(mentions: DataFrame, vectors: DataFrame, key: str = "canonical_record_id", into: str = "vector") -> DataFrame:
    """``mentions`` with the vector of their record (many to one); a mention whose record has none is an error."""
    lost = mentions.join(vectors.select(key), key, "left_anti").select(key).limit(5).collect()
    if lost:
        raise ValueError(f"records without a vector: {[r[0] for r in lost]}")
    return mentions.join(vectors.select(key, F.col("vector").alias(into)), key)


def features(name_vector: str = "name_vector", text_vector: str = "text_vector"):
    """Both vectors in one; null if either is."""
    return F.concat(F.col(name_vector), F.col(text_vector))


def cached(spark: SparkSession, path: str, size: int, rows: int, make) -> DataFrame:
    """The vectors (key, vector) stored at ``path``, or ``make()`` and stored anew where they cannot be read, are not ``rows`` or not of ``size`` parts; the latter with a warning."""
    try:
        found = spark.read.parquet(path)
        r = found.agg(F.count("*").alias("n"), F.count_if(F.col("vector").isNull() | (F.size("vector") != size)).alias("bad")).first()
        if r["n"] == rows and not r["bad"]:
            return found
        warnings.warn(f"vectors at {path}: {r['n']} rows, {r['bad']} unusable; made anew", stacklevel=2)
    except AnalysisException as gone:
        warnings.warn(f"vectors at {path} cannot be read ({gone}); made anew", stacklevel=2)
    made = cut(make(), "vectors")
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_weights(path: str, name_size: int, text_size: int) -> dict[str, np.ndarray]:
    """The encoder's weights w1, b1, w2, b2 of an .npz file, with their sizes checked."""
    with np.load(path) as f:
        w = {k: f[k] for k in ("w1", "b1", "w2", "b2")}
    if w["w1"].shape[1] != name_size + text_size or w["w1"].shape[0] != len(w["b1"]) or w["w2"].shape != (len(w["b2"]), len(w["b1"])):
        raise ValueError(f"weights of sizes {[(k, v.shape) for k, v in w.items()]} do not fit vectors of {name_size} and {text_size}")
    return w


def by_length(df: DataFrame, text_col: str, parts: int | None = None) -> DataFrame:
    """``df`` in partitions sorted by the text's length, so that a model's batches hold texts of like length."""
    near = df.repartition(parts) if parts else df
    return near.sortWithinPartitions(F.length(text_col), text_col)


def encode(df: DataFrame, id_col: str, vector_col: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(id, vector): two linear layers, each followed by SELU, brought to unit length; ``weights`` has w1, b1, w2, b2 and goes to the tasks once."""
    sent = df.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float32) for k, v in weights.items()})
    kind = dict(df.dtypes)[id_col]

    def selu(x: np.ndarray) -> np.ndarray:
        return 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).to_pylist(), np.float32)
            y = selu(selu(x @ w["w1"].T + w["b1"]) @ w["w2"].T + w["b2"])
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "vector"])

    return df.select(F.col(id_col), F.col(vector_col)).where(F.col(vector_col).isNotNull()).mapInArrow(run, f"id {kind}, vector array<float>")
