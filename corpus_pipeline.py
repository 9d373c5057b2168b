"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go, then those whose language cannot be told (the others get the language that the evidence tells), then
all but one of each class of near copies; private data is redacted and what is left is packed along the curve.  The
stages before the last keep the columns of ``documents``.

In every stage: null texts and texts without words are kept until packing, where they give no piece; null ids stay null;
very long texts are read whole; repeated rows are treated alike (the near-copy stage keeps one of them); an empty table
gives an empty table of the same columns; columns beside those of ``documents``, whatever their names, pass through all
stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewell.llm import language, near_dup, packing, private, toxicity
from namewell.llm.common import cut, fresh, join_by_size, shared_dir

#: No stage but the first three could be put in SQL, and these only in part; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose compression-distance score is under the cut-off calibrated on the labels; null and empty texts stay."""
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    (score,) = fresh(docs, "_score")
    return toxicity.scored(docs, model, docs.columns, score=score).where(F.col(score) < model.cutoff).drop(score)


def name_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the fused evidence tells, with that language in ``lang``; texts without words keep what they declare.

    Rows that the evidence rejects or names otherwise are found by (id, text hash, declared language, source), of which one outcome holds.
    """
    i, h, d, s, new = fresh(docs, "_i", "_h", "_d", "_s", "_new")
    key = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.col("lang").alias("d"), F.col("source").alias("s"))
    rows = docs.select(key.alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    found = language.identify(rows, language.fit(language.labelled(docs)))
    # a text without letters says nothing of its language and is none of this stage's business
    other = found.where("trigrams > 0 and not (lang <=> declared)").select(F.col("key.i").alias(i), F.col("key.h").alias(h), F.col("key.d").alias(d), F.col("key.s").alias(s), F.col("lang").alias(new))
    other = cut(other.dropDuplicates([i, h, d, s]), "other")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.xxhash64("text").eqNullSafe(F.col(h)) & F.col("lang").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s))
    named = join_by_size(docs, other, other.count(), same, "left", 128).where(F.col(new).isNull() | (F.col(new) != "und"))
    return named.select(*[F.coalesce(F.col(new), F.col("lang")).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one with the least (id, text hash)."""
    return near_dup.drop_near_duplicates(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, identifiers replaced by their kind and ``n_chars`` counted anew."""
    return private.redact(docs)


def pack_along_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packs; texts without words give none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", name_languages),
    ("near duplicates", drop_near_copies),
    ("private data", redact_private),
    ("packing", pack_along_curve),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
