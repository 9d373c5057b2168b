"""The relational steps of identity resolution, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewell.functions.names import conflict
from namewell.operators.tables import ranked


def merge_records(records: DataFrame) -> DataFrame:
    """One record a key: of every field the first valid value, publications before references, then by row."""
    order = F.struct((F.col("source_type") != "publication").cast("int"), F.col("source_row_idx"))
    # min_by skips rows whose ordering is null, so validity goes into the ordering
    first = lambda c, ok: F.min_by(c, F.when(ok, order))
    pub, ref = F.max((F.col("source_type") == "publication").cast("int")), F.max((F.col("source_type") == "reference").cast("int"))
    return records.groupBy("bibcode").agg(
        F.coalesce(first("title", F.trim("title") != ""), F.lit("")).alias("title"), F.coalesce(first("abstract", F.trim("abstract") != ""), F.lit("")).alias("abstract"),
        first("year", F.col("year").isNotNull()).alias("year"), first("aff", F.exists("aff", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")).alias("aff"), first("authors", F.size("authors") > 0).alias("authors"),
        F.when((pub == 1) & (ref == 1), "publication+reference").when(pub == 1, "publication").when(ref == 1, "reference").otherwise("ads").alias("source_type"),
        F.min_by("source_type", order).alias("canonical_source_type"), F.min_by("source_row_idx", order).alias("canonical_source_row_idx"), F.count("*").alias("n_rows"),
    )


def explode_mentions(records: DataFrame) -> DataFrame:
    """One row an author position; blank names are dropped before positions are counted. A record without affiliations has null ones."""
    pairs = F.filter(F.arrays_zip(F.col("authors").alias("a"), F.slice(F.concat(F.coalesce("aff", F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), F.size("authors"))), F.lit(1), F.greatest(F.size("authors"), F.lit(1))).alias("f")), lambda x: F.trim(x["a"]) != "")
    return records.select("*", F.posexplode(pairs)).select(F.concat_ws("::", "bibcode", "pos").alias("mention_id"), "bibcode", F.col("pos").cast("long").alias("author_idx"), F.col("col.a").alias("author_raw"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), "year", "source_type", F.col("col.f").alias("aff"))


def dedup_stats(merged: DataFrame) -> DataFrame:
    """One row: rows before, rows merged away, most rows of a key."""
    return merged.agg(F.sum("n_rows").alias("input_rows"), F.sum(F.col("n_rows") - 1).alias("duplicate_rows"), F.max("n_rows").alias("max_per_key"))


def with_canonical_id(merged: DataFrame) -> DataFrame:
    """``merged`` with canonical_record_id, the 0-based rank of the key."""
    return ranked(merged, ["bibcode"], "canonical_record_id")


def with_order(mentions: DataFrame) -> DataFrame:
    """``mentions`` with ``ord``, the rank by (bibcode, author_idx) that orients pairs and numbers labels."""
    return ranked(mentions, ["bibcode", "author_idx"], "ord")


def block_manifest(mentions: DataFrame) -> DataFrame:
    """(block_key, n), sorted."""
    return mentions.groupBy("block_key").agg(F.count("*").alias("n")).orderBy("block_key")


def block_summary(sizes: DataFrame) -> DataFrame:
    """One row of ``block_sizes``: blocks, the largest, the 95th percentile, the share of blocks of one, pairs."""
    return sizes.agg(F.count("*").alias("n_blocks"), F.max("n_mentions").alias("max_block"), F.percentile("n_mentions", 0.95).alias("p95"), F.avg((F.col("n_mentions") == 1).cast("double")).alias("singleton_ratio"), F.sum("pair_bound").alias("pairs"))


def largest(df: DataFrame, by: str, name: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest ``by``, of equal ones by ``name``."""
    return df.orderBy(F.desc(by), name).limit(k)


def complete(mentions: DataFrame, canonical: DataFrame, key: str = "bibcode") -> DataFrame:
    """``canonical`` rows that ``mentions`` use; a mention whose record is missing is an error."""
    lost = mentions.join(canonical.select(key), key, "left_anti").select(key).limit(5).collect()
    if lost:
        raise ValueError(f"mentions without a record: {[r[0] for r in lost]}")
    return canonical.join(mentions.select(key), key, "left_semi")


def block_sizes(mentions: DataFrame, cap: int | None = None) -> DataFrame:
    pairs = F.expr("n_mentions * (n_mentions - 1) div 2")
    return mentions.groupBy("block_key").agg(F.count("*").alias("n_mentions")).withColumn("pair_bound", F.least(pairs, F.lit(cap)) if cap else pairs)


def constrained(distance: Column, clash: Column, gap: Column, *, name: str = "hard", year: str = "soft", name_floor: float = 0.75, year_floor: float = 0.65) -> Column:
    """A distance under the name and year rules: hard sets it to 1, soft lifts it to a floor."""
    by = lambda d, hit, mode, floor: F.when(hit, F.lit(1.0) if mode == "hard" else F.greatest(d, F.lit(floor))).otherwise(d)
    return by(by(distance, clash, name, name_floor), gap, year, year_floor)


def year_gap(y1: Column, y2: Column, most: int = 30) -> Column:
    return F.coalesce(F.abs(y1 - y2) > most, F.lit(False))


def block_eps(n: Column, eps: float, buckets: list[tuple[int, int | None, float]], low: float = 0.0, high: float = 1.0) -> Column:
    """eps by block size: the bucket's change is added and the sum clipped; buckets may not overlap."""
    spans = sorted((a, b if b is not None else 1 << 62) for a, b, _ in buckets)
    if any(x[1] >= y[0] for x, y in zip(spans, spans[1:])):
        raise ValueError("size buckets overlap")
    out = F.lit(eps)
    for a, b, delta in buckets:
        out = F.when((n >= a) & (n <= (b if b is not None else 1 << 62)), F.lit(min(high, max(low, eps + delta)))).otherwise(out)
    return out


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def name_clash(c1: Column, c2: Column) -> Column:
    return conflict(c1["given"], c1["surname"], c2["given"], c2["surname"])


