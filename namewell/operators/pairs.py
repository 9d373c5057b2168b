"""Candidate pairs inside blocks: salted joins, labels, capped blocks, balanced classes."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewell.operators.tables import cut, few, rank_groups, ranked

#: Mentions of a block beyond which its pairs are spread over several tasks.
SALT_BLOCK = 4000
#: Tasks that draw pairs of capped blocks; a file of block sizes is small beside what they draw.
DRAWERS = 64


def pair_label(o1: Column, o2: Column) -> Column:
    """1 or 0 where both identities are known, else null."""
    return F.when((F.coalesce(o1, F.lit("")) != "") & (F.coalesce(o2, F.lit("")) != ""), (o1 == o2).cast("int"))


def pair_id(m1: Column, m2: Column) -> Column:
    """The two ids as strings in their order, joined."""
    return F.concat_ws("__", F.least(m1, m2), F.greatest(m1, m2))


def candidate_pairs(mentions: DataFrame, keep: list[str], *, same_split: bool = False, mixed: bool = False, labeled_only: bool = False, same_bibcode: bool = False, order: str = "mention_id", with_id: bool = True, salt_block: int = SALT_BLOCK) -> DataFrame:
    """Unordered pairs inside a block, those of one publication left out (with ``same_bibcode`` these alone).

    An equi-join on the block, with the ``order`` of the two mentions as residual.  The left side of a block of more than
    ``salt_block`` mentions goes to several tasks and its right side to each of them.  Pairs of different splits are left out
    with ``same_split``; with ``mixed`` every pair has ``split``: that of both, or "mixed".
    """
    cols = list(dict.fromkeys(["mention_id", "block_key", "bibcode", order, *keep]))
    side = lambda df, n: df.select(*[F.col(c).alias(c if c in ("block_key", "_salt") else f"{c}_{n}") for c in df.columns])
    given = cut(mentions.select(*cols), "mentions")  # read three times: once for the sizes, once a side
    if same_bibcode:
        # the publication is part of the key: no other pair of the block is made
        given = _of_shared(given)
        out = side(given, 1).join(side(given, 2).withColumn("bibcode_1", F.col("bibcode_2")), ["block_key", "bibcode_1"]).where(F.col(f"{order}_1") < F.col(f"{order}_2"))
        return _finished(out.where("bibcode_1 <> ''"), keep, same_split, mixed, labeled_only, with_id)
    a, b, on = _salted(given, F.xxhash64("mention_id"), salt_block)
    out = side(a, 1).join(side(b, 2), on).where(F.col(f"{order}_1") < F.col(f"{order}_2")).drop("_salt")
    together = (F.col("bibcode_1") == F.col("bibcode_2")) & (F.col("bibcode_1") != "")
    return _finished(out.where(~F.coalesce(together, F.lit(False))), keep, same_split, mixed, labeled_only, with_id)


def _salted(given: DataFrame, digest: Column, salt_block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of each block with itself, and its keys: the left side of a block of more than ``salt_block`` rows goes to several tasks, its right side to each of them."""
    large = given.groupBy("block_key").agg(F.count("*").alias("n")).where(f"n > {salt_block}").select("block_key", F.ceil(F.col("n") / salt_block).cast("int").alias("_salts"))
    large = cut(large, "large")
    many = large.count()
    if not many:
        return given, given, ["block_key"]
    salts = given.join(few(large, many), "block_key", "left")
    a = salts.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(digest, F.col("_salts")).cast("int"))).drop("_salts")
    b = salts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return a, b, ["block_key", "_salt"]


def _of_shared(given: DataFrame) -> DataFrame:
    """Rows of publications with two mentions of a block at least, mostly few."""
    shared = cut(given.where("bibcode <> ''").groupBy("block_key", "bibcode").agg(F.count("*").alias("n")).where("n > 1").select("block_key", "bibcode"), "shared")
    return given.join(few(shared, shared.count()), ["block_key", "bibcode"], "left_semi")


def _finished(out: DataFrame, keep: list[str], same_split: bool, mixed: bool, labeled_only: bool, with_id: bool) -> DataFrame:
    """Pairs with what is said of their splits and labels."""
    if same_split:
        out = out.where("split_1 = split_2")
    if mixed:
        out = out.withColumn("split", F.when(F.col("split_1") == F.col("split_2"), F.col("split_1")).otherwise("mixed"))
    if "orcid" in keep:
        out = out.withColumn("label", pair_label(F.col("orcid_1"), F.col("orcid_2")))
        if labeled_only:
            out = out.where("label is not null")
    return out.withColumn("pair_id", pair_id(F.col("mention_id_1"), F.col("mention_id_2"))) if with_id else out


def pair_counts(mentions: DataFrame, keep: list[str], salt_block: int = SALT_BLOCK) -> DataFrame:
    """(block_key, keep_1..., keep_2..., n): how many candidate pairs of a block hold each two sets of values, whichever comes first.  No pair is made.

    Mentions of equal values are one cell.  Two cells make as many pairs as the product of their sizes, one makes those of its own
    mentions; the pairs of one publication are counted in the same way, inside it, and taken off.
    """
    given = cut(mentions.where("block_key is not null").select("block_key", "bibcode", F.struct(*[F.col(c) for c in keep]).alias("v")), "mentions")  # read three times
    cells = cut(given.groupBy("block_key", "v").agg(F.count("*").alias("n")), "cells")
    one = _of_shared(given).groupBy("block_key", "bibcode", "v").agg(F.count("*").alias("n"))
    one = cut(one, "own")
    side = lambda df, k: df.withColumnsRenamed({"v": f"v{k}", "n": f"n{k}"})

    def met(left: DataFrame, right: DataFrame, by: list[str], sign: int) -> DataFrame:
        n = F.expr("case when v1 <=> v2 then n1 * (n1 - 1) div 2 else n1 * n2 end")
        return side(left, 1).join(side(right, 2), by).where("v1 <= v2").select("block_key", "v1", "v2", (sign * n).alias("n"))

    a, b, by = _salted(cells, F.xxhash64("v"), salt_block)
    every = met(a, b, by, 1).unionByName(met(one, one, ["block_key", "bibcode"], -1).where("n < 0"))
    left = every.groupBy("block_key", "v1", "v2").agg(F.sum("n").alias("n")).where("n > 0")
    return left.select("block_key", *[F.col(f"v{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in keep], "n")


def pair_count(n: int) -> int:
    return n * (n - 1) // 2


def pair_at(rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j), i < j, at ranks of the row by row order of all pairs of ``n``."""
    rank = np.asarray(rank, np.int64)
    rows = np.arange(n, dtype=np.int64)
    first = rows * (2 * n - rows - 1) // 2  # rank of the first pair of each row
    i = np.searchsorted(first, rank, "right") - 1
    return i, rank - first[i] + i + 1


def block_seed(seed: int, block: str) -> int:
    return int.from_bytes(hashlib.sha1(f"{seed}::{block}".encode()).digest()[:4], "big")


def capped_pairs(mentions: DataFrame, cap: int, seed: int = 11, order: str = "mention_id") -> DataFrame:
    """(block_key, mention_id_1, mention_id_2) of at most ``cap`` pairs a block, before any rule takes some out.

    A block with more pairs gets ``cap`` distinct ranks from a generator seeded by (seed, block), which needs its size alone;
    the ranks' pairs meet the mentions by their places in the block, and places come out of one global rank, so no task holds a block.
    """
    at = ranked(mentions.select("block_key", "mention_id", *([order] if order != "mention_id" else [])), ["block_key", order], "_r")
    at = cut(at, "places")
    sizes = cut(at.groupBy("block_key").agg(F.count("*").alias("n"), F.min("_r").alias("first")), "sizes")
    placed = at.join(few(sizes, sizes.count()), "block_key").select("block_key", "mention_id", (F.col("_r") - F.col("first")).alias("place"), "n")
    over = F.col("n") * (F.col("n") - 1) / 2 > cap

    step = max(1, (1 << 16) // max(1, cap))  # blocks whose pairs are given at once: a frame a block costs more than its pairs

    def draw(batches):
        for b in batches:
            for k in range(0, len(b), step):
                part = b.iloc[k : k + step]
                made = [pair_at(np.sort(np.random.default_rng(block_seed(seed, block)).choice(pair_count(n), size=cap, replace=False)), n) for block, n in zip(part["block_key"], part["n"])]
                yield pd.DataFrame({"block_key": np.repeat(part["block_key"].to_numpy(), cap), "i": np.concatenate([i for i, _ in made]), "j": np.concatenate([j for _, j in made])})

    drawn = sizes.where(over).select("block_key", "n").repartition(DRAWERS, "block_key").mapInPandas(draw, "block_key string, i long, j long")
    hot = placed.where(over)
    side = lambda df, n, p: df.select(F.col("block_key"), F.col("place").alias(p), F.col("mention_id").alias(f"mention_id_{n}"))
    few_pairs = side(placed.where(~over), 1, "i").hint("shuffle_merge").join(side(placed.where(~over), 2, "j"), "block_key").where("i < j")
    # ``cap`` rows a block, of which the planner sees one
    some = drawn.hint("shuffle_merge").join(side(hot, 1, "i"), ["block_key", "i"]).hint("shuffle_merge").join(side(hot, 2, "j"), ["block_key", "j"])
    return few_pairs.select("block_key", "mention_id_1", "mention_id_2").unionByName(some.select("block_key", "mention_id_1", "mention_id_2"))


def balance(pairs: DataFrame) -> DataFrame:
    """The larger class cut to the size of the smaller, by a hash of the pair; unlabelled pairs are left out. No task sorts a class."""
    labelled = pairs.where("label is not null")
    n = labelled.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    least, larger = min(n["p"], n["q"]), int(n["p"] > n["q"])
    if n["p"] == n["q"]:
        return labelled
    kept = rank_groups(labelled.where(F.col("label") == larger), F.md5("pair_id"), F.col("pair_id"), [least], "_g").where("_g = 0").drop("_g")
    return labelled.where(F.col("label") != larger).unionByName(kept)


def written_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """``pairs`` written as Parquet; an empty table is an error."""
    if pairs.isEmpty():
        raise ValueError("there are no pairs to write")
    pairs.write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.parquet(path)


def shards(sizes: list[tuple[str, int]], n: int) -> list[list[str]]:
    """Blocks dealt out to ``n`` shards, the one with most pairs first, always to the lightest shard."""
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for block, size in sorted(sizes, key=lambda x: (-pair_count(x[1]), x[0])):
        weight, i = heapq.heappop(heap)
        out[i].append(block)
        heapq.heappush(heap, (weight + max(1, pair_count(size)), i))
    return out


def class_counts(pairs: DataFrame) -> DataFrame:
    """(pos, neg) of labelled pairs."""
    return pairs.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def labeled_in(pairs: DataFrame, split: str) -> DataFrame:
    return pairs.where(F.col("label").isNotNull() & (F.col("split") == split))


def known_pairs(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``pairs`` both of whose mentions are in ``mentions``."""
    ids = mentions.select("mention_id").distinct()
    for n in (1, 2):
        pairs = pairs.join(ids.withColumnRenamed("mention_id", f"mention_id_{n}"), f"mention_id_{n}", "left_semi")
    return pairs
