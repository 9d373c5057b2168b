"""Splits by identity, label counts without pairs, and subsets of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewell.operators.pairs import pair_count
from namewell.operators.tables import cut, few, rank_groups

SPLITS = ["train", "val", "test"]
STAGE_TARGETS = {"smoke": 1_000, "mini": 10_000, "mid": 100_000, "full": None}


def known(orcid: Column) -> Column:
    return F.coalesce(F.trim(orcid), F.lit("")) != ""


def label_counts(mentions: DataFrame) -> DataFrame:
    """(block_key, split, pos, neg, labeled_pairs) of the mentions with an identity, in closed form: no pair is made."""
    c = mentions.where(known(F.col("orcid"))).groupBy("block_key", "split", "orcid").agg(F.count("*").alias("n"))
    total, same = F.expr("sum(n) * (sum(n) - 1) div 2"), F.sum(F.expr("n * (n - 1) div 2"))
    return c.groupBy("block_key", "split").agg(same.alias("pos"), (total - same).alias("neg"), total.alias("labeled_pairs"))


def split_summary(mentions: DataFrame) -> DataFrame:
    """(split, pos, neg, labeled_pairs) of each of SPLITS, empty ones too."""
    found = label_counts(mentions).groupBy("split").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "labeled_pairs")])
    names = mentions.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return F.broadcast(names).join(found, "split", "left").select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg", "labeled_pairs")])


def leaks(mentions: DataFrame) -> DataFrame:
    """(orcid, splits) of identities in more than one split."""
    return mentions.where(known(F.col("orcid"))).groupBy("orcid").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def split_of_identity(mentions: DataFrame, seed: int, train: float, val: float) -> DataFrame:
    """(orcid, split): identities in the order of a seeded hash, the first ``train`` of them, the next ``val``, the rest."""
    ids = cut(mentions.where(known(F.col("orcid"))).select("orcid").distinct(), "identities")
    n = ids.count()
    cuts = [int(n * train), int(n * train) + int(n * val)]
    out = rank_groups(ids, F.md5(F.concat(F.lit(f"{seed}::"), "orcid")), F.col("orcid"), cuts, "_g")
    return out.select("orcid", F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("_g") + 1).alias("split"))


def assign_splits(mentions: DataFrame, seed: int = 11, train: float = 0.6, val: float = 0.2, min_neg_val: int = 0, min_neg_test: int = 0, attempts: int = 1) -> tuple[DataFrame, dict]:
    """``mentions`` with ``split``, by identity so that none leaks, and what was found.

    Further seeds are tried until validation and test hold enough negative pairs; the best attempt stays.  Status: ok,
    split_balance_degraded (no attempt had enough), split_balance_infeasible (all blocks together have too few),
    no_orcid_column, no_known_orcid.  Mentions without an identity are "inference".
    """
    none = {s: {"pos": 0, "neg": 0} for s in SPLITS}
    meta = {"attempts": 0, "min_neg_val": min_neg_val, "min_neg_test": min_neg_test, "split_label_counts": none}
    alone = mentions.withColumn("split", F.lit("inference"))
    if "orcid" not in mentions.columns:
        return alone, meta | {"status": "no_orcid_column"}
    if mentions.where(known(F.col("orcid"))).isEmpty():
        return alone, meta | {"status": "no_known_orcid"}
    if train <= 0 or val < 0 or train + val >= 1:
        raise ValueError(f"split ratios out of range: train {train}, validation {val}")
    needed = min_neg_val + min_neg_test
    possible = label_counts(mentions.withColumn("split", F.lit("train"))).agg(F.coalesce(F.sum("neg"), F.lit(0)).alias("n")).first()["n"]
    feasible = possible >= needed
    best = None
    for attempt in range(max(1, attempts) if feasible else 1):
        sides = cut(split_of_identity(mentions, seed + attempt, train, val), "splits")
        found = mentions.join(few(sides, sides.count()), "orcid", "left").withColumn("split", F.coalesce("split", F.lit("inference"))).select(*mentions.columns, "split")
        counts = {r["split"]: {k: r[k] for k in ("pos", "neg", "labeled_pairs")} for r in split_summary(found).collect()}
        v, t = counts["val"]["neg"], counts["test"]["neg"]
        score = (min(v / min_neg_val if min_neg_val else 1.0, t / min_neg_test if min_neg_test else 1.0), v + t)
        enough = v >= min_neg_val and t >= min_neg_test
        if best is None or score > best[0] or enough:
            best = (score, found, counts)
        if enough:
            break
    status = "split_balance_infeasible" if not feasible else "ok" if enough else "split_balance_degraded"
    return best[1], meta | {"status": status, "attempts": attempt + 1 if feasible else 0, "required_neg_total": needed, "max_possible_neg_total": possible, "train_ratio": train, "val_ratio": val, "test_ratio": 1 - train - val, "split_label_counts": best[2]}


def stage_subset(mentions: DataFrame, target: int | None, seed: int = 11, stage: str = "smoke", mean_block: float = 2.0) -> DataFrame:
    """``target`` mentions (all, if there are no more), rich in pairs, with subset_stage and subset_seed.

    About target / mean_block blocks of two mentions at least are drawn, without replacement and with chances by their size
    (the least exponential keys); two mentions of each come first, then the others of these blocks, then the rest, all in the
    order of a seeded hash.
    """
    done = lambda df: df.withColumn("subset_stage", F.lit(stage)).withColumn("subset_seed", F.lit(seed))
    if target is None:
        return done(mentions)
    if target <= 0:
        raise ValueError("a subset needs a positive target")
    digest = lambda *c: F.md5(F.concat_ws("::", F.lit(str(seed)), *c))
    unit = (F.conv(F.substring(digest(F.lit("block"), "block_key"), 1, 12), 16, 10).cast("double") + 1.0) / float((1 << 48) + 1)
    sizes = mentions.groupBy("block_key").agg(F.count("*").alias("n")).where("n >= 2").withColumn("_k", F.round(-F.log(unit) / F.col("n"), 12))
    wanted = max(1, round(target / max(2.0, mean_block)))
    # the key as fixed-width hexadecimal digits sorts as the number does
    keyed = cut(sizes.withColumn("_h", F.lpad(F.hex((F.col("_k") * 1e12).cast("long")), 16, "0")), "blocks")
    low = F.substring(F.lpad(F.hex((F.least(F.col("_k"), F.lit(1.0)) * ((1 << 16) - 1)).cast("long")), 4, "0"), 1, 4)
    drawn = rank_groups(keyed, F.concat(low, "_h"), F.col("block_key"), [wanted], "_g").where("_g = 0").select("block_key", F.lit(True).alias("_in"))
    drawn = cut(drawn, "drawn")
    tiered = mentions.join(few(drawn, drawn.count()), "block_key", "left").withColumn("_h", digest(F.lit("row"), "mention_id"))
    two = _two_least(tiered)
    marked = tiered.join(two, "mention_id", "left").withColumn("_t", F.when(F.col("_two").isNotNull(), 0).when(F.col("_in"), 1).otherwise(2))
    counts = {r["_t"]: r["count"] for r in marked.groupBy("_t").count().collect()}
    out, left = None, target
    for t in (0, 1, 2):
        part, n = marked.where(F.col("_t") == t), counts.get(t, 0)
        if left < n:
            part = rank_groups(part, F.col("_h"), F.col("mention_id"), [left], "_g").where("_g = 0").drop("_g")
        out = part if out is None else out.unionByName(part)
        left -= min(left, n)
        if not left:
            break
    return done(out.select(*mentions.columns))


def _two_least(tiered: DataFrame) -> DataFrame:
    """(mention_id, _two) of the two mentions of each drawn block that come first by hash; each task keeps two of a block."""
    drawn = tiered.where("_in").select("block_key", "mention_id", "_h")
    first = drawn.groupBy("block_key").agg(F.min(F.struct("_h", "mention_id")).alias("a"))
    rest = drawn.join(first, "block_key").where(F.struct("_h", "mention_id") > F.col("a"))
    second = rest.groupBy("block_key").agg(F.min(F.struct("_h", "mention_id")).alias("a"))
    return first.unionByName(second).select("a.mention_id", F.lit(True).alias("_two"))


def manifest(subset: DataFrame) -> DataFrame:
    return subset.select("mention_id", "bibcode", "author_idx", "block_key", "subset_stage", "subset_seed")


def subset_summary(subset: DataFrame) -> DataFrame:
    """One row: mentions, blocks, 95th percentile and greatest size of a block, share of blocks of one, most pairs."""
    sizes = subset.groupBy("block_key").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count("*").alias("blocks"), F.percentile("n", 0.95).alias("block_size_p95"), F.max("n").alias("block_size_max"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_block_ratio"), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def cached_subset_problems(subset: DataFrame, target: int | None, stage: str, seed: int) -> list[str]:
    """Why a stored subset cannot be used again; empty if it can."""
    want = {"mention_id", "bibcode", "author_idx", "block_key", "subset_stage", "subset_seed"}
    if missing := sorted(want - set(subset.columns)):
        return [f"missing columns {missing}"]
    r = subset.agg(F.count("*").alias("n"), F.count_distinct("mention_id").alias("ids"), F.count_if((F.col("subset_stage") != stage) | (F.col("subset_seed") != seed)).alias("other"), F.max("block_key").alias("b")).first()
    found = []
    if not r["n"]:
        found.append("empty")
    if r["ids"] != r["n"]:
        found.append("repeated mentions")
    if r["other"]:
        found.append("made for another stage or seed")
    if target is not None and r["n"] > target:
        found.append("more mentions than asked for")
    return found


def pair_upper_bound(sizes: list[int], cap: int | None = None) -> int:
    return sum(min(pair_count(n), cap) if cap is not None else pair_count(n) for n in sizes)
