"""Figures of scores, thresholds, clusters and runs: each one aggregate pass, or a few rows of one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewell.operators.tables import cut

#: Thresholds from -1 to 1 in steps of a thousandth.
GRID = 2001
SIZE_BUCKETS = [(1, 1), (2, 2), (3, 5), (6, 10), (11, 50), (51, 100), (101, 500), (501, None)]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clamped_cosine(c: Column) -> Column:
    """Not finite made 0, clipped to [-1, 1]."""
    return F.greatest(F.least(F.when(finite(c), c).otherwise(0.0), F.lit(1.0)), F.lit(-1.0))


def clamped_distance(c: Column) -> Column:
    """Not finite made 1, clipped to [0, 2]."""
    return F.greatest(F.least(F.when(finite(c), c).otherwise(1.0), F.lit(2.0)), F.lit(0.0))


def counted(hit: Column, weight: str | None = None) -> Column:
    """How many rows hold ``hit``, each as often as its ``weight`` says."""
    hit = F.coalesce(hit, F.lit(False))
    return F.coalesce(F.sum(F.when(hit, F.col(weight)).otherwise(0)), F.lit(0)).cast("long") if weight else F.count_if(hit)


def clamp_counts(scores: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: how many cosines were not finite, under or over their range, and how many distances; ``weight``: the column that says how often a row counts."""
    c, d = F.col("cosine_sim"), F.col("distance")
    n = lambda x: counted(x, weight)
    return scores.agg(n(~finite(c)).alias("cosine_non_finite"), n(finite(c) & (c < -1)).alias("cosine_below"), n(finite(c) & (c > 1)).alias("cosine_above"), n(~finite(d)).alias("distance_non_finite"), n(finite(d) & (d < 0)).alias("distance_below"), n(finite(d) & (d > 2)).alias("distance_above"))


def score_ranges(scores: DataFrame, weight: str | None = None) -> DataFrame:
    """One row of nine figures: extremes of both columns, missing values (null or NaN), values out of range, and whether all is well."""
    n = lambda x: counted(x, weight)
    c, d = F.nanvl(F.col("cosine_sim").cast("double"), F.lit(None).cast("double")), F.nanvl(F.col("distance").cast("double"), F.lit(None).cast("double"))
    out = scores.agg(F.min(c).alias("cosine_min"), F.max(c).alias("cosine_max"), F.min(d).alias("distance_min"), F.max(d).alias("distance_max"), n(c.isNull()).alias("cosine_non_finite_count"), n(d.isNull()).alias("distance_non_finite_count"), n((c < -1) | (c > 1)).alias("cosine_out_of_range_count"), n(d < 0).alias("negative_distance_count"), n(d > 2).alias("distance_above_max_count"))
    return out.withColumn("pair_score_range_ok", F.expr("cosine_non_finite_count + distance_non_finite_count + cosine_out_of_range_count + negative_distance_count + distance_above_max_count = 0"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """precision, recall, f1 and accuracy; a zero denominator gives 0."""
    return [_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy")]


def class_metrics(pairs: DataFrame, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn, n_pairs, precision, recall, f1, accuracy) of labelled pairs (label, hit); ``weight``: the column that says how many pairs a row stands for."""
    n = lambda x: counted(x, weight)
    y, hit = F.col("label") == 1, F.coalesce(F.col("hit"), F.lit(False))
    made = pairs.where("label is not null").groupBy(*(by or [])).agg(n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"), n(~y & ~hit).alias("tn"), n(F.lit(True)).alias("n_pairs"))
    return made.select("*", *_scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def with_clusters(pairs: DataFrame, clusters: DataFrame, uid: str = "author_uid") -> DataFrame:
    """``pairs`` with ``hit``: both mentions in one cluster; a pair with a mention in none is apart."""
    side = lambda n: clusters.select(F.col("mention_id").alias(f"mention_id_{n}"), F.col(uid).alias(f"_u{n}"))
    joined = pairs.join(side(1), "mention_id_1", "left").join(side(2), "mention_id_2", "left")
    return joined.withColumn("hit", F.coalesce(F.col("_u1") == F.col("_u2"), F.lit(False))).drop("_u1", "_u2")


def threshold_sweep(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """(grid, tp, fp, pos, neg, f1, precision, recall, accuracy) at every threshold grid / 1000 - 1 of ``scored`` (sim, y): one histogram pass, running sums over its few bins; ``weight``: the column that says how many pairs a row stands for."""
    top = GRID - 1
    # the last threshold that the score reaches; hundred-thousandths of a step are rounding
    bin_ = F.greatest(F.least(F.floor(F.round((F.col("sim") + 1) * 1000, 5)).cast("int"), F.lit(top)), F.lit(-1))
    hist = scored.groupBy(bin_.alias("grid")).agg(counted(F.col("y"), weight).alias("p"), counted(~F.col("y"), weight).alias("q"))
    every = scored.sparkSession.range(-1, GRID, 1, 1).select(F.col("id").cast("int").alias("grid"))
    down = Window.orderBy(F.desc("grid")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = every.join(hist, "grid", "left").select("grid", F.sum(zero("p")).over(down).alias("tp"), F.sum(zero("q")).over(down).alias("fp"), F.sum(zero("p")).over(whole).alias("pos"), F.sum(zero("q")).over(whole).alias("neg"))
    tp, fp = F.col("tp"), F.col("fp")
    return sums.where("grid >= 0").select("*", *_scores(tp, fp, F.col("pos") - tp, F.col("neg") - fp))


def best_threshold(scored: DataFrame, default: float = 0.35, weight: str | None = None) -> DataFrame:
    """One row (threshold, precision, recall, f1, accuracy, status, source): the greatest F1; of equal ones that farthest from -1 and 1, then the last.

    Without labels of both kinds the ``default``, its figures, and fallback_no_labels, fallback_no_positives or fallback_no_negatives.
    """
    sweep = cut(threshold_sweep(scored, weight), "sweep")
    rank = F.struct(F.round("f1", 12).alias("f"), F.least(F.col("grid"), F.lit(GRID - 1) - F.col("grid")).alias("m"), "grid")
    best = sweep.agg(F.max_by(F.struct("*"), rank).alias("b")).select("b.*")
    at = sweep.where(F.col("grid") == round((default + 1) * 1000)).select("*")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    fall = F.when((F.col("pos") == 0) & (F.col("neg") == 0), "fallback_no_labels").when(F.col("pos") == 0, "fallback_no_positives").otherwise("fallback_no_negatives")
    figures = ["precision", "recall", "f1", "accuracy"]
    ok = best.where(both).select((F.col("grid") / 1000 - 1).alias("threshold"), *figures, F.lit("ok").alias("status"), F.lit("val_f1_opt").alias("source"))
    return ok.unionByName(at.where(~both).select(F.lit(default).alias("threshold"), *figures, fall.alias("status"), F.lit("fallback_default").alias("source")))


def eps_values(low: float = 0.2, high: float = 0.5, step: float = 0.05) -> list[float]:
    if step <= 0 or high < low:
        raise ValueError("an eps sweep needs a positive step and an upper end over the lower")
    return [round(low + i * step, 6) for i in range(int(math.floor((high - low) / step + 1e-9)) + 1)]


def resolve_eps(config: dict, threshold: float | None = None) -> tuple[float, dict]:
    """eps and where it comes from: fixed, one minus a cosine threshold, or a sweep's pick or fallback; clipped."""
    mode, fixed = str(config.get("eps_mode", "fixed")).lower(), float(config.get("eps", 0.35))
    picked, fallback = config.get("selected_eps"), float(config.get("eps_fallback", fixed))
    if mode == "from_threshold" and threshold is not None:
        raw, source = 1.0 - threshold, "from_threshold"
    elif mode == "val_sweep":
        raw, source = (float(picked), "val_sweep_selected") if picked is not None else (fallback, "val_sweep_fallback")
    else:
        raw, source = fixed, "fixed"
    eps = min(float(config.get("eps_max", 1.0)), max(float(config.get("eps_min", 0.0)), raw))
    return eps, {"eps_mode": mode, "source": source, "raw_eps": raw, "selected_eps": picked, "eps_fallback": fallback, "resolved_eps": eps}


def pick_eps(rows: list[dict], low: float, high: float) -> dict:
    """The candidate (eps, f1) with the greatest F1, of equal ones that nearest to the middle; how far the second is, and whether an end was hit."""
    valid = [r for r in rows if r.get("f1") is not None]
    if not valid:
        return {"sweep_status": "fallback_no_valid_candidates", "selected_eps": None, "n_valid_candidates": 0, "boundary_hit": False, "boundary_side": None, "f1_gap_best_second": None}
    order = sorted(valid, key=lambda r: (r["f1"], -abs(r["eps"] - (low + high) / 2)), reverse=True)
    eps = order[0]["eps"]
    side = "min" if abs(eps - low) <= 1e-9 else "max" if abs(eps - high) <= 1e-9 else None
    return {"sweep_status": "ok", "selected_eps": eps, "selected_metrics": order[0], "n_valid_candidates": len(valid), "boundary_hit": side is not None, "boundary_side": side, "f1_gap_best_second": order[0]["f1"] - order[1]["f1"] if len(order) > 1 else None}


def range_limited(best: dict, diagnostic: list[dict], delta: float = 0.005) -> dict:
    """What a wider sweep after a hit boundary says: its best F1 over the pick's, and whether that is ``delta`` at least."""
    valid = [r for r in diagnostic if r.get("f1") is not None]
    if not best.get("boundary_hit") or not valid:
        return {"boundary_diagnostic_run": bool(best.get("boundary_hit")), "diag_best_minus_canonical_f1": None, "range_limited": False}
    gain = max(r["f1"] for r in valid) - best["selected_metrics"]["f1"]
    return {"boundary_diagnostic_run": True, "diag_best_minus_canonical_f1": gain, "range_limited": gain >= delta}


def mean_sem(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, sem): the standard error of the mean is null under two rows."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def size_bucket(n: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in SIZE_BUCKETS:
        name = str(low) if low == high else f"{low}-{high}" if high else f"{low}+"
        out = F.when((n >= low) & (n <= high) if high else n >= low, name).otherwise(out)
    return out


def size_histogram(mentions: DataFrame) -> DataFrame:
    """(bucket, blocks, mentions) of block sizes in eight buckets."""
    n = mentions.groupBy("block_key").agg(F.count("*").alias("n"))
    return n.groupBy(size_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("blocks"), F.sum("n").alias("mentions"))


def eps_summary(blocks: DataFrame, eps: float, buckets: list[tuple[int, int | None, float]]) -> DataFrame:
    """(bucket, blocks, eps_min, eps_max, eps_mean) of the effective eps of ``blocks`` (n_mentions)."""
    from namewell.operators.core import block_eps

    label = F.lit("default")
    for low, high, _ in buckets:
        n = F.col("n_mentions")
        label = F.when((n >= low) & (n <= high) if high is not None else n >= low, f"{low}-{'inf' if high is None else high}").otherwise(label)
    made = blocks.select(label.alias("bucket"), block_eps(F.col("n_mentions"), eps, buckets).alias("e"))
    return made.groupBy("bucket").agg(F.count("*").alias("blocks"), F.min("e").alias("eps_min"), F.max("e").alias("eps_max"), F.avg("e").alias("eps_mean"))


def cluster_quality(scores: DataFrame, clusters: DataFrame, threshold: float, probe: float = 0.35, uid: str = "author_uid") -> DataFrame:
    """One row: pairs merged under and pairs apart at or over ``threshold`` and ``probe``, with their rates, the ranges of ``score_ranges``, clusters and the share of those of one mention."""
    return held_quality(with_clusters(scores, clusters, uid), clusters, threshold, probe, uid)


def held_quality(joined: DataFrame, clusters: DataFrame, threshold: float, probe: float = 0.35, uid: str = "author_uid", weight: str | None = None) -> DataFrame:
    """``cluster_quality`` of pairs (hit, cosine_sim, distance) that are held against the clusters already; ``weight``: the column that says how many pairs a row stands for."""
    same, c = F.col("hit"), F.col("cosine_sim")
    n = lambda x: counted(x, weight)
    names = ["merged_low_conf_count", "split_high_sim_count", "merged_low_conf_count_probe", "split_high_sim_count_probe"]
    counts = joined.agg(n(F.lit(True)).alias("n_pairs_evaluated"), n(same & (c < threshold)).alias(names[0]), n(~same & (c >= threshold)).alias(names[1]), n(same & (c < probe)).alias(names[2]), n(~same & (c >= probe)).alias(names[3]))
    rates = counts.select("*", *[(F.col(x) / F.greatest("n_pairs_evaluated", F.lit(1))).alias(x.replace("count", "rate")) for x in names])
    sizes = clusters.groupBy("block_key", uid).agg(F.count("*").alias("n")).agg(F.count("*").alias("cluster_count"), F.coalesce(F.avg((F.col("n") == 1).cast("double")), F.lit(0.0)).alias("singleton_ratio"))
    return rates.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(score_ranges(joined, weight)))


def uid_checks(mentions: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: most uids of a mention, share of mentions with a cluster, most global uids of a local one and the reverse, clusters and blocks."""
    local = "author_uid_local" if "author_uid_local" in clusters.columns else "author_uid"
    most = lambda by, of, name: clusters.groupBy(by).agg(F.count_distinct(of).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias(name))
    ids = mentions.agg(F.count_distinct("mention_id").alias("mentions"))
    own = clusters.agg(F.count_distinct("mention_id").alias("clustered"), F.count_distinct("author_uid").alias("clusters"), F.count_distinct("block_key").alias("blocks"))
    out = most("mention_id", "author_uid", "uid_uniqueness_max")
    for part in (most(local, "author_uid", "uid_local_to_global_max_nunique"), most("author_uid", local, "uid_global_to_local_max_nunique"), ids, own):
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("mention_coverage", F.col("clustered") / F.greatest("mentions", F.lit(1))).withColumn("uid_local_to_global_valid", F.col("uid_local_to_global_max_nunique") <= 1).withColumn("uid_uniqueness_valid", F.col("uid_uniqueness_max") <= 1)


def seed_report(rows: DataFrame) -> DataFrame:
    """(variant, seed_count, mean and sem of accuracy, precision, recall and f1, n_pairs_mean, n_pairs_total) of per-seed figures (variant, seed, ...)."""
    made = []
    for c in ("accuracy", "precision", "recall", "f1"):
        made += [F.avg(c).alias(f"{c}_mean"), (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_sem")]
    return rows.groupBy("variant").agg(F.count("*").alias("seed_count"), *made, F.avg("n_pairs").alias("n_pairs_mean"), F.sum("n_pairs").alias("n_pairs_total"))


def preflight(mentions: DataFrame, cap: int | None = None, width: int = 256, name_width: int = 50, text_width: int = 768, budget_bytes: int | None = None) -> dict:
    """Sizes of a run before it begins: mentions, blocks, most pairs, and the bytes that vectors, pairs and scores take."""
    pairs = F.expr("n * (n - 1) div 2")
    r = mentions.groupBy("block_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("blocks"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"), F.coalesce(F.sum(F.least(pairs, F.lit(cap)) if cap is not None else pairs), F.lit(0)).alias("pairs")).first()
    size = {"names": r["n"] * name_width * 4, "texts": r["n"] * text_width * 4, "vectors": r["n"] * width * 4, "pairs": r["pairs"] * 96, "scores": r["pairs"] * 24}
    total = sum(size.values())
    return {"n_mentions": r["n"], "n_blocks": r["blocks"], "block_p95": r["p95"] or 0.0, "block_max": r["most"] or 0, "pair_upper_bound": r["pairs"], "estimate_bytes": size | {"total": total}, "memory_feasible": None if budget_bytes is None else total <= budget_bytes}
