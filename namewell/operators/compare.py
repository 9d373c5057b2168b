"""A run held against a baseline: partitions, figures, seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def partition_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(block_key, mentions, baseline_clusters, current_clusters, changed) of every block of either run (mention_id, block_key, author_uid).

    A block drifts if its sets of mentions differ, whatever their labels; in one that does, a mention has changed if it is on one
    side alone or its label differs.  Others have 0.
    """
    mark = lambda df, n: df.select("mention_id", "block_key", F.col("author_uid").alias(f"u{n}"), F.min("mention_id").over(Window.partitionBy("block_key", "author_uid")).alias(f"s{n}"))
    both = mark(old, 1).join(mark(new, 2), ["mention_id", "block_key"], "full_outer")
    moved = ~F.col("s1").eqNullSafe(F.col("s2"))
    counted = both.groupBy("block_key").agg(F.count("*").alias("mentions"), F.count_distinct("u1").alias("baseline_clusters"), F.count_distinct("u2").alias("current_clusters"), F.count_if(moved).alias("_moved"), F.count_if(~F.col("u1").eqNullSafe(F.col("u2"))).alias("_n"))
    return counted.select("block_key", "mentions", "baseline_clusters", "current_clusters", F.when(F.col("_moved") > 0, F.col("_n")).otherwise(0).alias("changed"), (F.col("_moved") > 0).alias("drifts"))


def drift_summary(old: DataFrame, new: DataFrame, top: int = 10) -> dict:
    """Mentions compared, on one side alone and changed, blocks that drifted, and the ``top`` of these."""
    ids = old.select("mention_id", F.lit(1).alias("_o")).join(new.select("mention_id", F.lit(1).alias("_n")), "mention_id", "full_outer")
    r = ids.agg(F.count_if(F.col("_o").isNotNull() & F.col("_n").isNotNull()).alias("both"), F.count_if(F.col("_n").isNull()).alias("gone"), F.count_if(F.col("_o").isNull()).alias("come")).first()
    blocks = partition_drift(old, new).where("drifts")
    drifted = blocks.select("block_key")
    near = old.select("mention_id", "block_key", F.col("author_uid").alias("a")).join(new.select("mention_id", "block_key", F.col("author_uid").alias("b")), ["mention_id", "block_key"], "full_outer").join(drifted, "block_key", "left_semi")
    changed = near.where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count_distinct("mention_id").alias("n")).first()["n"]
    rows = [x.asDict() for x in blocks.drop("drifts").orderBy(F.desc("changed"), "block_key").limit(top).collect()]
    return {"total_mentions_compared": r["both"], "missing_in_current": r["gone"], "missing_in_baseline": r["come"], "changed_mentions": changed, "changed_blocks": blocks.count(), "top_changed_blocks": rows}


def seconds_of(payload: dict | None, prefix: str = "") -> dict[str, float]:
    """The figures of a nested dictionary whose names speak of seconds, by dotted name."""
    out: dict[str, float] = {}
    for name, value in (payload or {}).items():
        path = f"{prefix}.{name}" if prefix else str(name)
        if isinstance(value, dict):
            out |= seconds_of(value, path)
        elif isinstance(value, (int, float)) and not isinstance(value, bool) and ("seconds" in str(name) or str(name).endswith("_s")):
            out[path] = float(value)
    return out


def compare_seconds(old: dict | None, new: dict | None, top: int = 15) -> dict:
    """Common figures with their change and speed-up, names on one side alone, and the ``top`` gains and losses."""
    a, b = seconds_of(old), seconds_of(new)
    made = {k: {"baseline": a[k], "current": b[k], "delta": b[k] - a[k], "pct_delta": (b[k] - a[k]) / a[k] if a[k] else None, "improvement_seconds": a[k] - b[k], "speedup": a[k] / b[k] if b[k] > 0 else None} for k in sorted(a.keys() & b.keys())}
    gains = sorted(made, key=lambda k: (-made[k]["improvement_seconds"], k))
    losses = sorted(made, key=lambda k: (made[k]["improvement_seconds"], k))
    pick = lambda names, ok: [{"metric": k, **made[k]} for k in names if ok(made[k]["improvement_seconds"])][:top]
    return {"metrics": made, "baseline_only_metrics": sorted(a.keys() - b.keys()), "current_only_metrics": sorted(b.keys() - a.keys()), "top_improvements": pick(gains, lambda x: x > 0), "top_regressions": pick(losses, lambda x: x < 0)}


def compare_figures(old: dict, new: dict, names: list[str]) -> dict:
    """Both values and the change of each named figure; null where either is missing."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return {n: {"baseline": old.get(n), "current": new.get(n), "delta": new[n] - old[n] if number(old.get(n)) and number(new.get(n)) else None} for n in names}
