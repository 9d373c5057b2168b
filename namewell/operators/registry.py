"""Stable identifiers across runs: a registry of mentions, merged identifiers as aliases, new numbers by rank.

A registry is three things: ``members`` (mention_id, uid), ``aliases`` (uid, kept) and the next number.  A cluster keeps the
identifier that its members have; where they have several, all of them become one, the least, and the others its aliases.
Which identifiers become one is the connected components of "held by one cluster" over all clusters of the run, so the
result does not depend on the clusters' order: a cluster that holds only a lost identifier gets the kept one, in this run and later.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewell.operators.graph import spread_labels
from namewell.operators.tables import cut, ranked

VERSION = "1"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame, int]:
    return spark.createDataFrame([], "mention_id string, uid string"), spark.createDataFrame([], "uid string, kept string"), 1


def assign(clusters: DataFrame, registry: tuple[DataFrame, DataFrame, int], namespace: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame, int], dict]:
    """``clusters`` (mention_id, author_uid) with the registry's uid as author_uid and the given one as author_uid_local; the new registry; counts.

    A mention in two clusters is an error.  New numbers go by the clusters' first mentions.
    """
    if "::" in namespace:
        raise ValueError("a namespace may not contain ::")
    members, aliases, number = registry
    local = "author_uid_local" if "author_uid_local" in clusters.columns else "author_uid"
    rows = cut(clusters.withColumn("author_uid_local", F.col(local)).drop("author_uid"), "clusters")
    if not rows.groupBy("mention_id").count().where("count > 1").isEmpty():
        raise ValueError("a mention is in two clusters")
    old = cut(members.join(aliases, "uid", "left").select("mention_id", F.coalesce("kept", "uid").alias("uid")), "members")
    held = cut(rows.join(old, "mention_id").groupBy("author_uid_local").agg(F.collect_set("uid").alias("uids")), "held")
    edges = held.where("size(uids) > 1").select(F.explode("uids").alias("a"), F.array_min("uids").alias("b")).where("a <> b")
    merged = cut(spread_labels(edges).where("node <> root").select(F.col("node").alias("uid"), F.col("root").alias("kept")), "merged")
    known = held.select("author_uid_local", F.array_min("uids").alias("uid"), (F.size("uids") > 1).alias("conflict")).join(merged, "uid", "left").select("author_uid_local", F.coalesce("kept", "uid").alias("uid"), "conflict")
    first = rows.groupBy("author_uid_local").agg(F.min("mention_id").alias("first"))
    fresh = cut(ranked(first.join(known, "author_uid_local", "left_anti"), ["first"], "_r").select("author_uid_local", F.format_string(f"{namespace}::au%09d", F.col("_r") + number).alias("uid"), F.lit(False).alias("conflict")), "fresh")
    new = fresh.count()
    uids = cut(known.unionByName(fresh), "uids")
    named = cut(rows.join(uids.select("author_uid_local", F.col("uid").alias("author_uid")), "author_uid_local"), "named")
    # what was known follows its merged uid; what is new is added
    kept = old.join(merged, "uid", "left").select("mention_id", F.coalesce("kept", "uid").alias("uid"))
    after = kept.join(named.select("mention_id"), "mention_id", "left_anti").unionByName(named.select("mention_id", F.col("author_uid").alias("uid")))
    chain = aliases.join(merged.select(F.col("uid").alias("kept"), F.col("kept").alias("_k")), "kept", "left").select("uid", F.coalesce("_k", "kept").alias("kept"))
    out = (cut(after, "registry"), cut(chain.unionByName(merged), "aliases"), number + new)
    n = named.join(old.select("mention_id", F.lit(True).alias("_was")), "mention_id", "left").agg(F.count("*").alias("t"), F.count("_was").alias("w")).first()
    c = uids.agg(F.count("*").alias("t"), F.count_if("conflict").alias("m")).first()
    meta = {"clusters_total": c["t"], "clusters_reused": c["t"] - new - c["m"], "clusters_new": new, "clusters_merged_conflicts": c["m"], "mentions_total": n["t"], "mentions_previously_mapped": n["w"], "mentions_newly_mapped": n["t"] - n["w"], "registry_size_after": out[0].count(), "next_id_after": out[2]}
    return named, out, meta


def save(registry: tuple[DataFrame, DataFrame, int], folder: str, namespace: str) -> str:
    """The registry in ``folder``, which must not be the one it was read from: tables first, then the file that makes it valid."""
    members, aliases, number = registry
    members.write.mode("overwrite").parquet(f"{folder}/members")
    aliases.write.mode("overwrite").parquet(f"{folder}/aliases")
    meta = json.dumps({"version": VERSION, "namespace": namespace, "next": number})
    members.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return folder


def load(spark: SparkSession, folder: str | None, namespace: str) -> tuple[DataFrame, DataFrame, int]:
    """The registry of ``folder``, an empty one without a folder; another version or namespace is an error."""
    if folder is None:
        return empty(spark)
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta["version"] != VERSION:
        raise ValueError(f"registry version {meta['version']!r}, not {VERSION!r}")
    if meta["namespace"] != namespace:
        raise ValueError(f"registry of {meta['namespace']!r}, not of {namespace!r}")
    return spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/aliases"), max(1, int(meta["next"]))
