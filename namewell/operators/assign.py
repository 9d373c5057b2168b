"""From clusters back to the source rows: assignments, entities and mirrored inputs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namewell.operators.tables import cut

COLUMNS = ["source_type", "source_row_idx", "bibcode", "author_idx", "author_raw", "author_uid", "author_uid_local", "author_display_name", "canonical_mention_id", "assignment_kind"]


def clean_alias(c: Column) -> Column:
    """A name with each run of white space made one blank."""
    return F.trim(F.regexp_replace(c, r"[\s\u0085\p{Z}]+", " "))


def scoped(namespace: str | None, local: Column) -> Column:
    """A local uid, within ``namespace`` if there is one."""
    if namespace and "::" in namespace:
        raise ValueError("a namespace may not contain ::")
    return F.concat(F.lit(f"{namespace}::"), local) if namespace else local


def source_positions(records: DataFrame) -> DataFrame:
    """One row a source row and author (blank names dropped first): what is to be assigned."""
    return records.select("source_type", "source_row_idx", "bibcode", F.posexplode(F.filter("authors", lambda x: F.trim(x) != "")).alias("author_idx", "author_raw")).withColumn("author_idx", F.col("author_idx").cast("long"))


def assignments(positions: DataFrame, clusters: DataFrame, canonical: DataFrame, namespace: str | None = None) -> DataFrame:
    """One row a source row and author: the cluster of its mention, or an identifier of its own where there is none.

    ``canonical`` (bibcode, canonical_source_type, canonical_source_row_idx) tells which row is its key's own.  Clusters of one
    mention in two rows are an error.  A cluster's global uid is taken where ``clusters`` has it beside author_uid_local.
    """
    if not clusters.groupBy("mention_id").count().where("count > 1").isEmpty():
        raise ValueError("a mention is in two clusters")
    local = F.col("author_uid_local") if "author_uid_local" in clusters.columns else F.col("author_uid")
    whole = F.col("author_uid") if "author_uid_local" in clusters.columns else scoped(namespace, F.col("author_uid"))
    known = clusters.select(F.col("mention_id").alias("_m"), local.alias("_local"), whole.alias("_uid"))
    own = canonical.select("bibcode", "canonical_source_type", "canonical_source_row_idx").dropDuplicates(["bibcode"])
    out = positions.withColumn("_id", F.concat_ws("::", "bibcode", "author_idx")).join(known, F.col("_id") == F.col("_m"), "left").join(own, "bibcode", "left")
    lone, at = F.col("_uid").isNull(), ["source_type", "source_row_idx", "author_idx"]
    alone = F.concat_ws(".", F.lit("src"), *at)
    first = (F.col("source_type") == F.col("canonical_source_type")) & (F.col("source_row_idx") == F.col("canonical_source_row_idx"))
    return out.select(
        "source_type", "source_row_idx", "bibcode", "author_idx", "author_raw", F.coalesce("_uid", scoped(namespace, alone)).alias("author_uid"), F.when(lone, alone).otherwise(F.col("_local")).alias("author_uid_local"),
        F.when(lone, F.concat_ws("::", F.lit("src"), *at)).otherwise(F.col("_id")).alias("canonical_mention_id"), F.when(lone, "fallback_unmatched").when(F.coalesce(first, F.lit(False)), "canonical").otherwise("projected_duplicate").alias("assignment_kind"),
    )


def entities(assigned: DataFrame) -> DataFrame:
    """One row a uid: its names by frequency, the most frequent as display name, its most frequent local uid, and mentions, documents and canonical mentions."""
    names = assigned.groupBy("author_uid", clean_alias(F.col("author_raw")).alias("alias")).agg(F.count("*").alias("n"))
    lists = names.groupBy("author_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "alias"))), lambda x: x["alias"]).alias("aliases"))
    locals_ = assigned.groupBy("author_uid", "author_uid_local").agg(F.count("*").alias("n")).groupBy("author_uid").agg(F.min_by("author_uid_local", F.struct((-F.col("n")).alias("n"), "author_uid_local")).alias("author_uid_local"))
    sizes = assigned.groupBy("author_uid").agg(F.count("*").alias("mention_count"), F.count_distinct("source_type", "source_row_idx").alias("document_count"), F.count_distinct("canonical_mention_id").alias("unique_mention_count"))
    out = lists.join(locals_, "author_uid").join(sizes, "author_uid")
    return out.select("author_uid", "author_uid_local", F.element_at("aliases", 1).alias("author_display_name"), "aliases", "mention_count", "document_count", "unique_mention_count", F.lit("most_frequent_alias").alias("display_name_method"))


def with_display_names(rows: DataFrame, entity: DataFrame) -> DataFrame:
    """``rows`` (author_uid, ...) with author_display_name."""
    return rows.drop("author_display_name").join(entity.select("author_uid", "author_display_name"), "author_uid", "left")


def mirror(raw: DataFrame, assigned: DataFrame, key: str = "source_row_idx", author_count: str = "n_authors") -> tuple[DataFrame, dict]:
    """``raw`` with AuthorUID and AuthorDisplayName lists, and how many authors are mapped.

    Lists that are there already are replaced, rows without authors get empty ones; a row whose lists do not fit its authors raises.
    The joined rows are written once; the check and the figures are one aggregate over what was written.
    """
    name = F.coalesce("author_display_name", "author_raw").alias("name")
    lists = assigned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("author_idx", "author_uid", name))).alias("_l"), F.count_if(F.col("assignment_kind") == "fallback_unmatched").alias("_f"))
    take = lambda f: F.coalesce(F.transform("_l", f), F.array().cast("array<string>"))
    joined = raw.drop("AuthorUID", "AuthorDisplayName").join(lists, key, "left")
    made = cut(joined.withColumn("AuthorUID", take(lambda x: x.author_uid)).withColumn("AuthorDisplayName", take(lambda x: x["name"])).withColumn("_f", F.coalesce("_f", F.lit(0))).drop("_l"), "mirror")
    wrong = F.size("AuthorUID") != F.col(author_count)
    r = made.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("AuthorUID")), F.lit(0)).alias("n"), F.coalesce(F.sum("_f"), F.lit(0)).alias("f"), F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col(key))).alias("first")).first()
    if r["wrong"]:
        raise ValueError(f"{r['wrong']} rows whose authors and assignments differ, the first {key} {r['first']}")
    return made.drop("_f"), coverage(r["rows"], r["n"], r["n"], r["f"])


def coverage(rows: int, authors: int, mapped: int, fallback: int) -> dict:
    return {"rows_total": rows, "authors_total": authors, "authors_mapped": mapped, "authors_unmapped": authors - mapped, "authors_fallback": fallback, "coverage_rate": mapped / max(1, authors)}


def combined_coverage(parts: list[dict]) -> dict:
    return coverage(*[sum(p[k] for p in parts) for k in ("rows_total", "authors_total", "authors_mapped", "authors_fallback")])
