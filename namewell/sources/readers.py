"""Readers of source records: Parquet with column pruning, JSON lines, and JSON of unknown shape."""

from __future__ import annotations

import json
import os
import time
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namewell.functions.names import with_block_key
from namewell.operators.tables import cut, enumerate_lines, few

#: Columns that the engine knows; anything else is pruned at load and kept only by the mirror.
KNOWN = ["Bibcode", "bibcode", "Author", "author", "Title_en", "Title", "title", "Abstract_en", "Abstract", "abstract", "Year", "year", "Affiliation", "Affilliation", "aff"]
_TEXT = {"title": ["Title_en", "Title", "title"], "abstract": ["Abstract_en", "Abstract", "abstract"], "bibcode": ["Bibcode", "bibcode"]}


def trim_all(c: Column) -> Column:
    """Trim of any Unicode white space, not of blanks alone."""
    return F.regexp_replace(c, r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")


def first_text(df: DataFrame, names: list[str]) -> Column:
    """The first of ``names`` that is there and not blank, trimmed; else ''."""
    have = [F.nullif(trim_all(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(""))


def split_names(c: Column) -> Column:
    """A name list from a string split at ; and , with blanks dropped."""
    return F.filter(F.transform(F.split(c, "[;,]"), trim_all), lambda x: x != "")


def name_list(df: DataFrame, names: list[str]) -> Column:
    """The first list or string of ``names`` that holds something."""
    found = []
    for n in names:
        if n not in df.columns:
            continue
        c = F.col(f"`{n}`")
        kept = F.filter(F.transform(c, lambda x: trim_all(x.cast("string"))), lambda x: x != "") if df.schema[n].dataType.typeName() == "array" else split_names(c.cast("string"))
        found.append(F.when(F.size(kept) > 0, kept))
    return F.coalesce(*found, F.array().cast("array<string>"))


def affiliations(df: DataFrame, names: list[str], count: Column) -> Column:
    """One affiliation an author: a list is padded with null or cut, a single string is repeated."""
    found = []
    for n in names:
        if n not in df.columns:
            continue
        c = F.col(f"`{n}`")
        if df.schema[n].dataType.typeName() == "array":
            padded = F.slice(F.concat(c.cast("array<string>"), F.array_repeat(F.lit(None).cast("string"), count)), F.lit(1), F.greatest(count, F.lit(1)))
            found.append(F.when(F.exists(c, lambda x: trim_all(x.cast("string")) != ""), padded))
        else:
            found.append(F.when(trim_all(c) != "", F.array_repeat(c, count)))
    return F.coalesce(*found, F.array_repeat(F.lit(None).cast("string"), count))


def valid_year(c: Column) -> Column:
    y = c.try_cast("int")
    return F.when(y.between(1000, 2500), y)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of ``names`` whose value is present, as text or a list cast to text lists; null, NaN, blank and all-blank lists are absent."""
    found = []
    for n in names:
        if n in df.columns:
            c, kind = F.col(f"`{n}`"), df.schema[n].dataType.typeName()
            if kind == "array":
                found.append(F.when(F.exists(c, lambda x: F.coalesce(trim_all(x.cast("string")), F.lit("")) != ""), c.cast("array<string>")))
            else:
                there = c.isNotNull() & (trim_all(c.cast("string")) != "")
                found.append(F.when(there & ~F.isnan(c) if kind in ("double", "float") else there, F.array(c.cast("string"))))
    return F.coalesce(*found, F.lit(None).cast("array<string>"))


def required(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    """``df``, if it has ``columns``."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def normalise(raw: DataFrame, source_type: str, index: Column) -> DataFrame:
    """Source records in the engine's schema; those without a key or an author are left out. ``index`` numbers the rows of the whole source."""
    named = raw.select(
        first_text(raw, _TEXT["bibcode"]).alias("bibcode"), first_text(raw, _TEXT["title"]).alias("title"), first_text(raw, _TEXT["abstract"]).alias("abstract"),
        valid_year(F.coalesce(*[F.col(n).cast("string") for n in ("Year", "year") if n in raw.columns], F.lit(None).cast("string"))).alias("year"),
        name_list(raw, ["Author", "author"]).alias("authors"), F.struct(*[F.col(f"`{n}`") for n in ("Affiliation", "Affilliation", "aff") if n in raw.columns] or [F.lit(1)]).alias("_aff"),
        F.lit(source_type).alias("source_type"), index.cast("long").alias("source_row_idx"),
    )
    flat = named.select("*", "_aff.*") if set(raw.columns) & {"Affiliation", "Affilliation", "aff"} else named
    out = flat.withColumn("aff_list", affiliations(flat, ["Affiliation", "Affilliation", "aff"], F.size("authors")))
    return out.where("bibcode <> '' and size(authors) > 0").select("bibcode", "title", "abstract", "year", F.col("aff_list").alias("aff"), "authors", "source_type", "source_row_idx")


def _there(spark: SparkSession, path: str) -> str:
    """``path``, if it exists."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    return path


def _offsets(parts: DataFrame, by: list[str]) -> DataFrame:
    """``parts`` (by, n), one row a file or split, with ``start``, the rows before it; files come by name, splits by place."""
    return parts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def numbered_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The file or folder with ``_row``, the row's number in the whole source: files in the order of their names, rows as they lie in them."""
    raw = spark.read.parquet(_there(spark, path))
    keep = raw.columns if columns is None else [c for c in columns if c in raw.columns]
    marked = raw.select(*[F.col(f"`{c}`") for c in keep], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = cut(marked.groupBy("_file").agg((F.max("_at") + 1).alias("n")), "files")
    start = _offsets(files, ["_file"]).select("_file", "start")
    return marked.join(few(start, files.count(), 200), "_file").withColumn("_row", F.col("start") + F.col("_at")).drop("_file", "_at", "start")


def numbered_json(spark: SparkSession, path: str) -> DataFrame:
    """(value, _row): the JSON text and number of each record. ``.json`` files may hold lines, a list of objects, one object, objects by key or lists by column; a task reads such a file whole."""
    _there(spark, path)
    if path.rstrip("/").endswith(".json"):
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), "value")

        def run(batches):
            for b in batches:
                for f, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    made = [json.dumps(r) for r in json_records(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(made), pa.string()), pa.array([0] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()), pa.array(made, pa.string())], names=["file", "block", "pos", "value"])

        rows = files.mapInArrow(run, "file string, block long, pos long, value string")
    else:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value").where(trim_all(F.col("value")) != "")
        rows = enumerate_lines(lines, ["file", "block", "value"])
    rows = cut(rows, "lines")
    parts = cut(rows.groupBy("file", "block").agg(F.count("*").alias("n")), "splits")
    start = _offsets(parts, ["file", "block"]).select("file", "block", "start")
    return rows.join(few(start, parts.count(), 200), ["file", "block"]).select("value", (F.col("start") + F.col("pos")).alias("_row"))


def json_records(text: str) -> list[dict]:
    """The objects of a JSON text of one shape or another; what is no object is left out."""
    try:
        found = json.loads(text)
    except ValueError:
        found = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(found, dict):
        key = next((found[k] for k in ("Bibcode", "bibcode") if k in found), None)
        if key is not None and not isinstance(key, (list, dict)):
            found = [found]
        elif all(isinstance(v, dict) for v in found.values()):
            found = _by_column(found) if key is not None else list(found.values())
        elif all(isinstance(v, list) for v in found.values()):
            found = [dict(zip(found, row)) for row in zip_longest(*found.values())]
        else:
            found = [found]
    return [r for r in found if isinstance(r, dict)]


def _by_column(found: dict) -> list[dict]:
    rows: dict = {}
    for c, values in found.items():
        for k, v in values.items():
            rows.setdefault(k, {})[c] = v
    return list(rows.values())


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` (value, _row) with the fields of the JSON texts as columns, their schema inferred from all of them."""
    schema = rows.sparkSession.read.json(rows.select("value").rdd.map(lambda r: r[0])).schema
    return rows.select(F.from_json("value", schema).alias("r"), "_row").select("r.*", "_row")


def read_raw(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A source with ``_row``, by its suffix: .json, .jsonl and .ndjson are JSON, everything else Parquet."""
    bare = path.rstrip("/")
    if bare.endswith((".json", ".jsonl", ".ndjson")):
        return parsed(numbered_json(spark, path))
    return numbered_parquet(spark, path, columns)


def read_parquet(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    return normalise(numbered_parquet(spark, path, KNOWN), source_type, F.col("_row"))


def read_jsonl(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    """JSON lines; blank lines are skipped and not counted."""
    return normalise(parsed(numbered_json(spark, path)), source_type, F.col("_row"))


def read_json(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    return read_jsonl(spark, path, source_type)


def load_source(spark: SparkSession, path: str, source_type: str) -> tuple[DataFrame, dict]:
    """The normalised records of a source and (path, source_type, rows, seconds) of the load; the records are kept in the shared folder."""
    began = time.monotonic()
    out = cut(normalise(read_raw(spark, path, KNOWN), source_type, F.col("_row")), "source")
    return out, {"path": path, "source_type": source_type, "rows": out.count(), "seconds": round(time.monotonic() - began, 3)}


def training_source(folder: str, name: str) -> str:
    """The training table in ``folder``: Parquet before HDF5."""
    tried = [os.path.join(folder, f"{name}.{kind}") for kind in ("parquet", "h5")]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"neither {tried[0]} nor {tried[1]} is there")


def training_mentions(raw: DataFrame, prefix: str = "ROW") -> DataFrame:
    """Labelled mentions of a training table with ``_row``: an id of the row's number, identity from ``@path``, no year, a given block before the computed one."""
    out = with_block_key(raw.select(F.format_string(f"{prefix}:%07d", "_row").alias("bibcode"), first_text(raw, ["name", "author", "author_raw"]).alias("author_raw"), first_text(raw, _TEXT["title"]).alias("title"), first_text(raw, _TEXT["abstract"]).alias("abstract"), F.lit(None).cast("int").alias("year"), first_text(raw, ["@path", "orcid"]).alias("orcid"), first_text(raw, ["block"]).alias("given_block")))
    key = F.coalesce(F.nullif("given_block", F.lit("")), "block_key")
    return out.select(F.concat_ws("::", "bibcode", F.lit("0")).alias("mention_id"), "bibcode", F.lit(0).cast("long").alias("author_idx"), "author_raw", "title", "abstract", "year", key.alias("block_key"), "orcid")
