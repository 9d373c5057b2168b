"""Sinks: tables, mirrored JSON, reports of a run."""

from __future__ import annotations

import json
import os
import re
import tempfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


def write_table(df: DataFrame, path: str, files: int | None = None) -> str:
    """``df`` as Parquet; the output committer puts files in place only when they are whole. ``files`` for contracts that want few."""
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
    return path


def write_sorted(df: DataFrame, path: str, by: list[str]) -> str:
    """``df`` as Parquet, sorted over all its files."""
    df.orderBy(*by).write.mode("overwrite").parquet(path)
    return path


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> str:
    """``df`` as JSON lines, nulls kept, in the order of ``by`` over all files."""
    (df.orderBy(by).drop(by) if by else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_report(payload: dict, path: str) -> str:
    """A small JSON file on the driver, put in place at once."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as f:
        json.dump(payload, f, indent=2, ensure_ascii=False, default=str)
    os.replace(f.name, path)
    return path


def read_report(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def read_config(given: dict | str | None, default: dict, what: str = "config") -> dict:
    """A mapping as it is, a JSON (or, where a parser is installed, YAML) file, or the ``default``."""
    if given is None:
        return dict(default)
    if isinstance(given, dict):
        return dict(given)
    if not os.path.exists(given):
        raise FileNotFoundError(f"{what}: {given}")
    with open(given, encoding="utf-8") as f:
        text = f.read()
    if given.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as gone:
            raise ValueError(f"{what}: no YAML parser is installed, give JSON") from gone
        made = yaml.safe_load(text)
    else:
        made = json.loads(text)
    if not isinstance(made, dict):
        raise ValueError(f"{what}: {given} holds no mapping")
    return made


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%SZ")


def valid_tag(tag: str) -> str:
    if not _TAG.fullmatch(tag):
        raise ValueError(f"{tag!r} is no tag: up to 64 letters, digits, dots, hyphens and underscores, a letter or digit first")
    return tag


def consistent(name: str, paths: list[str]) -> bool:
    """Whether all reports that are there speak of the run ``name``."""
    return all(read_report(p).get("run_id") == name for p in paths if os.path.exists(p))


def cluster_report(rows: list[dict]) -> str:
    """A Markdown table of per-variant figures."""
    if not rows:
        return "No figures.\n"
    names = list(rows[0])
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else "-" if x is None else str(x)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows]]) + "\n"


def with_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``_sha1`` of typed, length-prefixed ``columns``; null differs from empty."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        text = F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
        parts += [F.lit(f"{c}/{kinds[c]}="), text, F.lit(";")]
    return df.withColumn("_sha1", F.sha1(F.concat(*parts)))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, fingerprint) of the whole table, whatever the order of its rows: sums of three parts of the rows' hashes, hashed."""
    part = lambda a: F.sum(F.conv(F.substring("_sha1", a, 12), 16, 10).cast("decimal(38,0)"))
    return with_fingerprint(df, columns).agg(F.count("*").alias("rows"), F.sha1(F.concat_ws("/", F.count("*").cast("string"), *[F.coalesce(part(a), F.lit(0)).cast("string") for a in (1, 13, 25)])).alias("fingerprint"))
