"""URL filters by a trie over reversed host labels and path segments.

A rule is ``host[/path]`` with an action, allow or block.  ``example.com`` also speaks for its subdomains; with a path it
speaks for that host alone and for paths that begin with those whole segments.  The deepest rule that a URL meets
decides; host-and-path rules lie deeper than any rule of the host; of equal rules block wins; a URL that meets none is
allowed (``rule`` is null).  Rules go to every task as one trie while they are at most MAX_RULES rows and RULE_BYTES
bytes; beyond it the URLs' own keys are joined with the rules by shuffle, with the same result.

Both ways read rules and hosts alike, by the same expressions: white space around a rule goes, hosts are compared in
lower case without empty labels (``a..example.com`` is ``a.example.com``, ``example.com.`` is ``example.com``), paths by
their non-empty segments, as written.  Null and unparseable URLs, and those whose host has no label, have a null host and
are blocked with the rule null.  Rules that are null, blank, without a host or of another action are left out.  Repeated
rows give a row each; an empty table gives none; very long URLs are read whole; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepared

RULES = [
    ("example.org", "block"), ("m.thernd.example.com", "block"), ("example.com", "allow"), ("thther.example.org", "allow"),
    ("tionsh.example.net/de", "block"), ("tionsh.example.net/en", "allow"), ("blog.ththsh.example.org/de", "allow"),
    ("example.net", "allow"), ("ththhe.example.net", "block"), ("ththhe.example.net/fr", "allow"), ("therha.example.com", "block"),
]
MAX_RULES, RULE_BYTES = 1_000_000, 64 << 20


def _labels(host: Column) -> Column:
    return F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def host_of(url: Column) -> Column:
    """The host in lower case without empty labels; null where there is none."""
    return F.nullif(F.array_join(_labels(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), "."), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def rule_rows(rules: DataFrame) -> DataFrame:
    """(rule, host, segments, action) of the usable ``rules`` (pattern, action): each different one once, block before allow."""
    bare = F.regexp_replace("pattern", r"^\s+|\s+$", "")
    parts = rules.where("action in ('allow', 'block')").select(F.array_join(_labels(F.substring_index(bare, "/", 1)), ".").alias("host"), _segments(F.when(F.contains(bare, F.lit("/")), F.regexp_replace(bare, "^[^/]*/", "")).otherwise(F.lit(""))).alias("segments"), "action")
    return parts.where("host <> ''").groupBy("host", "segments").agg(F.max("action").alias("action")).select(F.concat_ws("/", F.concat(F.array("host"), "segments")).alias("rule"), "host", "segments", "action")


def build_trie(rules: list[tuple[str, list[str], str, str]]) -> dict:
    """Nested dicts of (host, segments, rule, action): host labels from the right, then 0 and path segments; the key None holds (rule, action)."""
    root: dict = {}
    for host, segments, rule, action in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        if segments:
            node = node.setdefault(0, {})
            for s in segments:
                node = node.setdefault(s, {})
        node[None] = (rule, action)
    return root


def look_up(trie: dict, host: str | None, path: str | None) -> tuple[str | None, str]:
    if not host:
        return None, "block"
    node, found = trie, (None, "allow")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            return found
        found = node.get(None, found)
    node = node.get(0)
    for s in (path or "").split("/"):
        if node is None:
            break
        if s:
            node = node.get(s)
            if node is not None:
                found = node.get(None, found)
    return found


def decide(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """(page_id, url, host, rule, action) of every row of ``pages``; ``rules`` has the columns pattern and action."""
    usable = rule_rows(rules)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    size = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)).alias("b")).first()
    if size["n"] <= max_rules and size["b"] <= RULE_BYTES:
        trie = rows.sparkSession.sparkContext.broadcast(build_trie([(r["host"], r["segments"], r["rule"], r["action"]) for r in usable.collect()]))

        def run(batches):
            for b in batches:
                got = [look_up(trie.value, h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "url", "host", "rule", "action"])

        prepared(rows.sparkSession)
        return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, host string, rule string, action string")
    labels, segs, n = F.split("host", r"\."), _segments(F.col("path")), F.size(F.split("host", r"\."))
    upper = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, n - i + 1, i), ".").alias("k")))
    deeper = F.when(F.size(segs) > 0, F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.struct((n + i).alias("depth"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice(segs, 1, i), "/")).alias("k")))).otherwise(F.array().cast("array<struct<depth:int,k:string>>"))
    urls = rows.where("host is not null").select("host", "path").distinct()
    met = urls.select("host", "path", F.explode(F.concat(upper, deeper)).alias("x")).select("host", "path", "x.*").join(usable.select("rule", "action"), F.col("k") == F.col("rule"))
    best = cut(met.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(F.struct("depth", "rule", "action")).alias("b")), "met")
    out = rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return out.select("page_id", "url", "host", F.col("b.rule").alias("rule"), F.when(F.col("host").isNull(), "block").otherwise(F.coalesce("b.action", F.lit("allow"))).alias("action"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every page's URL under RULES."""
    return decide(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "pattern string, action string"))


ORACLE_SQL = f"""
with rules(pattern, action) as (values {", ".join(f"('{p}', '{a}')" for p, a in RULES)}),
u as (select page_id, url, nullif(array_to_string(list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.'), x -> x <> ''), '.'), '') as host,
             list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), x -> x <> '') as segs from pages),
r as (select pattern, action, split_part(pattern, '/', 1) as h, list_filter(string_split(pattern, '/')[2:], x -> x <> '') as s from rules),
m as (select u.page_id, u.url, u.host, r.pattern, r.action, len(string_split(r.h, '.')) + len(r.s) as depth
      from u left join r on case when len(r.s) > 0 then u.host = r.h and u.segs[1:len(r.s)] = r.s else u.host = r.h or ends_with(u.host, '.' || r.h) end)
select page_id, url, host, arg_max(pattern, depth) as "rule",
       case when host is null then 'block' else coalesce(arg_max(action, depth), 'allow') end as action
from m group by page_id, url, host
"""
