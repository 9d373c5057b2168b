"""Language by fused evidence.

Four sources speak for a row's language: character trigram likelihoods (a hashed naive Bayes model, tempered by the text's
length, fitted on at most SAMPLE rows of each declared language of at most SAMPLE_BYTES bytes, the ``per_language`` and
``most_bytes`` of ``labelled``), the language its markup or table declares, the public suffix of its address, and its
host.  Host priors come from grouped aggregation over the whole table, smoothed upwards: host over registered domain over
suffix over everything, each level's counts leaving the row itself out.  The posterior is their normalised product.

A text without letters has no likelihood; it is "und" (undetermined) unless the other evidence reaches MIN_POSTERIOR.  So
is any row whose posterior stays under it, and a text whose trigrams are mostly unknown to every language's model.  Null
texts, addresses and declarations are missing evidence; very long texts are read whole; of languages that tie the first
in the alphabet wins; repeated rows count each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_by_size, map_text
from .textkernel import mix64, text_buffers
from .url_filter import host_of

BUCKETS, SAMPLE, SAMPLE_BYTES, CHUNK = 1 << 15, 400, 20_000, 1 << 18
#: General labels that stand before a country's.
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go"]
#: Reliability of a declaration; pseudo-counts of the smoothing; the most nats that a text's likelihoods may differ by.
DECLARED, PSEUDO, MIN_POSTERIOR, TEMPER, UNKNOWN = 0.9, 8.0, 0.6, 40.0, 0.5


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text) of the letter trigrams (of characters, not bytes) of lower-cased texts, digits, marks and white space being word ends.

    CHUNK characters at a time, two more being read beside them, so that memory is bounded however long a text is.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(texts)
    data, _ = text_buffers(texts)
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    line = bytes(data).decode("utf-8")
    for a in range(0, len(line) - 2, CHUNK):
        points = np.frombuffer(line[a : a + CHUNK + 2].encode("utf-32-le"), np.uint32)
        letter = (points >= 128) | ((points >= 97) & (points <= 122))
        use = np.flatnonzero(letter[1:-1] & (letter[:-2] | letter[2:]))
        doc = np.searchsorted(offsets, use + a, "right") - 1
        inside = use + a + 2 < offsets[doc + 1]
        use, doc = use[inside], doc[inside]
        b = np.where(letter, points, np.uint32(32)).astype(np.uint64)
        yield (mix64((b[use] << np.uint64(42)) | (b[use + 1] << np.uint64(21)) | b[use + 2]) % np.uint64(BUCKETS)).astype(np.int64), doc


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # float32 [BUCKETS, langs] log likelihoods
    known: np.ndarray  # bool [BUCKETS]

    def likelihoods(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """([n, langs] tempered log likelihoods, trigram counts, share of unknown trigrams)."""
        rows = len(texts)
        sums, n, unknown = np.zeros((rows, len(self.langs))), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for cells, doc in _trigrams(texts):
            for j in range(len(self.langs)):
                sums[:, j] += np.bincount(doc, self.table[:, j][cells], rows)
            n += np.bincount(doc, minlength=rows)
            unknown += np.bincount(doc, ~self.known[cells], rows).astype(np.int64)
        sums -= sums.max(axis=1, keepdims=True)
        return np.maximum(sums, -TEMPER), n, unknown / np.maximum(n, 1)


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, language) rows; languages in alphabetical order."""
    langs = sorted({y for _, y in rows})
    counts = np.zeros((len(langs), BUCKETS))
    for j, lang in enumerate(langs):
        for cells, _ in _trigrams(pa.array([t for t, y in rows if y == lang])):
            counts[j] += np.bincount(cells, minlength=BUCKETS)
    table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return Model(langs, np.ascontiguousarray(table.T, np.float32), counts.sum(axis=0) > 0)


def labelled(docs: DataFrame, per_language: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(text, language) of at most ``per_language`` rows of each declared language, of at most ``most_bytes`` each, chosen by a hash of id and text, whatever the partitioning."""
    known = docs.select(F.col("doc_id").alias("i"), "text", F.col("lang").alias("l"), F.xxhash64("text").alias("h")).where(F.col("l").isNotNull() & F.col("i").isNotNull() & (F.octet_length("text") <= most_bytes))
    sizes = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not sizes:
        return []
    order = F.struct(F.xxhash64("i", "h").alias("o"), "i", "h")
    # rows under a language's own threshold, about four times as many as wanted, are ranked; where so few are under it that they may not suffice, all are
    share = F.coalesce(*[F.when(F.col("l") == lang, F.lit(min(1.0, 4.0 * per_language / n if n > 40 * per_language else 1.0))) for lang, n in sorted(sizes.items())])
    low = F.xxhash64("i", "h").cast("double") / float(1 << 64) + 0.5
    under = known.where(low <= share)
    rank = F.row_number().over(Window.partitionBy("l").orderBy(order))
    picked = under.select("l", "i", "h").withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.col("l").alias("pl"), F.col("i").alias("pi"), F.col("h").alias("ph")).distinct()
    rows = known.join(F.broadcast(picked), (F.col("i") == F.col("pi")) & (F.col("l") == F.col("pl")) & (F.col("h") == F.col("ph"))).dropDuplicates(["i", "l", "h"]).select("i", "text", "l").collect()
    return [(r["text"], r["l"]) for r in sorted(rows, key=lambda r: (str(r["i"]), r["l"], r["text"]))]


def page_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, "&[a-zA-Z#0-9]{1,8};", " ")


def markup_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (key, text, declared, host) as (key, lang, posterior, text_lang, declared, host, trigrams)."""
    langs, k = model.langs, len(model.langs)
    if not k:
        return rows.select("key", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), "declared", "host", F.lit(0).cast("long").alias("trigrams"))

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        ll, n, strange = model.likelihoods(b.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * (b.num_rows + 1), k), pa.int32()), pa.array(ll.ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), lists, pa.array(n, pa.int64()), pa.array(strange)], names=["key", "declared", "host", "ll", "trigrams", "strange"])

    types = dict(rows.dtypes)
    given = rows.select("key", F.col("text"), "declared", "host")
    seen = cut(map_text(given, "text", read, f"key {types['key']}, declared string, host string, ll array<double>, trigrams long, strange double", 1 << 19), "evidence")
    names = F.array(*[F.lit(x) for x in langs])
    labels = F.split("host", r"\.")
    # the public suffix is the last label, or the last two where a country's label follows a general one (co.uk)
    own = F.when((F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(SECOND_LEVEL), 2).otherwise(1)
    tail = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    seen = seen.withColumn("suffix", F.when(F.col("host").isNotNull(), tail(own))).withColumn("domain", F.when(F.col("host").isNotNull(), tail(own + 1)))
    top = F.array_position("ll", F.array_max("ll"))
    # a row's vote: its text's language where it has letters of one
    seen = cut(seen.withColumn("vote", F.when((F.col("trigrams") > 0) & (F.col("strange") < UNKNOWN), F.element_at(names, top.cast("int")))), "votes")
    votes = [F.count_if(F.col("vote") == x) for x in langs]
    tally = lambda *by: seen.where("host is not null").groupBy(*by).agg(F.array(*votes).alias("c"))
    hosts = cut(tally("host", "domain", "suffix"), "hosts")
    total = lambda of, by: of.groupBy(by).agg(F.array(*[F.sum(F.col("c")[j]) for j in range(k)]).alias(f"c_{by}"))
    prior = hosts.join(total(hosts, "domain"), "domain").join(total(hosts, "suffix"), "suffix").select("host", "c", "c_domain", "c_suffix")
    prior = cut(prior.withColumnRenamed("host", "_host"), "priors")
    everything = seen.agg(*[v.alias(x) for v, x in zip(votes, langs)]).first()
    whole = F.array(*[F.lit(float(everything[x])) for x in langs])
    joined = join_by_size(seen, prior, prior.count(), F.col("host") == F.col("_host"), "left", 256 + 24 * k)
    # counts without the row itself, then one level smoothed by the next
    own = F.transform(names, lambda x: F.when(x.eqNullSafe(F.col("vote")), 1.0).otherwise(0.0))
    less = lambda c: F.zip_with(c, own, lambda a, o: F.greatest(a - o, F.lit(0.0)))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda c, over: F.zip_with(less(c), over, lambda a, p: (a + PSEUDO * p) / (size(less(c)) + PSEUDO))
    joined = joined.withColumn("p0", smooth(whole, F.array_repeat(F.lit(1.0 / k), k)))
    for new, count, over in (("p1", "c_suffix", "p0"), ("p2", "c_domain", "p1"), ("p3", "c", "p2")):
        joined = joined.withColumn(new, F.when(F.col(count).isNull(), F.col(over)).otherwise(smooth(F.col(count), F.col(over))))
    said = F.transform(names, lambda x: F.when(F.array_contains(names, F.col("declared")), F.when(x == F.col("declared"), F.log(F.lit(DECLARED))).otherwise(F.log(F.lit((1 - DECLARED) / max(1, k - 1))))).otherwise(0.0))
    logs = F.zip_with(F.zip_with("ll", said, lambda a, b: a + b), F.transform("p3", lambda p: F.log(p)), lambda a, b: a + b)
    joined = joined.withColumn("logs", logs)
    weights = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    out = joined.withColumn("posterior", 1.0 / size(weights)).withColumn("best", F.element_at(names, F.array_position("logs", F.array_max("logs")).cast("int")))
    sure = (F.col("posterior") >= MIN_POSTERIOR) & ((F.col("trigrams") > 0) | F.col("declared").isNotNull() | F.col("_host").isNotNull()) & (F.col("strange") < UNKNOWN)
    return out.select("key", F.when(sure, F.col("best")).otherwise("und").alias("lang"), "posterior", F.col("vote").alias("text_lang"), "declared", "host", "trigrams")


def page_rows(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select(F.col("page_id").alias("key"), page_text(html).alias("text"), markup_language(html).alias("declared"), host_of(F.col("url")).alias("host"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by a model of the documents' declared languages."""
    model = fit(labelled(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return identify(page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")), model).withColumnRenamed("key", "page_id")
