"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded, hash-chosen sample of the labelled rows.  The ordinary one is
trained by zstandard's own trainer on ordinary text.  The toxic one holds the byte runs that are far more frequent in the
toxic text of a language than in its ordinary text (smoothed ratio over words, and evidence over texts), most frequent
last, before the ordinary content, so that what is ordinary compresses alike under both.  Each text is cut, whole, into
windows of eight words; a window's gain is its compressed length under the ordinary dictionary less that under the toxic
one, and counts where the window holds one of the chosen runs whole (parts of them are ordinary).  Gains over SLACK add up by the language of the run; the score is what is left of them after the gain that ordinary text of as many windows
brings (the rate of the noisiest language, and a spread that grows with the root of the number of windows).  The cut-off is
calibrated on held-out rows, the least score that at most FALSE_RATE of the ordinary ones reach, and the spread on
held-out ordinary rows of a language joined to long ones.

Null and empty texts score 0 and are never toxic; very long ones are scored whole.  Without labels of both kinds nothing
is toxic.  A score that ties with the cut-off is toxic.  Rows repeat as they come; null ids stay null; contradictory
repeated labels count as both; an empty table gives no row; other columns pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text

WINDOW, SLACK, FALSE_RATE = 8, 1, 0.004
#: Lengths of byte runs, how many times as frequent in toxic words a run must be, and the log-likelihood ratio over texts.
GRAMS, LIFT, EVIDENCE = (5, 6, 8, 10), 10, 20
#: Bound of the training sample: rows of each kind, and bytes of a row; of rows longer than that up to LONG_ROWS of each kind.
TOXIC_ROWS, ORDINARY_ROWS, ROW_BYTES, LONG_ROWS, LONG_BYTES = 1500, 6000, 20_000, 40, 1_000_000
#: Bounds of the dictionaries: bytes of the toxic runs, the size that the trainer is asked for, bytes of ordinary content, and the windows it trains on, spread evenly over the ordinary rows.
RUN_BYTES, TRAINER_BYTES, PLAIN_BYTES, TRAINER_WINDOWS = 60_000, 16_384, 14_000, 40_000


def _spelt(word: str) -> bytes:
    return b" " + word.strip(".,!?;:#$%&*|").encode() + b" "


def _words(window: bytes) -> bytes:
    """The window's words as they are spelt in the runs."""
    return b"".join(_spelt(w) for w in window.decode().split())


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().split()
    return [(" " + " ".join(words[i : i + WINDOW]) + " ").encode() for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    cutoff: float
    #: Of each group of runs (those of a language, or of all): a pattern of their least parts, and the rate and spread of their gains in ordinary text.
    proofs: tuple[bytes, ...] = ()
    rates: tuple[float, ...] = ()
    spreads: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        self._made = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "cutoff": self.cutoff, "proofs": self.proofs, "rates": self.rates, "spreads": self.spreads, "_made": None}

    def over(self, gains: tuple[int, ...], n: int) -> int:
        """What is left of ``gains`` beyond those that ``n`` windows of ordinary text stay within."""
        return sum(max(0, g - int(r * n + s * math.sqrt(n))) for g, r, s in zip(gains, self.rates, self.spreads))

    def score(self, text: str | None) -> int:
        return self.over(*self.gain(text))

    def gain(self, text: str | None) -> tuple[tuple[int, ...], int]:
        """(gains over SLACK of each group of runs, windows)."""
        if not self.toxic:
            return (0,) * len(self.proofs), 0
        if self._made is None:
            params = zs.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=5, strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._made = [zs.ZstdCompressor(compression_params=params, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT)).compress for d in (self.ordinary, self.toxic)] + [[re.compile(p).search for p in self.proofs]]
        plain, toxic, proofs = self._made
        totals, cut = [0] * len(proofs), windows(text)
        for w in cut:
            gain = len(plain(w)) - len(toxic(w))
            if gain > SLACK:
                spelt = _words(w)
                for k, proof in enumerate(proofs):
                    if proof(spelt):
                        totals[k] += gain - SLACK
                        break
        return tuple(totals), len(cut)


def _grams(b: bytes) -> set[bytes]:
    return {b[i : i + n] for n in GRAMS for i in range(len(b) - n + 1)}


def _distinct(texts: list[str]) -> list[str]:
    """``texts`` without near copies, which would make chance runs look frequent: those that share one of three least hashes of word triples."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        words = t.lower().split()
        triples = [" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))]
        keys = {(k, min(zlib.crc32(x, k) for x in triples)) for k in (1, 2, 3)}
        if seen.isdisjoint(keys):
            out.append(t)
        seen |= keys
    return out


def _evidence(a: int, nt: int, b: int, no: int) -> float:
    """Log-likelihood ratio of a run found in ``a`` of ``nt`` toxic and ``b`` of ``no`` ordinary texts."""
    term = lambda k, n, p: (k * math.log(k / n / p) if k else 0) + ((n - k) * math.log((1 - k / n) / (1 - p)) if k < n else 0)
    p = (a + b) / (nt + no)
    return 2 * (term(a, nt, p) + term(b, no, p))


def toxic_runs(toxic: list[str], plain: list[str]) -> tuple[Counter, set[bytes]]:
    """Byte runs of toxic words with the number of toxic texts that have them, and the least parts of them that ordinary texts hold far more seldom."""
    if not toxic or not plain:
        return Counter(), set()
    texts, words = [Counter(), Counter()], [Counter(), Counter()]
    for k, rows in enumerate((toxic, plain)):
        for t in rows:
            n = Counter(t.lower().split())
            words[k].update(n)
            if not k:
                texts[0].update({g for w in n for g in _grams(_spelt(w))})
    wanted = {g for g, k in texts[0].items() if k >= 3}
    texts[0] = Counter({g: texts[0][g] for g in wanted})
    tokens = [Counter(), Counter()]
    for k in (0, 1):
        for w, n in words[k].items():
            for g in _grams(_spelt(w)) & wanted:
                tokens[k][g] += n
    size = [sum(c.values()) for c in words]
    wanted = {g for g in wanted if (tokens[0][g] + 0.5) / (size[0] + 1) >= LIFT * (tokens[1][g] + 0.5) / (size[1] + 1)}
    has = {w: found for w in words[0].keys() | words[1].keys() if (found := _grams(_spelt(w)) & wanted)}
    del words, tokens
    for t in plain:
        texts[1].update({g for w in set(t.lower().split()) if w in has for g in has[w]})
    keep = {g for g in wanted if _evidence(texts[0][g], len(toxic), texts[1][g], len(plain)) >= EVIDENCE}
    runs: Counter = Counter()
    for t in toxic:
        found = set()
        for w in set(t.lower().split()):
            if w in has and not has[w].isdisjoint(keep):
                b = _spelt(w)
                at = [(i, i + n) for n in GRAMS for i in range(len(b) - n + 1) if b[i : i + n] in keep]
                found.add(b[min(x for x, _ in at) : max(y for _, y in at)])
        runs.update(found)
    runs = Counter({k: v for k, v in runs.items() if v >= 3})
    held = b"\0".join(runs)
    least = {g for g in keep if not any(g[i : i + n] in keep for n in GRAMS if n < len(g) for i in range(len(g) - n + 1))}
    return runs + Counter({g: texts[0][g] for g in keep if g not in held}), least


def fit(rows: list[tuple], run_bytes: int = RUN_BYTES, plain_bytes: int = PLAIN_BYTES, trainer_windows: int = TRAINER_WINDOWS) -> Model:
    """A model from (text, toxic) or (text, toxic, language) rows in a fixed order; every third row is held out for the cut-off.

    The bounds are of the fit alone: of the toxic runs the most frequent ``run_bytes`` stay, the ordinary dictionary is
    trained on every n-th window of the ordinary rows, n so chosen that about ``trainer_windows`` are left, and holds ``plain_bytes``.
    """
    train, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    language = lambda r: r[2] if len(r) > 2 else None
    copies = {r[0] for r in train if r[1]} - set(_distinct([r[0] for r in train if r[1]]))
    toxic, plain = list(dict.fromkeys(r[0] for r in train if r[1] and r[0] not in copies)), [r[0] for r in train if not r[1]]
    if not toxic or not plain:
        return Model(b"", b"", 1)
    runs, least = toxic_runs(toxic, plain)
    parts = []
    for g in sorted({language(r) for r in train} - {None}):
        more, part = toxic_runs([t for t in dict.fromkeys(r[0] for r in train if r[1] and language(r) == g) if t not in copies], [r[0] for r in train if not r[1] and language(r) == g])
        runs |= more
        parts.append(part)
    parts = [p for p in [*parts, least.difference(*parts)] if p]
    special = b"".join(k for k, v in sorted(runs.items(), key=lambda x: (x[1], x[0])))[-run_bytes:]
    step = max(1, sum(-(-len(t.split()) // WINDOW) for t in plain) // trainer_windows)
    samples = list(islice((w for t in plain for w in windows(t)), 0, None, step))
    try:
        ordinary = zs.train_dictionary(TRAINER_BYTES, samples, k=64, d=8).as_bytes()[-plain_bytes:]
    except zs.ZstdError:  # too few samples to train on: their text is the dictionary
        ordinary = b"".join(samples)[-plain_bytes:] or b"        "
    model = Model(ordinary, special + ordinary if special else b"", 1, tuple(b"|".join(re.escape(g) for g in sorted(p)) for p in parts))
    clean: dict = {}
    for r in held:
        if not r[1]:
            clean.setdefault(language(r), []).append(model.gain(r[0]))
    calibrate(model, list(clean.values()))
    return model


def calibrate(model: Model, clean: list[list[tuple[tuple[int, ...], int]]]) -> None:
    """Rates, spreads and cut-off from the (gains, windows) of held-out ordinary rows, a list for each language; the noisiest counts."""
    rates, variances = [0.0] * len(model.proofs), [0.0] * len(model.proofs)
    for rows in clean:
        n = sum(w for _, w in rows)
        for k in range(len(rates) if n else 0):
            rate = sum(g[k] for g, _ in rows) / n
            variance = sum((g[k] - rate * w) ** 2 for g, w in rows) / n
            rates[k] = max(rates[k], rate + 3 * math.sqrt(variance / n))  # with the error of its estimate
            variances[k] = max(variances[k], variance)
    model.rates = tuple(rates)
    total = lambda part: (tuple(map(sum, zip(*(g for g, _ in part)))), sum(w for _, w in part))
    joined = [total(rows[i : i + many]) for rows in clean for many in (4, 16, 64, 256) for i in range(0, len(rows), many)]
    for z in (3, 4, 5, 6, 8, 10, 12):
        model.spreads = tuple(z * math.sqrt(v) for v in variances)
        scores = sorted(model.over(*r) for rows in clean for r in rows)
        model.cutoff = (scores[-1 - int(FALSE_RATE * len(scores))] if scores else 0) + 1
        if sum(model.over(*r) >= model.cutoff for r in joined) <= FALSE_RATE * len(joined):
            break


def labelled(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> list[tuple[str, int, str | None]]:
    """(text, toxic, declared language) of the bounded sample, chosen by a hash of the id (of any type) and so alike for every partitioning."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("k"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("y")).distinct()
    size, order = F.octet_length("text"), (F.xxhash64("k"), "k")
    picked = None
    for y, n in ((1, toxic_rows), (0, ordinary_rows)):
        part = known.where(F.col("y") == y).orderBy(*order).limit(n)
        picked = part if picked is None else picked.unionByName(part)
    given = docs.select(F.col("doc_id").alias("i"), "text", (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("g"))
    found = given.join(F.broadcast(picked), F.col("i") == F.col("k")).select("k", F.xxhash64("k").alias("o"), "y", "g", "text")
    rows = found.where(size <= ROW_BYTES).collect()
    for y in (1, 0):
        rows += found.where((F.col("y") == y) & (size > ROW_BYTES) & (size <= LONG_BYTES)).orderBy(*order, F.xxhash64("text")).limit(LONG_ROWS).collect()
    return [(r["text"], r["y"], r["g"]) for r in sorted(rows, key=lambda r: (r["o"], str(r["k"]), r["y"], r["text"], r["g"] or ""))]


def scored(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", score: str = "_score") -> DataFrame:
    """``columns`` of ``docs`` with the column ``score``, which may not be one of them; the text column is read whole."""
    if score.lower() in {c.lower() for c in columns}:
        raise ValueError(f"there is a column {score} already")
    given = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_col])])
    at = given.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(columns))], s], names=[*columns, score])

    return map_text(given, text_col, run, given.select(*[F.col(f"`{c}`") for c in columns]).withColumn(score, F.lit(0).cast("long")).schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs, model, ["doc_id"]).select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= model.cutoff).alias("toxic"))
