"""Private data by bootstrapped contextual extraction.

Candidates are identifier-shaped runs (with a digit or an at sign), digit groups apart by blanks or hyphens that pass the
Luhn check, and whatever follows a word such as ``password`` and ``=`` or ``:``.  Seeds are those that a strict recogniser
knows: mail addresses, phone numbers, card numbers, IPv4 addresses, access keys, and values of eight characters at least
keyed by such a word (with ``:`` only if a digit is among them), or letters and digits of sixteen keyed ``token``.  Lexical patterns stand for a candidate: its shape
(letters, hexadecimal runs and digits with their lengths), the key before it (``token =``), being a hexadecimal run with
a key, and its context, the one or two words on its left and the two around it, each with the coarse kind of the value
(a number or a mixed token).  Patterns and instances make a bipartite graph that Spark scores in ROUNDS rounds of grouped
aggregation: a pattern's confidence is the weighted share of its distinct instances believed to be of a kind, an
instance's that of its best pattern.  Patterns of at least MIN_SUPPORT and MIN_CONFIDENCE (CONTEXT_SUPPORT and
CONTEXT_CONFIDENCE for words around a value, which mark only values of CONTEXT_LENGTH letters and digits with a digit)
then mark all their instances, seen as seeds or not.

Null and empty texts give nothing; very long ones are read whole, in time that grows with their length, blanks or not.
Repeated rows give their spans each, though evidence counts distinct instances; null ids stay null.  Of patterns that tie
on confidence the greater kind's name wins.  Without seeds nothing is marked; an empty table gives no row.  Other columns,
whatever their names, are not read by ``spans`` and pass through ``redact``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, join_by_size, map_text

ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MAX_PATTERNS = 3, 3.0, 0.6, 200_000
CONTEXT_SUPPORT, CONTEXT_CONFIDENCE, CONTEXT_LENGTH = 8.0, 0.8, 7
FIELDS = "start long, stop long, value string, patterns array<string>, seed string"

_PHONE_TEXT = r"\+\d{1,3} ?\(?\d{2,4}\)?[ \-]?\d{3}[ \-]?\d{4}(?!\d)"
#: A run is tried at its start alone, and its first part holds no digit, so that text without digits is passed once.
_FIND = re.compile(
    r"(?P<phone>" + _PHONE_TEXT + r")"
    r"|(?<![A-Za-z0-9])(?P<caps>[A-Z0-9]{16,})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z_])(?i:password|passwd|secret|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?(?P<keyed>[^\s\"'<>=,;|]{6,})"
    r"|(?<![\w.+\-])(?P<groups>\d{3,6}(?:[ \-]\d{2,6}){2,4})(?![\w\-])"
    r"|(?<![^\s\"'<>=,;|:])(?P<run>[^\s\"'<>=,;|:+0-9@]*(?:\+(?!\d{1,3} ?\(?\d{2,4}\)?[ \-]?\d{3}[ \-]?\d{4}(?!\d))[^\s\"'<>=,;|:+0-9@]*)*[0-9@](?:[^\s\"'<>=,;|+]|\+(?!\d{1,3} ?\(?\d{2,4}\)?[ \-]?\d{3}[ \-]?\d{4}(?!\d)))*)"
)
_SIGN = re.compile(r"[0-9@]")
_KEY = re.compile(r"([A-Za-z_]{3,24})\s{0,2}([=:])\s{0,2}[\"']?$")
_SECRET = {"password", "passwd", "secret", "api_key", "apikey"}
_TOKEN = {"token", "access_token", "auth_token", "secret_key"}
_MAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_PHONE = re.compile(r"\+\d{1,3} ?\(?\d{2,4}\)?[ \-]?\d{3}[ \-]?\d{4}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
_ACCESS = re.compile(r"A[KS]IA[0-9A-Z]{16}")
_UPPER = re.compile(r"[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{12,}")
_LEFT = re.compile(r"(?:([^\W\d_]{2,24})[ ]+)?([^\W\d_]{2,24})[:]?[ ]+$")
_RIGHT = re.compile(r"[ ]+([^\W\d_]{2,24})(?![\w@])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(value: str) -> str | None:
    """The bare digits of a card-sized number, grouped or not."""
    bare = value.replace(" ", "").replace("-", "")
    return bare if 13 <= len(bare) <= 19 and bare.isascii() and bare.isdigit() else None


def seed_of(value: str, key: str | None, sign: str | None = "=") -> str | None:
    if "@" in value:
        return "mail" if _MAIL.fullmatch(value) else None
    if value[0] == "+":
        return "phone" if _PHONE.fullmatch(value) else None
    if bare := _card(value):
        return "card" if luhn(bare) else None
    if value.count(".") == 3 and _IP.fullmatch(value):
        return "address"
    if _ACCESS.fullmatch(value):
        return "secret"
    if key in _TOKEN:
        return "secret" if len(value) >= 16 and value.isalnum() and _SIGN.search(value) else None
    return "secret" if key in _SECRET and len(value) >= 8 and (sign == "=" or _SIGN.search(value)) else None


def refused(value: str) -> bool:
    """Shaped like a card or an address, but the check that all of these pass fails: no pattern marks it."""
    bare = _card(value)
    return bool(bare and not luhn(bare)) or (value.count(".") == 3 and value.replace(".", "").isdigit() and not _IP.fullmatch(value))


def shape_of(value: str) -> str:
    if _HEX.fullmatch(value) and not value.isdigit():
        return f"x{len(value)}"
    if _UPPER.fullmatch(value) and not value.isdigit():
        return f"u{len(value)}:{value[:4]}"
    if "@" in value:  # letters and digits of either side are free, what joins them is not
        return re.sub(r"[^\W_]+", "w", value)
    dotted = value.count(".") == 3
    return _RUN.sub(lambda m: ("9" if dotted else f"9{len(m[0])}") if m[0].isdigit() else f"a{len(m[0])}", value)


def _pieces(text: str):
    """(start, value) of runs that may be candidates, in order."""
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        if kind == "groups":
            bare = _card(m[0])
            if bare and luhn(bare):
                yield m.start(), m[0]
            else:
                for part in re.finditer(r"[^ ]+", m[0]):
                    yield m.start() + part.start(), part[0]
        else:
            yield m.start(kind), m[kind]


def candidates(text: str | None) -> list[tuple[int, int, str, list[str], str | None]]:
    """(start, stop, value, patterns, seed kind) of every candidate; none overlaps another."""
    out = []
    text = text or ""
    for a, value in _pieces(text):
        bare = value.rstrip(".,!?:;)#$%&*")
        value = bare.lstrip("(#$%&*")
        a += len(bare) - len(value)
        if len(value) < 5 or refused(value):
            continue
        k = _KEY.search(text, max(0, a - 32), a)
        key, sign = (k[1].lower(), k[2]) if k else (None, None)
        shape = shape_of(value)
        patterns = ["shape:" + shape]
        if key:
            patterns.append("key:" + key)
            if shape[0] == "x" and shape[1:].isdigit():
                patterns.append("keyed-hex")
        plain = [c for c in value if c.isalnum()]
        if len(plain) >= CONTEXT_LENGTH and "@" not in value:
            digits = sum(c.isdigit() for c in plain)
            if digits:
                kind = "n" if digits == len(plain) else "m"
                left, right = _LEFT.search(text, max(0, a - 52), a), _RIGHT.match(text, a + len(value), a + len(value) + 40)
                if left:
                    patterns.append(f"left:{kind}:{left[2].lower()}")
                    if left[1]:
                        patterns.append(f"left:{kind}:{left[1].lower()} {left[2].lower()}")
                    if right:
                        patterns.append(f"round:{kind}:{left[2].lower()} {right[1].lower()}")
        out.append((a, a + len(value), value, patterns, seed_of(value, key, sign)))
    return out


def _extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *c) for i, t in enumerate(b.column(1).to_pylist()) for c in candidates(t)]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *[pa.array([r[j + 1] for r in rows], t) for j, t in enumerate(types)]], names=["doc_id", "h", "start", "stop", "value", "patterns", "seed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    return map_text(rows, "text", run, f"doc_id long, h long, {FIELDS}")


def induce(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) of the believed patterns of ``found`` (value, patterns, seed); a pattern has one kind."""
    # an instance's hash stands for it; edges are distinct
    edges = cut(found.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy(F.xxhash64("value").alias("v"), "pattern").agg(F.max("seed").alias("seed")), "edges")
    words = F.col("pattern").rlike("^(left|round):")
    sizes = cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where((F.col("n") >= MIN_SUPPORT) & (~words | (F.col("n") >= CONTEXT_SUPPORT))), "sizes")
    edges = cut(edges.join(sizes, "pattern"), "edges")
    seeds = edges.where("seed is not null").groupBy("v").agg(F.max("seed").alias("kind")).withColumn("c", F.lit(1.0))
    belief, patterns = seeds, None
    for i in range(rounds):
        share = edges.join(belief, "v").groupBy("pattern", "kind", "n").agg(F.sum("c").alias("support"))
        last = i == rounds - 1
        enough = F.when(words, (F.col("support") >= CONTEXT_SUPPORT) & (F.col("confidence") >= CONTEXT_CONFIDENCE)).otherwise((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= (MIN_CONFIDENCE if last else MIN_CONFIDENCE / 4)))
        patterns = share.withColumn("confidence", F.col("support") / (F.col("n") + 1)).where(enough)
        patterns = cut(patterns.groupBy("pattern").agg(F.max_by(F.struct("kind", "confidence", "support"), F.struct("confidence", "kind")).alias("b")).select("pattern", "b.*"), "patterns")
        if not last:
            near = edges.join(patterns.select("pattern", "kind", F.least(F.lit(1.0), F.col("confidence") * 2).alias("c")), "pattern").groupBy("v").agg(F.max(F.struct("c", "kind")).alias("b")).select("v", F.col("b.kind").alias("kind"), F.col("b.c").alias("c"))
            belief = cut(near.unionByName(seeds).groupBy("v").agg(F.max(F.struct("c", "kind")).alias("b")).select("v", F.col("b.kind").alias("kind"), F.col("b.c").alias("c")), "belief")
    return patterns


def _marks(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``found`` with ``best`` (confidence, kind) of its seed or its best believed pattern; rows without are left out."""
    seeded = F.when(F.col("seed").isNotNull(), F.struct(F.lit(1.0).alias("confidence"), F.col("seed").alias("kind")))
    known = patterns.select(F.col("pattern").alias("p"), F.struct("confidence", "kind").alias("b"))
    place = ["doc_id", "h", "start", "stop", "value", "seed"]
    each = found.withColumn("at", F.monotonically_increasing_id()).select("at", *place, F.explode("patterns").alias("pattern"))
    matched = join_by_size(each, known, patterns.count(), F.col("pattern") == F.col("p"), "left", 160)
    one = matched.groupBy("at").agg(*[F.first(c).alias(c) for c in place], F.max("b").alias("b"))
    return one.withColumn("best", F.greatest(seeded, "b")).where("best is not null")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, value, kind, confidence, seeded): every identifier that a believed pattern or a seed marks; offsets count characters."""
    found = cut(_extract(docs, id_col, text_col), "candidates")
    best = _marks(found, induce(found))
    return best.select("doc_id", "start", "stop", "value", F.col("best.kind").alias("kind"), F.col("best.confidence").alias("confidence"), F.col("seed").isNotNull().alias("seeded"))


def _replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in marks:
        out += [text[last:a], f"<{kind.upper()}>"]
        last = b
    return "".join(out) + text[last:] if out else text


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """``docs`` with every marked identifier replaced by <KIND> in the text and ``size_col`` counted anew; all columns and rows stay.

    The corpus is read twice, once for the patterns and once to replace, and no text is shuffled while the believed patterns
    are at most ``max_patterns``, which go to the tasks as a dictionary; beyond that the marks are found by join and meet
    their texts by (id, text hash), with the same result.
    """
    found = cut(_extract(docs, id_col, text_col), "candidates")
    patterns = induce(found)
    names, at = docs.columns, docs.columns.index(text_col)
    if patterns.count() <= max_patterns:
        believed = docs.sparkSession.sparkContext.broadcast({r["pattern"]: (r["confidence"], r["kind"]) for r in patterns.collect()})

        def clean(text: str | None) -> str | None:
            marks = []
            for a, b, _, near, seed in candidates(text):
                best = [x for x in ((1.0, seed) if seed else None, *[believed.value.get(p) for p in near]) if x]
                if best:
                    marks.append((a, b, max(best)[1]))
            return _replaced(text, marks) if marks else text

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(b.columns)
            columns[at] = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays(columns, names=names)

        out = map_text(docs, text_col, run, docs.schema)
    else:
        i, h, m = fresh(docs, "_i", "_h", "_m")
        lists = _marks(found, patterns).groupBy(F.col("doc_id").alias(i), F.col("h").alias(h)).agg(F.array_sort(F.collect_set(F.struct("start", "stop", "best.kind"))).alias(m))
        joined = docs.join(lists, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(h)), "left")
        given = joined.select(*[F.col(f"`{c}`") for c in names], m)

        def swap(b: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(b.columns)[:-1]
            columns[at] = pa.array([_replaced(t, [tuple(x.values()) for x in k]) if k else t for t, k in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())], pa.string())
            return pa.RecordBatch.from_arrays(columns, names=names)

        out = map_text(given, text_col, swap, docs.schema)
    return out.withColumn(size_col, F.length(_c(text_col)).cast(docs.schema[size_col].dataType)) if size_col and size_col in names else out


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier found in the documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
