"""Name keys: folding, block keys, name tokens and the conflict predicate, all as column expressions but for the fold."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
_NOT_PLAIN = re.compile("[^a-z0-9]+")


def fold(name: str) -> str:
    """Compatibility decomposition, what is not ASCII dropped, lower case, trimmed."""
    return unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower().strip()


@F.pandas_udf(StringType())
def ascii_fold(names: pd.Series) -> pd.Series:
    """``fold`` of each different name of a batch."""
    known = {n: fold(n) for n in names.dropna().unique()}
    return names.map(lambda n: known.get(n))


@lru_cache(maxsize=1 << 17)
def plain_parts(name: str) -> tuple[str, str, str]:
    """(block key, given, surname) of a raw name: the rules of ``block_key`` and ``name_tokens`` on one string."""
    folded = fold(name)
    bare = lambda t: _NOT_PLAIN.sub("", t)
    words = folded.split()
    before, comma, after = folded.partition(",")
    if comma:
        given, rest = after.split(), before.split()
        g, s = (given[0] if given else ""), (rest[-1] if rest else "")
    else:
        trail = 0
        while trail < len(words) and 1 <= len(bare(words[-1 - trail])) <= 3:
            trail += 1
        given, rest = (words[len(words) - trail :], words[: len(words) - trail]) if 0 < trail < len(words) else (words[:1], words)
        short = len(words) > 1 and 1 <= len(bare(words[-1])) <= 2
        g, s = (words[-1], words[-2]) if short else (words[0], words[-1]) if words else ("", "")
    if len(rest) > 1 and bare(rest[-1]) in SUFFIXES:
        rest = rest[:-1]
    surname, initial = bare(rest[-1]) if rest else "", bare("".join(given))[:1]
    return f"{initial}.{surname}" if surname and initial else "unknown", bare(g), bare(s)


#: Folded names of the common shapes, whose words are plain: "surname, given ..." and "given surname", the surname too long for initials or a suffix.
_SHAPES = [r"^(?P<s>[a-z0-9]+), *(?P<g>[a-z0-9]+)\.?(?: [a-z0-9]+\.?)*$", r"^(?P<g>[a-z0-9]+)\.? (?P<s>[a-z0-9]{4,})$"]


def parts_of(names: pa.Array) -> pa.Array:
    """struct(block_key, given, surname) of raw names, as ``plain_parts`` says: names of the common shapes by Arrow's kernels, only the others one by one; a null name's key is unknown."""
    folded = pc.utf8_normalize(names.cast(pa.string()), form="NFKD")
    folded = pc.ascii_trim_whitespace(pc.ascii_lower(pc.replace_substring_regex(folded, r"[^\x00-\x7F]+", "")))
    found = [pc.extract_regex(folded, p) for p in _SHAPES]
    g, s = (pc.coalesce(*[pc.struct_field(x, [c]) for x in found]) for c in ("g", "s"))
    key = pc.binary_join_element_wise(pc.utf8_slice_codeunits(g, 0, 1), s, ".")
    out = [key, g, s]
    left = g.is_null()
    if pc.any(left).as_py():
        # names of other shapes
        code = names.filter(left).dictionary_encode()
        parts = [plain_parts(n) for n in code.dictionary.to_pylist()] + [("unknown", "", "")]
        at = pc.fill_null(code.indices.cast(pa.int64()), len(parts) - 1)
        out = [pc.replace_with_mask(x, left, pa.array([p[i] for p in parts], pa.string()).take(at)) for i, x in enumerate(out)]
    return pa.StructArray.from_arrays(out, names=["block_key", "given", "surname"])


name_parts = F.arrow_udf(parts_of, StructType([StructField(n, StringType()) for n in ("block_key", "given", "surname")]))


def clean(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]+", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def _parts(folded: Column) -> tuple[Column, Column]:
    """(given words, surname words) of a folded name."""
    comma = F.contains(folded, F.lit(","))
    before, after = _words(F.substring_index(folded, ",", 1)), _words(F.regexp_replace(folded, "^[^,]*,", ""))
    words = _words(folded)
    n = F.size(words)
    sizes = F.transform(words, lambda w: F.length(clean(w)))
    # initials that trail: how many words from the end are of 1 to 3 characters
    trail = F.aggregate(F.reverse(sizes), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s.n + F.when(s.on & x.between(1, 3), 1).otherwise(0)).alias("n"), (s.on & x.between(1, 3)).alias("on"))).n
    inverted = (trail > 0) & (trail < n)
    given = F.when(comma, after).when(inverted, F.slice(words, n - trail + 1, F.greatest(trail, F.lit(1)))).otherwise(F.slice(words, F.lit(1), F.lit(1)))
    rest = F.when(comma, before).when(inverted, F.slice(words, F.lit(1), n - trail)).otherwise(words)
    return given, rest


def block_key(folded: Column) -> Column:
    """``initial.surname`` of a folded name; ``unknown`` where either is missing."""
    given, rest = _parts(folded)
    bare = F.when((F.size(rest) > 1) & clean(F.try_element_at(rest, F.lit(-1))).isin(SUFFIXES), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    surname = clean(F.try_element_at(bare, F.lit(-1)))
    initial = F.substring(clean(F.concat_ws("", given)), 1, 1)
    return F.when((F.coalesce(surname, F.lit("")) == "") | (F.coalesce(initial, F.lit("")) == ""), "unknown").otherwise(F.concat_ws(".", initial, surname))


def with_block_key(df: DataFrame, name_col: str = "author_raw") -> DataFrame:
    """``df`` with ``block_key``, in one pass over Arrow batches and without a shuffle."""
    return df.withColumn("block_key", name_parts(F.col(name_col))["block_key"])


def with_name_parts(df: DataFrame, name_col: str = "author_raw") -> DataFrame:
    """``df`` with ``block_key``, ``given`` and ``surname``, likewise."""
    return df.withColumn("_parts", name_parts(F.col(name_col))).select(*[F.col(f"`{c}`") for c in df.columns], "_parts.*")


def name_tokens(folded: Column) -> Column:
    """struct(given, surname): the first given word and the last surname word; words of up to two characters that trail are initials."""
    comma = F.contains(folded, F.lit(","))
    words = _words(folded)
    n = F.size(words)
    short = F.length(clean(F.try_element_at(words, F.lit(-1)))).between(1, 2) & (n > 1)
    given = F.when(comma, F.try_element_at(_words(F.regexp_replace(folded, "^[^,]*,", "")), F.lit(1))).when(short, F.try_element_at(words, F.lit(-1))).otherwise(F.try_element_at(words, F.lit(1)))
    surname = F.when(comma, F.try_element_at(_words(F.substring_index(folded, ",", 1)), F.lit(-1))).when(short, F.try_element_at(words, n - 1)).otherwise(F.try_element_at(words, F.lit(-1)))
    return F.struct(F.coalesce(clean(given), F.lit("")).alias("given"), F.coalesce(clean(surname), F.lit("")).alias("surname"))


def conflict(g1: Column, s1: Column, g2: Column, s2: Column) -> Column:
    """Whether two (given, surname) pairs cannot be one person."""
    initial = F.length(g1).between(1, 2) | F.length(g2).between(1, 2)
    return (
        F.when((s1 != "") & (s2 != "") & (s1 != s2) & (F.length(s1) > 2) & (F.length(s2) > 2), True)
        .when((g1 == "") | (g2 == "") | (g1 == g2), False)
        .when(F.substring(g1, 1, 1) != F.substring(g2, 1, 1), True)
        .when(initial, False)
        .when(F.startswith(g1, g2) | F.startswith(g2, g1), False)
        .otherwise(True)
    )
