"""Scores of all pairs of a block's vectors, by tiles: what is asked of them is worked out where they are made.

The nodes of a block are dealt out to tiles of about TILE nodes, and every two tiles of a block (and each one with itself)
make a piece of work that holds two tiles and STEP rows of their scores, however large the block is.  Only vectors are
shuffled, each as often as its block has tiles; pairs never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from namewell.operators.tables import few

#: Nodes of a tile, rows of scores at once, most tasks, those that count, pairs that they hold before they count them,
#: and how far under a bound scores are still given (what is kept of them is for the caller to say).
TILE, STEP, PARTS, COUNTERS, HELD, SLACK = 4096, 64, 400, 64, 1 << 22, 1e-5
KEYS = ("block_key", "_lo", "_hi")


def _met(vectors: DataFrame, keep: list[str], tile: int, parts: int = PARTS) -> DataFrame:
    """``vectors`` once for every two tiles that they are to be held against each other in, those of one piece together and in their order."""
    rows = vectors.where("block_key is not null and node is not null").select("block_key", "node", "vector", *keep)
    sizes = rows.groupBy("block_key").agg(F.count("*").alias("_n")).where("_n > 1").select("block_key", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    n = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("_tiles * (_tiles + 1) div 2")), F.lit(0)).alias("pieces")).first()
    placed = rows.join(few(sizes, n["n"]), "block_key").withColumn("_tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    both = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    made = both.select("block_key", F.least("_tile", "_other").alias("_lo"), F.greatest("_tile", "_other").alias("_hi"), (F.col("_tile") <= F.col("_other")).alias("_left"), "node", "vector", *keep)
    return made.repartition(max(1, min(parts, n["pieces"])), *KEYS).sortWithinPartitions(*KEYS, "node")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece; they come one after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for i in range(len(KEYS)):
            c = b.column(i)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= bool(held) and c[0] != held[-1].column(i)[-1]
        at = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for k, (x, y) in enumerate(zip(at, at[1:])):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            if y > x:
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """[n, width] doubles at unit length, one (nearly) of zeros as it is, and each one's length; a null in a vector, or for one, makes it NaN."""
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = max(0, int(size.max(initial=0)))
    if (size == width).all():
        m = flat.reshape(len(size), width)
    else:
        m = np.zeros((len(size), width))
        m[np.arange(width) < np.maximum(size, 0)[:, None]] = flat
        m[size < 0] = np.nan
    with np.errstate(all="ignore"):
        return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-8)[:, None], size


class Piece:
    """Two tiles of a block, or one and itself."""

    def __init__(self, rows: pa.Table, digits: int | None, step: int):
        left = rows.column("_left").combine_chunks()
        self.key, own = rows.column("block_key")[0], rows.column("_lo")[0] == rows.column("_hi")[0]
        self.a = rows if own else rows.filter(left)
        self.b = rows if own else rows.filter(pc.invert(left))
        self.own, self.digits, self.step = own, digits, step
        self.na, self.nb = self.a.num_rows, self.b.num_rows

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(t.column("node").to_numpy() for t in (self.a, self.b))

    def scores(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(first row, first column, clamped cosines, which of them count, None for all)."""
        if not self.na or not self.nb:
            return
        (u, n), ids = unit_rows(self.a.column("vector").combine_chunks()), self.nodes()
        v, m = (u, n) if self.own else unit_rows(self.b.column("vector").combine_chunks())
        whole = bool(np.isfinite(u).all() and np.isfinite(v).all())
        alike = bool((n == n[0]).all() and (m == n[0]).all())
        if u.shape[1] != v.shape[1]:
            wide = max(u.shape[1], v.shape[1])
            u, v = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (u, v))
        v = np.ascontiguousarray(v.T)
        for r in range(0, self.na, self.step):
            at = r if self.own else 0
            with np.errstate(all="ignore"):
                c = u[r : r + self.step] @ v[:, at:]
            if not whole:
                c[~np.isfinite(c)] = 0
            if not alike:
                c[n[r : r + self.step, None] != m[at:]] = 0
            np.clip(c, -1, 1, out=c)
            if self.digits is not None:
                # halves away from zero, and no negative zero
                sign = np.signbit(c)
                np.abs(c, out=c)
                c *= 10**self.digits
                c += 0.5
                np.floor(c, out=c)
                c /= 10**self.digits
                np.negative(c, out=c, where=sign)
                c += 0.0
            counts = None
            if self.own:
                counts = np.asarray(ids[0][r : r + self.step, None] < ids[1][at:])
            yield r, at, c, counts

    def places(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """As ``scores``, without the scores."""
        x, y = self.nodes()
        for r in range(0, self.na if self.nb else 0, self.step):
            at = r if self.own else 0
            none = np.broadcast_to(np.int8(0), (len(x[r : r + self.step]), self.nb - at))
            yield r, at, none, np.asarray(x[r : r + self.step, None] < y[at:]) if self.own else None


def block_scores(vectors: DataFrame, keep: list[str] | None = None, digits: int | None = None, within: float | None = None, apart: str | None = None, tile: int = TILE, step: int = STEP) -> DataFrame:
    """(block_key, src, dst, cosine_sim) of all pairs src < dst of each block of ``vectors`` (block_key, node, vector, keep...), with keep_1 and keep_2.

    Cosines are rounded to ``digits``.  With ``within`` pairs that are farther apart (and by more than rounding) are left out,
    with ``apart`` those that hold one value, not blank, in that column.
    """
    keep = keep or []
    kinds = [vectors.schema[c].dataType for c in ("block_key", "node")]
    sides = [StructField(f"{c}_{n}", vectors.schema[c].dataType) for c in keep for n in (1, 2)]
    schema = StructType([StructField("block_key", kinds[0]), StructField("src", kinds[1]), StructField("dst", kinds[1]), StructField("cosine_sim", DoubleType()), *sides])
    least = None if within is None else 1 - within - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            p = Piece(rows, digits, step)
            x, y = p.nodes()
            codes = None if apart is None else _codes(p, apart)
            both = None if not keep else {c: pa.concat_arrays([k for t in (p.a, p.b) for k in t.column(c).chunks]) for c in keep}
            for r, at, c, counts in p.scores():
                ok = counts
                if codes is not None:
                    alike = codes[0][r : r + step, None] == codes[1][at:]
                    ok = ~alike if ok is None else ok & ~alike
                if least is not None:
                    ok = c >= least if ok is None else ok & (c >= least)
                if ok is None:
                    i, j = np.repeat(np.arange(r, r + len(c)), c.shape[1]), np.tile(np.arange(at, at + c.shape[1]), len(c))
                    c = c.ravel()
                else:
                    hit = np.flatnonzero(ok)
                    i, j = np.divmod(hit, c.shape[1])
                    i, j, c = i + r, j + at, c.ravel()[hit]
                if not len(i):
                    continue
                s, d = x[i], y[j]
                back = np.asarray(s > d, bool)
                out = [pa.repeat(p.key, len(i)), pa.array(np.where(back, d, s), rows.schema.field("node").type), pa.array(np.where(back, s, d), rows.schema.field("node").type), pa.array(c)]
                for k in keep:
                    one, two = np.where(back, j + p.na, i), np.where(back, i, j + p.na)
                    out += [both[k].take(pa.array(one)), both[k].take(pa.array(two))]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return _met(vectors, list(dict.fromkeys([*keep, *([apart] if apart else [])])), tile).mapInArrow(run, schema)


def _codes(p: Piece, column: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Codes of the values of both sides' rows, blank ones each unlike any other; None if all are blank."""
    code, names = pd.factorize(np.concatenate([t.column(column).to_numpy() for t in (p.a, p.b)]))
    blank = (code < 0) | np.append(names == "", True)[code]
    if blank.all():
        return None
    code[blank] = -1 - np.arange(blank.sum())
    return code[: p.na], code[len(code) - p.nb :]


def score_counts(vectors: DataFrame, same: list[str], digits: int | None = None, tile: int = TILE, step: int = STEP) -> DataFrame:
    """How many pairs of a block there are of each kind: (same..., [cosine_sim,] n) of ``vectors`` (block_key, node, vector, same...).

    A column of ``same`` says whether both nodes hold one value there, null where either holds none.  With ``digits`` the
    pairs of each cosine, rounded to them, are counted apart.  Counts of a task are summed up in it.
    """
    schema = StructType([*[StructField(c, BooleanType()) for c in same], *([StructField("cosine_sim", DoubleType())] if digits is not None else []), StructField("n", LongType())])
    half = 10 ** (digits or 0)
    bins = 2 * half + 1 if digits is not None else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(3 ** len(same) * bins, np.int64), [], 0
        for rows in _pieces(batches):
            p = Piece(rows, digits, step)
            codes = []
            for k in same:
                code, _ = pd.factorize(np.concatenate([t.column(k).to_numpy() for t in (p.a, p.b)]))
                codes.append((code[: p.na], code[len(code) - p.nb :]))
            for r, at, c, counts in p.scores() if digits is not None else p.places():
                where = np.zeros(c.shape, np.int32) if digits is None else (np.rint(c * half) + half).astype(np.int32)
                for k, (a, b) in enumerate(codes):
                    a, b = a[r : r + step, None], b[at:]
                    kind = (a == b).astype(np.int32)
                    if (a < 0).any() or (b < 0).any():
                        kind[np.broadcast_to((a < 0) | (b < 0), kind.shape)] = 2
                    where += kind * np.int32(bins * 3**k)
                held.append(where.ravel() if counts is None else where[counts])
                size += len(held[-1])
                if size > HELD:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            kinds = [(own // bins // 3**i) % 3 for i in range(len(same))]
            flags = [pa.array(x == 1, mask=x == 2) for x in kinds]
            scores = [pa.array((own % bins - half) / half)] if digits is not None else []
            yield pa.RecordBatch.from_arrays([*flags, *scores, pa.array(total[own])], names=schema.names)

    return _met(vectors, same, tile, COUNTERS).mapInArrow(run, schema).groupBy(*schema.names[:-1]).agg(F.sum("n").alias("n"))

