"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary.

A rank file (base64 token, rank) becomes a serialised BPE model: a piece's bytes are mapped to printable characters one
by one, its score is its negative rank, normalisation is the identity and white space is left alone, so merging the best
scored neighbours is merging by rank.  Ids of the pieces are the ranks; the unknown piece comes last and is never met.
Texts are split by the vocabulary's pattern, each different pre-token is encoded once a worker, and decoding maps pieces
back to bytes.

Null texts give null ids; empty ones an empty list; very long ones are encoded whole.  Surrogates cannot occur in
Spark's strings.  Rows repeat as they come and nothing ties; null ids stay null; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
_made: dict[str, "Codec"] = {}


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def parse_ranks(data: bytes) -> list[bytes]:
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: list[bytes]) -> bytes:
    """The model file: pieces in rank order, then <unk>."""
    sign = byte_alphabet()
    out = bytearray()
    for r, token in enumerate(ranks):
        out += _field(1, _field(1, "".join(sign[b] for b in token).encode()) + _field(2, float(-r)))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of a rank file's bytes, made when first used."""

    def __init__(self, data: bytes):
        self.ranks = parse_ranks(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.table = {b: c for b, c in enumerate(byte_alphabet())}
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        known, ids = self.known, []
        for token in self.split(text):
            got = known.get(token)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = known[token] = self.model.encode(token.encode().decode("latin-1").translate(self.table))
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.ranks[i] for i in ids]).decode("utf-8", "replace")


def shared_codec(spark: SparkSession, vocabulary: str):
    """A function that gives a task the codec of ``vocabulary``: the driver reads the file once and broadcasts its bytes (a vocabulary, about a megabyte), so that workers need no path; one codec a worker."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    sent, name = spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def codec() -> Codec:
        from namewell.llm import piece_bpe

        if name not in piece_bpe._made:
            piece_bpe._made.clear()
            piece_bpe._made[name] = piece_bpe.Codec(sent.value)
        return piece_bpe._made[name]

    return codec


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, same): ``same`` says that decoding gives the text back."""
    made = shared_codec(docs.sparkSession, vocabulary)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        codec, texts = made(), b.column(1).to_pylist()
        ids = [None if t is None else codec.encode(t) for t in texts]
        same = [None if t is None else codec.decode(i) == t for t, i in zip(texts, ids)]
        count = [None if i is None else len(i) for i in ids]
        flat = np.fromiter((x for i in ids if i for x in i), np.int32, sum(n or 0 for n in count))
        offsets = pa.array([None if i is None else at for i, at in zip(ids, np.concatenate([[0], np.cumsum([n or 0 for n in count])])[:-1].tolist())] + [len(flat)], pa.int32())
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(count, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "same"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_text(rows, "text", run, "doc_id long, token_ids array<int>, n_tokens long, same boolean")


def decode(rows: DataFrame, ids_col: str = "token_ids", vocabulary: str = VOCABULARY, into: str = "decoded") -> DataFrame:
    """``rows`` with the column ``into``; null ids give null; a column of that name is an error, not overwritten."""
    if into.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"there is a column {into} already")
    made = shared_codec(rows.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        codec = made()
        return ids.map(lambda i: None if i is None else codec.decode([int(x) for x in i]))

    return rows.withColumn(into, back(F.col(f"`{ids_col}`")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
