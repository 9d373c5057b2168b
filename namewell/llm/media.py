"""Media columns: content-addressed payloads in tar shards, metadata by header-only range reads.

A payload's address is the SHA-256 of the stored bytes, under which it is a member of its tar shard, so that it can be
verified.  Rendering is a function of the source, so equal content is found by the digest of the source: of equal ones the
row with the least key owns the payload and writes it, and equal content is stored once (repeated rows with equal key and
content may each write it; the index keeps one).  Every task streams its owners' payloads into tar shards named by what
they hold: a task that runs again writes the same file anew, and files appear by rename only.  The index (source digest,
digest, shard, offset, length) joins back to the rows, and the metadata columns are parsed from ranges of HEADER bytes
read out of the shards, never from whole payloads; formats that put their sizes further in (JPEG, MP4) are walked by
ranges of a segment's or box's head each.

Null payloads give null digest, offset, length and metadata.  Empty ones are payloads of no bytes, very long ones are
payloads like others (a shard holds one at least).  Unknown or cut headers give the format "unknown" and null sizes.  Null
keys stay null and come before others as owners do not: a row with a key owns before one without.  An empty table writes
no shard.  Columns of ``rows`` that have the name of a metadata column are an error, not overwritten.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepared, shared_dir

HEADER, SHARD_BYTES, WIDTH = 64, 64 << 20, 256
META = "format string, width long, height long, depth long, channels long"


def png_of(data: bytes, width: int = WIDTH) -> bytes:
    """A lossless grey PNG whose rows are ``data``, its length in front."""
    raw = struct.pack(">Q", len(data)) + data
    rows = -(-len(raw) // width)
    grid = np.zeros((rows, width + 1), np.uint8)  # filter byte 0 in front of each row
    body = np.zeros(rows * width, np.uint8)
    body[: len(raw)] = np.frombuffer(raw, np.uint8)
    grid[:, 1:] = body.reshape(rows, width)
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(grid.tobytes(), 6)) + chunk(b"IEND", b"")


def data_of(png: bytes) -> bytes:
    """The bytes that ``png_of`` was given."""
    at, body, width = 8, b"", 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IHDR":
            width = struct.unpack(">I", png[at + 8 : at + 12])[0]
        elif kind == b"IDAT":
            body += png[at + 8 : at + 8 + n]
        at += n + 12
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
    return raw[8 : 8 + struct.unpack(">Q", raw[:8])[0]]


def _jpeg(read) -> tuple | None:
    """Sizes from the frame header, walking over the segments before it."""
    at = 2
    for _ in range(1000):
        head = read(at, 10)
        if len(head) < 10 or head[0] != 0xFF:
            return None
        kind = head[1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            depth, height, width, channels = struct.unpack(">BHHB", head[4:10])
            return ("jpeg", width, height, depth, channels)
        at += 2 + struct.unpack(">H", head[2:4])[0]
    return None


def _mp4(read, length: int) -> tuple:
    """Sizes of the first track that has some, from its header box; boxes are walked by their heads."""

    def boxes(at: int, end: int):
        while at + 8 <= end:
            head = read(at, 16)
            if len(head) < 8:
                return
            size, kind = struct.unpack(">I4s", head[:8])
            skip = 8
            if size == 1 and len(head) == 16:
                size, skip = struct.unpack(">Q", head[8:])[0], 16
            size = size or end - at
            if size < skip:
                return
            yield kind, at + skip, min(end, at + size)
            at += size

    for kind, a, b in boxes(0, length):
        if kind == b"moov":
            for track, c, d in boxes(a, b):
                if track == b"trak":
                    for part, e, f in boxes(c, d):
                        tail = read(f - 8, 8) if part == b"tkhd" and f - e >= 80 else b""
                        if len(tail) == 8:
                            width, height = (x >> 16 for x in struct.unpack(">II", tail))
                            if width and height:
                                return ("mp4", width, height, None, None)
    return ("mp4", None, None, None, None)


def parse_header(b: bytes, read=None, length: int | None = None) -> tuple[str, int | None, int | None, int | None, int | None]:
    """(format, width, height, depth, channels) from the first bytes of PNG, GIF, BMP, JPEG, WebP, MP4, WAV or NPY.

    ``read(offset, n)`` gives further ranges of a payload of ``length`` bytes; without it the first bytes are all there is.
    """
    none = (None, None, None, None)
    if read is None:
        read, length = (lambda at, n: b[max(0, at) : max(0, at) + n]), len(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 26:
        w, h, depth, kind = struct.unpack(">IIBB", b[16:26])
        return ("png", w, h, depth, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind))
    if b[:4] == b"GIF8" and len(b) >= 11:
        w, h, flags = struct.unpack("<HHB", b[6:11])
        return ("gif", w, h, (flags & 7) + 1, 3)
    if b[:2] == b"BM" and len(b) >= 30:
        w, h = struct.unpack("<ii", b[18:26])
        bits = struct.unpack("<H", b[28:30])[0]
        return ("bmp", w, abs(h), min(bits, 8), max(1, bits // 8))
    if b[:3] == b"\xff\xd8\xff":
        return _jpeg(read) or ("jpeg", *none)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return ("webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), 8, 4 if b[20] & 16 else 3)
        if b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            return ("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 8, 4 if bits >> 28 & 1 else 3)
        w, h = struct.unpack("<HH", b[26:30])
        return ("webp", w & 0x3FFF, h & 0x3FFF, 8, 3)
    if b[4:8] == b"ftyp":
        return _mp4(read, length or len(b))
    if b[:4] == b"RIFF" and b[8:12] == b"WAVE" and len(b) >= 36:
        channels, rate = struct.unpack("<HI", b[22:28])
        return ("wav", rate, None, struct.unpack("<H", b[34:36])[0], channels)
    if b[:6] == b"\x93NUMPY":
        return ("npy", *none)
    return ("unknown", *none)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


class _Shard:
    """A tar file in memory up to the shard size; put in place at once, under a name made of its digests."""

    def __init__(self) -> None:
        self.buffer, self.names, self.rows = io.BytesIO(), hashlib.sha256(), []
        self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)

    def add(self, source: str, payload: bytes) -> None:
        digest = hashlib.sha256(payload).hexdigest()
        entry = tarfile.TarInfo(digest)
        entry.size, entry.mtime = len(payload), 0
        self.rows.append((source, digest, self.buffer.tell() + 512, len(payload)))
        self.tar.addfile(entry, io.BytesIO(payload))
        self.names.update(digest.encode())

    def put(self, store: fs.FileSystem, path: str) -> pa.RecordBatch:
        self.tar.close()
        name = self.names.hexdigest()[:32] + ".tar"
        trial = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(trial) as out:
            out.write(self.buffer.getbuffer())
        store.move(trial, f"{path}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in self.rows]), pa.array([r[1] for r in self.rows]), pa.array([name] * len(self.rows)), pa.array([r[2] for r in self.rows], pa.int64()), pa.array([r[3] for r in self.rows], pa.int64())], names=["source", "digest", "shard", "offset", "length"])


def store(rows: DataFrame, key_col: str, source_col: str, folder: str, render=png_of, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, digest, shard, offset, length) of every row; the payloads ``render(source bytes)`` go to tar shards in ``folder``."""
    prepared(rows.sparkSession)
    given = rows.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{source_col}`").cast("binary").alias("source")).withColumn("digest", F.sha2("source", 256))
    keys = cut(given.select("key", "digest"), "digests")
    owners = cut(keys.where("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("key").isNull().alias("unknown"), "key")).alias("o")).select(F.col("digest").alias("_d"), F.col("o.key").alias("_k")), "owners")
    # only rows whose content comes more than once need the owners' table
    shared = cut(keys.groupBy("digest").agg(F.count("*").alias("n")).where("digest is not null and n > 1").select(F.col("digest").alias("_d")).join(owners, "_d"), "shared")
    many = shared.count()
    lost = given.join(F.broadcast(shared) if many <= 100_000 else shared, (F.col("digest") == F.col("_d")) & ~F.col("key").eqNullSafe(F.col("_k")), "left_anti").where("digest is not null") if many else given.where("digest is not null")
    at, path = _open(folder)
    at.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = _open(folder)
        shard, held = _Shard(), set()
        for b in batches:
            for source, digest in zip(b.column(0), b.column(1)):
                name = digest.as_py()
                if name in held:
                    continue
                held.add(name)
                shard.add(name, render(source.as_py()))
                if shard.buffer.tell() >= shard_bytes:
                    yield shard.put(place, path)
                    shard = _Shard()
        if shard.rows:
            yield shard.put(place, path)

    index = cut(lost.select("source", "digest").mapInArrow(write, "source string, digest string, shard string, offset long, length long"), "index")
    one = index.groupBy("source").agg(F.min(F.struct("shard", "offset", "length", "digest")).alias("p")).select("source", "p.*")
    return keys.select("key", F.col("digest").alias("source")).join(one, "source", "left").select("key", "digest", "shard", "offset", "length")


def with_headers(rows: DataFrame, folder: str, header: int = HEADER) -> DataFrame:
    """``rows`` (shard, offset, length among the columns) with META, read from the first ``header`` bytes of each payload."""
    names = ["format", "width", "height", "depth", "channels"]
    if clash := {c.lower() for c in rows.columns} & set(names):
        raise ValueError(f"columns of metadata are there already: {sorted(clash)}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = _open(folder)
        name, file = None, None
        for b in batches:
            found = []
            for shard, offset, length in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != name:
                    name, file = shard, place.open_input_file(f"{path}/{shard}")
                part = lambda at, n, file=file, offset=offset, length=length: file.read_at(max(0, min(n, length - at)), offset + at) if 0 <= at < length else b""
                found.append(parse_header(part(0, header), part, length))
            meta = [pa.array([f[i] for f in found], pa.string() if i == 0 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*b.columns, *meta], names=[*b.schema.names, *names])

    prepared(rows.sparkSession)
    # rows without a payload need no read and no place in the order
    near = rows.where("shard is not null").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    rest = rows.where("shard is null").select("*", *[F.lit(None).cast("string" if n == "format" else "long").alias(n) for n in names])
    return near.mapInArrow(read, f"{fields}, {META}").unionByName(rest)


def fetch(folder: str, shard: str, offset: int, length: int) -> bytes:
    """A whole payload."""
    place, path = _open(folder)
    with place.open_input_file(f"{path}/{shard}") as f:
        return f.read_at(length, offset)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's HTML as a PNG payload: (page_id, digest, shard, offset, length) and the header's columns."""
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    return with_headers(store(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", folder).withColumnRenamed("key", "page_id"), folder)
