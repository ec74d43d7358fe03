"""Operator 6: media columns over content-addressed payloads in tar shards.

A row's payload is stored as a grey-scale PNG of 8-bit samples, 64 a line, named by the SHA-256 of that file, in a tar
shard; the row carries digest, shard, offset and length. A shard stores equal payloads once; of equal payloads in
several shards, the first place (least shard and offset) is the one all rows carry. Range reads of the PNG's first 33
bytes fill the metadata columns; a whole-range read gives the samples back, from which features come.

One task writes one shard in the shared folder, under another name first, so a task that is lost or runs twice leaves
the same shard. No payload is shuffled, only places and digests. Defined cases: a null or empty text is 64 zero bytes;
ids may be null or repeated; equal texts have equal values; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, file_system, rows_of, scratch, small_batches

UNIT, HEAD, SIGN = 64, 33, b"\x89PNG\r\n\x1a\n"
#: Bytes in one IDAT chunk at most.
CHUNK = 1 << 30


def payload(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_png(samples: bytes) -> bytes:
    """8-bit samples, 64 a line, as a PNG."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    height = len(samples) // UNIT
    lines = np.zeros((height, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, UNIT)
    body = zlib.compress(lines, 6)
    parts = [chunk(b"IDAT", body[k : k + CHUNK]) for k in range(0, len(body), CHUNK)]
    return b"".join([SIGN, chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, height, 8, 0, 0, 0, 0)), *parts, chunk(b"IEND", b"")])


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first 33 bytes."""
    assert data[:8] == SIGN and data[12:16] == b"IHDR", "not a PNG"
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that :func:`to_png` wrote; check sums are verified."""
    width, _, _ = header(data)
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Integer statistics of the samples: count, mean, mean square, crossings of the mean, and quartile histogram."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, mean = len(x), int(x.sum()) // len(x)
    up = x > mean
    bins = np.bincount(x >> 6, minlength=4)
    return f"n={n};mean={mean};power={int((x * x).sum()) // n};crossings={int((up[1:] != up[:-1]).sum())};hist={'/'.join(map(str, bins.tolist()))}"


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; (id_col, n_bytes, digest, shard, offset, length) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, n_bytes long, digest string, shard long, offset long, length long").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        temp, name = f"{base}/.shard-{part:06d}-{uuid.uuid4().hex}", f"{base}/shard-{part:06d}.tar"

        def rows():
            stream, at, places = None, 0, {}
            for keys, texts in rows_of(batches):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(temp)
                for k, t in zip(keys, texts, strict=True):
                    data = (t or "").encode()
                    key = hashlib.blake2b(data, digest_size=16).digest()
                    if key not in places:
                        png = to_png(payload(data))
                        digest = hashlib.sha256(png).hexdigest()
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(png)
                        stream.write(info.tobuf(tarfile.USTAR_FORMAT) + png + bytes(-len(png) % tarfile.BLOCKSIZE))
                        places[key] = (digest, at + tarfile.BLOCKSIZE, len(png))
                        at += tarfile.BLOCKSIZE + len(png) + -len(png) % tarfile.BLOCKSIZE
                    digest, offset, length = places[key]
                    yield (k, len(data), digest, part, offset, length)
            if stream:
                stream.write(bytes(2 * tarfile.BLOCKSIZE))
                stream.close()
                fs.move(temp, name)

        yield from small_batches(to_arrow_schema(out), rows())

    return docs.select(id_col, text).transform(arrow, run, out)


def places(rows: DataFrame) -> DataFrame:
    """One place for each digest: the least shard and offset."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


MEASURED = "digest string, shard long, offset long, length long, media_width long, media_height long, media_depth long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def measure(at: DataFrame, folder: str, samples: bool = True) -> DataFrame:
    """Metadata of each place by a range read of its header; with ``samples``, what the whole range tells as well.

    Places are dealt by ranges of shard and offset, so that a task reads a contiguous part of few shards.
    """
    out = at.sparkSession.createDataFrame([], MEASURED).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, base = file_system(folder)

        def rows():
            opened = (-1, None)
            for digests, shards, offsets, lengths in rows_of(batches):
                for d, s, o, n in zip(digests, shards, offsets, lengths, strict=True):
                    if opened[0] != s:
                        opened = (s, fs.open_input_file(f"{base}/shard-{s:06d}.tar"))
                    meta = header(opened[1].read_at(HEAD, o))
                    if not samples:
                        yield (d, s, o, n, *meta, None, None, None, None, None)
                        continue
                    stored = opened[1].read_at(n, o)
                    x = from_png(stored)
                    yield (d, s, o, n, *meta, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-UNIT:]), hashlib.sha256(stored).hexdigest(), feature(x))

        yield from small_batches(to_arrow_schema(out), rows())

    return at.select("digest", "shard", "offset", "length").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").transform(arrow, run, out)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text", samples: bool = True) -> DataFrame:
    """Store every text and return the media columns of every row."""
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    store(docs, f"{folder}/shards", id_col, text).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    seen = measure(places(rows), f"{folder}/shards", samples)
    return rows.select(id_col, "n_bytes", "digest").join(seen, "digest").select(id_col, "n_bytes", *seen.columns)
