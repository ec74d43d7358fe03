"""Operator 10: token ids in files of bit or byte planes.

A file holds blocks of ``BLOCK`` ids. A block is transposed: plane k holds bit (or byte) k of every id, each plane is
compressed by zstandard on its own, and planes that are zero throughout are left out. A chunk index at the end of the
file gives, for each block, its place, its number of ids and the sizes of its planes, so that a reader takes only the
blocks it needs.

``write_ids`` deals the documents by ranges of their id (ties by the text's hash), sorts each range and writes one file
for each, under another name first, so that a task that is lost or runs twice leaves the same file. ``read_ids`` reads
the files back. Defined cases: a null or empty text is the end token alone; null ids come first; rows with the same id
follow each other by the hash of their texts; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import library_encoder
from .common import arrow, file_system, rows_of, scratch, small_batches

BLOCK, MAGIC, LEVEL = 65_536, b"IDPLANE1", 1


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """The planes of ids (unsigned 32-bit): 4 byte planes or 32 bit planes, the lowest first; trailing zero planes go."""
    ids = ids.astype("<u4")
    if unit == "bit":
        planes = [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little") for k in range(32)]
    else:
        planes = [np.ascontiguousarray(p) for p in ids.view(np.uint8).reshape(-1, 4).T]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        if unit == "bit":
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
        else:
            out |= np.frombuffer(p, np.uint8).astype("<u4") << np.uint32(8 * k)
    return out


class Writer:
    """Ids to a binary stream, block by block; ``close`` adds the chunk index."""

    def __init__(self, out, unit: str = "byte", block: int = BLOCK) -> None:
        self.out, self.unit, self.block = out, unit, block
        self.held, self.n, self.at, self.index, self.total = [], 0, len(MAGIC), [], 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.block:
            ids = np.concatenate(self.held)
            full = len(ids) - len(ids) % self.block
            for k in range(0, full, self.block):
                self._block(ids[k : k + self.block])
            self.held, self.n = [ids[full:]], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.unit)]
        self.index.append([self.at, len(ids), list(map(len, planes))])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n:
            self._block(np.concatenate(self.held))
        tail = json.dumps({"unit": self.unit, "block": self.block, "total": self.total, "chunks": self.index}).encode()
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)


class Reader:
    """Ranges of ids from a random-access file."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        n, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
        assert magic == MAGIC, "not a plane file, or cut short"
        info = json.loads(file.read_at(n, size - 16 - n))
        self.unit, self.block, self.total, self.chunks = info["unit"], info["block"], info["total"], info["chunks"]
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def chunk(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            at, n, sizes = self.chunks[k]
            data, planes, p = memoryview(self.file.read_at(sum(sizes), at)), [], 0
            for s in sizes:
                planes.append(self.unpack(data[p : p + s]))
                p += s
            self.last = (k, from_planes(planes, n, self.unit))
        return self.last[1]

    def pieces(self, start: int, n: int):
        """The ids from ``start`` on, as one array for each chunk they lie in."""
        while n > 0:
            k, at = divmod(start, self.block)
            part = self.chunk(k)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_ids(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, unit: str = "byte") -> DataFrame:
    """Encode and write every row; the document index (id, file, first id in the file, number of ids), in order."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, part long, file string, first long, n_tokens long").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        enc, finish = library_encoder(path), int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        fs, base = file_system(folder)
        name, temp = f"{base}/ids-{part:06d}.planes", f"{base}/.ids-{part:06d}-{uuid.uuid4().hex}"

        def rows():
            writer = stream = None
            for keys, texts, _ in rows_of(batches):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(temp)
                    writer = Writer(stream, unit)
                for k, t in zip(keys, texts, strict=True):
                    ids = np.frombuffer(enc(t) + finish, "<u4")
                    yield (k, part, f"ids-{part:06d}.planes", writer.total, len(ids))
                    writer.add(ids)
            if writer:
                writer.close()
                stream.close()
                fs.move(temp, name)

        yield from small_batches(to_arrow_schema(out), rows())

    tie = docs.select(id_col, text, F.xxhash64(text).alias("__tie"))
    return tie.repartitionByRange(id_col, "__tie").sortWithinPartitions(id_col, "__tie").transform(arrow, run, out)


def read_ids(index: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id_col, part, first, n_tokens, ids or their crc32) of every row of a document index, from the files."""
    kind = index.schema[id_col].dataType.simpleString()
    out = index.sparkSession.createDataFrame([], f"`{id_col}` {kind}, part long, first long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, base = file_system(folder)
        opened: tuple[str, Reader | None] = ("", None)

        def rows():
            nonlocal opened
            for keys, parts, files, firsts, ns in rows_of(batches):
                for k, part, name, first, n in zip(keys, parts, files, firsts, ns, strict=True):
                    if opened[0] != name:
                        opened = (name, Reader(fs.open_input_file(f"{base}/{name}")))
                    found = opened[1].pieces(first, n)
                    if with_ids:
                        yield (k, part, first, n, np.concatenate([np.empty(0, "<u4"), *found]).astype("i4"))
                    else:
                        crc = 0
                        for p in found:
                            crc = zlib.crc32(np.ascontiguousarray(p), crc)
                        yield (k, part, first, n, crc)

        yield from small_batches(to_arrow_schema(out), rows())

    return index.select(id_col, "part", "file", "first", "n_tokens").transform(arrow, run, out)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 1, unit: str = "byte", with_ids: bool = False) -> DataFrame:
    """Write all rows, read them back, and add where each document starts in the whole corpus.

    The sums by file are a row for each file; their running total is the only thing computed in one place.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    write_ids(docs, path, f"{folder}/files", id_col, text, end_id, unit).write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")
    sums = index.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    base = sums.select("part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__base"))
    rows = read_ids(index, f"{folder}/files", id_col, with_ids)
    return rows.join(base, "part").select(id_col, (F.col("__base") + F.col("first")).alias("start"), "n_tokens", "ids" if with_ids else "ids_crc32")
