"""Operator 2, token IDs as seekable zstandard archives.

A leading skippable frame says whether token IDs have 16 or 32 bits (little-endian). Each document's token IDs are a
zstandard frame of their own. A trailing skippable frame holds, for every frame, the leading one included, its compressed and decompressed sizes and the low 32 bits of the XXH64 of its content, in the
public seekable format; the nine bytes at the end say how many frames there are. A reader needs the footer, the table and the
frames of the documents it was asked for.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, shared_dir, slices, texts, written
from .tokens import VOCABULARY, encoding

SKIPPABLE, SEEKABLE, LEADING = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Bytes after which an archive is closed and the next begun.
ARCHIVE = 128 << 20
LEVEL = 3
SCHEMA = "doc_id bigint, archive string, frame bigint, at bigint, size bigint, tokens bigint, width int, checksum bigint"


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """entries: compressed size, decompressed size and checksum of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def head(width: int) -> tuple[bytes, tuple[int, int, int]]:
    """The leading frame and its entry in the seek table: a skippable frame decompresses to nothing."""
    data = struct.pack("<III", LEADING, 4, width)
    return data, (len(data), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)


class Reader:
    """Random access to an archive: seek table and width first, then only the frames asked for, each checked. Frame 0 is
    that of the first document."""

    def __init__(self, file):
        self.file = file
        file.seek(-9, io.SEEK_END)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        file.seek(-(17 + 12 * count), io.SEEK_END)
        head, size = struct.unpack("<II", file.read(8))
        if head != SKIPPABLE or size != 12 * count + 9:
            raise ValueError("damaged seek table")
        table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        file.seek(0)
        magic, size, self.width = struct.unpack("<III", file.read(12))
        if magic != LEADING or size != 4 or self.width not in (2, 4) or not count or table[0, 0] != 12:
            raise ValueError("damaged leading frame")
        self.sizes, self.lengths, self.sums = table[1:, 0], table[1:, 1], table[1:, 2]
        self.at = np.cumsum(table[:, 0])
        self._zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, frame: int) -> np.ndarray:
        if not 0 <= frame < len(self):
            raise IndexError(frame)
        self.file.seek(int(self.at[frame]))
        data = self._zstd.decompress(self.file.read(int(self.sizes[frame])), max_output_size=max(1, int(self.lengths[frame])))
        if len(data) != self.lengths[frame] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(data, f"<u{self.width}")


def _open(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return system, path


def open_archive(uri: str) -> Reader:
    system, path = _open(uri)
    return Reader(system.open_input_file(path))


def write_archives(docs: DataFrame, folder: str, path: str = VOCABULARY, archive: int = ARCHIVE) -> DataFrame:
    """Writes the token IDs of all rows of docs into archives under folder, which all executors must reach, and returns the
    index: doc_id, archive (a URI), frame, at and size (bytes of the frame), tokens, width (bytes of a token), checksum.

    A null text is an empty one and has a frame of no tokens; rows with a null doc_id and repeated rows have frames of their own.
    An empty table gives no archive and an empty index. A task writes under a name of its own attempt and renames when a file
    is whole, so a lost or repeated task leaves whole files that no index names; remove_orphans() deletes them. Other columns are not read.
    """
    spark = docs.sparkSession
    width = 2 if encoding(path).max_token_value < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False)
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, rows, at = None, "", [], 0
        leading, entry = head(width)

        def close() -> pa.RecordBatch:
            out.write(seek_table([entry, *((r[3], r[4] * width, r[5]) for r in rows)]))
            out.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}.zst")
            c = list(zip(*rows))
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array([f"{folder}/{name}.zst"] * n), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array([width] * n, pa.int32()), pa.array(c[5], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for piece in slices(batches, "text"):
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                if out is None:
                    name, rows, at = uuid.uuid4().hex, [], len(leading)
                    out = system.open_output_stream(f"{root}/{name}.part")
                    out.write(leading)
                ids = np.array(encode(text) if text else [], f"<u{width}")
                data = ids.tobytes()
                frame = zstd.compress(data)
                out.write(frame)
                rows.append((doc, len(rows), at, len(frame), len(ids), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
                at += len(frame)
                if at >= archive:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    source = texts(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return written(spark, arrow(source, write, SCHEMA), "archive-index")


def remove_orphans(index: DataFrame, folder: str) -> int:
    """Deletes the files under folder that the whole index does not name, once no task writes there; returns how many."""
    from pyarrow import fs

    system, root = _open(folder)
    there = [(x.base_name,) for x in system.get_file_info(fs.FileSelector(root)) if x.is_file]
    files = index.sparkSession.createDataFrame(there, "name string")
    gone = [r[0] for r in files.join(index.select(F.element_at(F.split("archive", "/"), -1).alias("name")), "name", "left_anti").collect()]
    for name in gone:
        system.delete_file(f"{root}/{name}")
    return len(gone)


def read_archives(index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the rows of an index, which may be any part of one: each task opens an archive once for all its frames."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            docs, ids = b.column("doc_id"), []
            for uri, frame in zip(b.column("archive").to_pylist(), b.column("frame").to_pylist()):
                if uri != name:
                    name, reader = uri, open_archive(uri)
                ids.append(reader[frame].astype(np.int32))
            yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    wanted = index.select("doc_id", "archive", "frame").repartition("archive").sortWithinPartitions("archive", "frame")
    return arrow(wanted, read, "doc_id bigint, ids array<int>")


def op2_token_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all documents, in the shared folder, and their index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = write_archives(docs, f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}")
    return index.select("doc_id", "archive", "frame", "at", "size", "tokens", "width", "checksum")
