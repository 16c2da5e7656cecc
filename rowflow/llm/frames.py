"""Token-id files of independent zstandard frames with a seek table at the end.

A file holds documents in order, each in one or more frames of its own (unsigned 32-bit
little-endian ids, at most FRAME_IDS in a frame). Behind the frames come two skippable frames:
the document index (magic INDEX) and the seek table of the public zstandard seekable format
(magic TABLE, per frame its compressed size, plain size and the low 32 bits of the xxh64 of the
plain bytes). Any zstandard tool can decompress the file; a reader here fetches the tail and
then only the frames of the documents it wants, and compares their checksums.

Files are written under a name of the attempt and only those in the manifest count, so a task
that is lost or runs twice leaves no wrong rows.

Null texts are empty documents. Rows with a null id come first, repeated rows are separate
documents, an empty table gives an empty manifest. Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowflow.session import scratch_path

#: Fixed values of the zstandard seekable format; INDEX is one of the free skippable magics.
TABLE, SEEKABLE, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
FRAME_IDS = 1 << 20
MANIFEST = "part long, path string, n_docs long, n_ids long"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FrameWriter:
    """Writes documents one by one; ``close`` adds the index and the seek table."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        first = len(self.frames)
        for at in range(0, len(ids), FRAME_IDS):
            plain = ids[at : at + FRAME_IDS].astype("<u4").tobytes()
            packed = self.pack(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs.append((doc_id is not None, doc_id or 0, first, len(ids)))

    def close(self) -> None:
        index = np.array(self.docs, dtype="<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        body = np.array(self.frames, dtype="<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", TABLE, len(body)) + body)
        self.out.close()


class FrameReader:
    """Reads the tail of a file, and then the frames of single documents."""

    def __init__(self, file):
        import zstandard

        self.file, size = file, file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        self.table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(-1, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        magic, length = struct.unpack("<II", self._at(int(self.offset[-1]), 8))
        if magic != INDEX:
            raise ValueError("no document index")
        self.docs = np.frombuffer(self._at(int(self.offset[-1]) + 8, length), dtype="<i8").reshape(-1, 4)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, i: int) -> int | None:
        return int(self.docs[i, 1]) if self.docs[i, 0] else None

    def ids(self, i: int) -> np.ndarray:
        import xxhash

        first, left, parts = int(self.docs[i, 2]), int(self.docs[i, 3]), []
        while left > 0:
            packed, plain, check = self.table[first].tolist()
            data = self.unpack(self._at(int(self.offset[first]), packed), max_output_size=plain)
            if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {first} is damaged")
            parts.append(np.frombuffer(data, dtype="<u4"))
            left -= len(parts[-1])
            first += 1
        return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def write(docs: DataFrame, encode: Callable[[Iterable[str]], Iterator[np.ndarray]], folder: str) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order, one file per range of ids.

    ``encode`` turns texts into id arrays inside the tasks. Returns the manifest, one row per
    file in order (``part``).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def write_part(frames):
        import pandas as pd

        part, path, writer = TaskContext.get().partitionId(), "", None
        ids: list = []

        def texts():
            for frame in frames:
                for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                    ids.append(None if pd.isna(doc_id) else int(doc_id))
                    yield text

        n_docs = n_ids = 0
        for found in encode(texts()):
            if writer is None:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                files, inner = _files(path)
                files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                writer = FrameWriter(files.open_output_stream(inner, compression=None))
            writer.add(ids[n_docs], found)
            ids[n_docs] = None
            n_docs, n_ids = n_docs + 1, n_ids + len(found)
        if writer:
            writer.close()
            yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    at = f"{folder}/manifest"
    ordered.mapInPandas(write_part, MANIFEST).write.parquet(at)
    return spark.read.schema(MANIFEST).parquet(at)


def map_documents(manifest: DataFrame, fn: Callable[[np.ndarray], tuple], schema: str, wanted: Callable[[int | None], bool] | None = None) -> DataFrame:
    """Read the files of a manifest, one task each, and apply ``fn`` to the ids of every document
    (or of those whose doc_id is ``wanted``; other frames are not fetched).

    Gives doc_id, start (ids of all documents before it), n_tokens and the columns of ``schema``.
    """
    import pandas as pd

    files = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    columns = ["doc_id", "start", "n_tokens", *(c.split()[0] for c in schema.split(","))]

    def read(frames):
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"].tolist()):
                system, inner = _files(path)
                with system.open_input_file(inner) as file:
                    reader, rows = FrameReader(file), []
                    for i in range(len(reader)):
                        size = int(reader.docs[i, 3])
                        if wanted is None or wanted(reader.doc_id(i)):
                            rows.append((reader.doc_id(i), start, size, *fn(reader.ids(i))))
                        start += size
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return placed.select("path", "start").repartition(max(1, files)).mapInPandas(read, f"doc_id long, start long, n_tokens long, {schema}")


def read(manifest: DataFrame, wanted: Callable[[int | None], bool] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and the ids of the documents of a manifest."""
    return map_documents(manifest, lambda ids: (ids.tolist(),), "ids array<long>", wanted)


def folder(spark: SparkSession) -> str:
    """A new folder for one set of files."""
    return scratch_path(spark, "token-frames")
