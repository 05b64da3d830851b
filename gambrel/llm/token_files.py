"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in order: data frames of whole documents' ids (little-endian, two or four bytes an id); a skippable frame
with the document index; and the public zstandard seekable format's table, a skippable frame that ends the file and
lists every frame's compressed and decompressed size and the low 32 bits of the XXH64 of its decompressed bytes. A reader
takes the table and the index from the end and decompresses only frames with documents that it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from gambrel.llm.common import SLICE_ROWS, byte_slices, materialise, quoted, scratch
from gambrel.llm.encoding import encoder
from gambrel.llm.store import make_dir, open_fs

#: Fixed values of the seekable format and of skippable frames.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME, CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
#: Decompressed bytes after which a frame is closed; a longer document has a frame of its own.
FRAME_BYTES = 1 << 20
LEVEL = 3
#: doc_id, whether it is set, frame, first id in the frame, number of ids
ENTRY = np.dtype([("doc", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("count", "<u4")])
MANIFEST = "part int, path string, width int, docs long, ids long"


def check_sum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """Streams documents into one file; holds one frame and the index in memory."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.buffer, self.filled = out, width, [], 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.entries: list[tuple[int, int, int, int, int]] = []
        self.ids = 0

    def add(self, doc: int | None, packed: bytes) -> None:
        count = len(packed) // self.width
        self.entries.append((doc or 0, doc is not None, len(self.frames), self.filled // self.width, count))
        self.buffer.append(packed)
        self.filled += len(packed)
        self.ids += count
        if self.filled >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        data = b"".join(self.buffer)
        frame = self.pack(data)
        self.out.write(frame)
        self.frames.append((len(frame), len(data), check_sum(data)))
        self.buffer, self.filled = [], 0

    def finish(self) -> None:
        if self.buffer:
            self._close_frame()
        index = np.array(self.entries, ENTRY).tobytes()
        body = struct.pack("<B", self.width) + index
        self.out.write(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        self.frames.append((8 + len(body), 0, check_sum(b"")))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_MAGIC))


class FileReader:
    """Reads the seek table and index of a file; then frames on demand, each checked."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = self._read(size - 9 - 12 * count, 12 * count)
        self.frames = [struct.unpack_from("<III", table, 12 * k) for k in range(count)]
        self.starts = [0, *np.cumsum([f[0] for f in self.frames]).tolist()]
        body = self._read(self.starts[count - 1] + 8, self.frames[-1][0] - 8)
        self.width = body[0]
        self.index = np.frombuffer(body, ENTRY, offset=1)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        data = self.unpack(self._read(self.starts[k], self.frames[k][0]))
        if len(data) != self.frames[k][1] or check_sum(data) != self.frames[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4")

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the file, and its ids; with ``wanted`` only those, from their frames alone."""
        before, held, ids = 0, -1, None
        for doc, known, frame, at, count in self.index.tolist():
            doc = doc if known else None
            if wanted is None or doc in wanted:
                if frame != held:
                    held, ids = frame, self.frame(frame)
                yield doc, before, ids[at : at + count]
            before += count


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode every text, in ascending id order over numbered files, and return the committed manifest: part, path,
    width, docs, ids.

    Null texts are empty; null ids come first; equal ids follow each other in any order. An empty table gives an empty
    manifest. Every attempt of a task writes a file with a name of its own, and only files of attempts that Spark
    committed are in the manifest, so a lost executor costs a task and leaves no wrong file in use.
    """
    folder = folder or scratch(docs.sparkSession, "token-files")
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        part = TaskContext.get().partitionId()
        fs, at = open_fs(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst")
        out = None
        for some in byte_slices(batches, 1):
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if out is None:
                    out = fs.open_output_stream(at, compression=None)
                    file = FileWriter(out, enc.width)
                file.add(doc, enc.encode(text or "") + end)
        if out is not None:
            file.finish()
            out.close()
            row = [[part], [at if folder.startswith(("/", "file:")) else f"{folder}/{at.rpartition('/')[2]}"], [enc.width], [len(file.entries)], [file.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int32()), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], names=["part", "path", "width", "docs", "ids"])

    ordered = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).repartitionByRange("doc").sortWithinPartitions("doc")
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, wanted: set | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32-bit). ``wanted`` restricts the read to those documents and to the frames that hold them.

    The manifest has one row a file; its counts alone come to the driver, to number the files' first ids.
    """
    spark: SparkSession = manifest.sparkSession
    files, start = [], 0
    for r in sorted(manifest.select("part", "path", "ids").collect()):
        files.append((start, r.path))
        start += r.ids
    listed = spark.createDataFrame(files, "start long, path string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for first, path in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = open_fs(path)
                rows = []
                with fs.open_input_file(at) as source:
                    for doc, before, ids in FileReader(source).documents(wanted):
                        rows.append((doc, first + before, len(ids), ids.astype("<u4").tobytes()))
                        if len(rows) == SLICE_ROWS:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
