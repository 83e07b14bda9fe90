"""Token-id files: independent zstandard frames, a document index, and a trailing seek table with checksums.

A file is a sequence of zstandard frames that each hold the ids of whole documents, little-endian. Two
skippable frames follow. The first holds the document index: for each document its id, number of ids and frame.
The second is a seek table as the zstandard seekable format defines it: each frame's compressed and decompressed
size and the low 32 bits of its XXH64, then the number of frames, a descriptor and a magic number. A reader gets the table from
the file's end and reads and decompresses only the frames it needs; plain zstandard tools skip both tables.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, new_path, texts_of
from tessera.llm.token_ids import encoder_of

#: Fixed values of the seekable format, and the magic number of this format's index frame.
SEEK_FRAME, SEEK_END, CHECKSUMS, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x80, 0x184D2A50
#: A frame is closed once it holds so many bytes of ids. A document is never split, so a long one may exceed it.
FRAME_BYTES = 1 << 18
_INDEX_HEAD = struct.Struct("<QB")
_SEEK_FOOT = struct.Struct("<IBI")


class TokenWriter:
    """Writes documents, in the order given, to one file. Memory holds one frame and the index."""

    def __init__(self, out, dtype: np.dtype, level: int = 3):
        self.out, self.dtype = out, np.dtype(dtype)
        self._packer = zstandard.ZstdCompressor(level=level)
        self._open: list[bytes] = []
        self._size = 0
        self._frames: list[tuple[int, int, int]] = []
        self._docs: list[tuple[int, bool, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id or 0, doc_id is None, len(ids) // self.dtype.itemsize, len(self._frames)))
        self._open.append(ids)
        self._size += len(ids)
        if self._size >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        plain = b"".join(self._open)
        packed = self._packer.compress(plain)
        self.out.write(packed)
        self._frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self._open, self._size = [], 0

    def close(self) -> None:
        if self._open:
            self._close_frame()
        columns = list(zip(*self._docs)) or [()] * 4
        index = b"".join(np.asarray(c, t).tobytes() for c, t in zip(columns, ("<i8", "u1", "<i8", "<i4")))
        packed = _INDEX_HEAD.pack(len(self._docs), self.dtype.itemsize) + self._packer.compress(index)
        self.out.write(struct.pack("<II", INDEX_FRAME, len(packed) + 8) + packed + struct.pack("<Q", len(packed)))
        table = np.asarray(self._frames, "<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + _SEEK_FOOT.size) + table + _SEEK_FOOT.pack(len(self._frames), CHECKSUMS, SEEK_END))


class TokenReader:
    """Reads documents of a file; only the frames that hold them are read, checked and decompressed."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = _SEEK_FOOT.unpack(self._read(size - _SEEK_FOOT.size, _SEEK_FOOT.size))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError("no seek table at the file's end")
        start = size - _SEEK_FOOT.size - 12 * frames - 8
        self.frames = np.frombuffer(self._read(start + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        (length,) = struct.unpack("<Q", self._read(start - 8, 8))
        head = self._read(start - 8 - length, length)
        docs, width = _INDEX_HEAD.unpack(head[: _INDEX_HEAD.size])
        self.dtype = np.dtype(f"<u{width}")
        index = zstandard.ZstdDecompressor().decompress(head[_INDEX_HEAD.size :], max_output_size=21 * docs + 1)
        at, self.columns = 0, []
        for t in ("<i8", "u1", "<i8", "<i4"):
            end = at + docs * np.dtype(t).itemsize
            self.columns.append(np.frombuffer(index[at:end], t))
            at = end
        self.doc_ids, self.nulls, self.lengths, self.frame_of = self.columns

    def _read(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame k."""
        packed, plain, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self._read(self.starts[k], packed), max_output_size=max(1, int(plain)))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(data, self.dtype)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of all documents in file order."""
        bounds = np.searchsorted(self.frame_of, np.arange(len(self.frames) + 1))
        for k in range(len(self.frames)):
            ids, at = self.frame(k), 0
            for i in range(bounds[k], bounds[k + 1]):
                yield None if self.nulls[i] else int(self.doc_ids[i]), ids[at : at + self.lengths[i]]
                at += self.lengths[i]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document of that id."""
        found = []
        for i in np.flatnonzero((self.doc_ids == doc_id) & (self.nulls == 0)):
            first = np.searchsorted(self.frame_of, self.frame_of[i])
            at = int(self.lengths[first:i].sum())
            found.append(self.frame(int(self.frame_of[i]))[at : at + self.lengths[i]])
        return found


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all docs, encoded with the tokenizer file at `path`, to files in `folder`; return their manifest.

    Documents lie in ascending doc_id order within and over the files; a null id comes first, rows of equal
    ids in any order. Each task writes one file under a name of its own, and only files in the manifest
    count, so a task that runs twice does no harm. `folder` is a URI that pyarrow opens on every executor.
    Manifest: file, first_id, n_docs, n_ids. Null text counts as empty; an empty table gives an empty manifest; other
    columns are ignored. A document is never split, so a long one makes a frame of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, writer, first, total = encoder_of(path), None, None, None, [0, 0]
        end = b"" if end_id is None else np.asarray([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for own_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1)))):
                if writer is None:
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    file, first = f"{folder}/{uuid.uuid4().hex}.zst", own_id
                    out = store.open_output_stream(f"{place}/{file.rpartition('/')[2]}", compression=None)
                    writer = TokenWriter(out, encoder.dtype)
                writer.add(own_id, ids + end)
                total[0] += 1
                total[1] += len(ids + end) // encoder.dtype.itemsize
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "first_id": first, "n_docs": total[0], "n_ids": total[1]}], schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(dealt.mapInArrow(write, "file string, first_id long, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the files of a manifest; each task reads files, not rows.

    start counts the ids of all documents before it; ids are little-endian unsigned 32-bit integers. The
    manifest, one row a file, is put in order on the driver as file listings are.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0)):
        files.append((row.file, start))
        start += row.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(file)
                with store.open_input_file(place) as source:
                    rows, size = [], 0
                    for own_id, ids in TokenReader(source):
                        rows.append((own_id, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        size += 4 * len(ids)
                        if size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    listed = spark.createDataFrame(files, "file string, start long").repartition(len(files))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def token_folder(docs: DataFrame) -> str:
    """A fresh folder for token files under the shared work folder, as a URI."""
    folder = new_path(docs.sparkSession, "tokens")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
