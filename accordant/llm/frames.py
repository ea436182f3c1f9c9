"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each with its own checksum, that any zstandard reader can
unpack, then two skippable frames: the document index (ids, lengths, frame numbers) and the seek
table of the public seekable format (sizes and an XXH64 checksum per frame, footer last).  A reader
takes footer, table and index from the end of the file and unpacks only the frames that hold
the documents asked for.

Files are written by the tasks into the shared folder, through the file system that its URI names.
Each attempt writes a file of its own, and only the files of the attempts that Spark counts stand
in the manifest table, so a lost executor or a repeated task leaves no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from accordant.llm.common import whole_text
from accordant.llm.tokens import word_level
from accordant.sources.workspace import fresh_path, stored

#: Fixed values of the zstandard formats.
SKIPPABLE, SEEK_MAGIC, SEEK_FOOTER, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Writer:
    """Writes documents in order; a frame ends once it holds ``frame_ids`` ids."""

    def __init__(self, sink, frame_ids: int = 1 << 18, level: int = 1):
        self.sink, self.frame_ids = sink, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.open: list[bytes] = []
        self.held = 0
        self.docs: list[tuple[int, int, int]] = []
        self.frames: list[tuple[int, int, int]] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        """``ids`` are packed; a document never spans frames."""
        self.docs.append((doc_id, len(ids) // 4, len(self.frames)))
        self.open.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.open)
        frame = self.pack(raw)
        self.sink.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        ids, lengths, frames = (np.array([d[k] for d in self.docs], dtype=t) for k, t in enumerate(("<i8", "<u4", "<u4")))
        index = zstandard.ZstdCompressor(write_checksum=True).compress(ids.tobytes() + lengths.tobytes() + frames.tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0, xxhash.xxh64(b"").intdigest() & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file (a seekable binary source)."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * count
        self.frames = list(struct.iter_unpack("<III", self._at(start, 12 * count)))
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])])
        if struct.unpack("<II", self._at(start - 8, 8)) != (SEEK_MAGIC, 12 * count + 9) or self.offsets[-1] != start - 8:
            raise ValueError("the seek table does not fit the file")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[-2]) + 8, self.frames[-1][0] - 8))
        n = len(index) // 16
        self.ids, self.lengths, self.at = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u4", n, 8 * n), np.frombuffer(index, "<u4", n, 12 * n)

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), self.frames[k][0]), max_output_size=self.frames[k][1])
        if len(raw) != self.frames[k][1] or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, int, int, bytes]]:
        """(position, document id, first id's place in the file, packed ids) of all or the wanted documents."""
        starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        rows = np.arange(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)))
        for k in np.unique(self.at[rows]):
            raw = self.frame(int(k))
            first = int(starts[np.searchsorted(self.at, k)])
            for row in rows[self.at[rows] == k].tolist():
                a = 4 * (int(starts[row]) - first)
                yield row, int(self.ids[row]), int(starts[row]), raw[a : a + 4 * int(self.lengths[row])]


#: Stands for a missing id in the files.
NO_ID = -(1 << 63)


def open_file(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name), system.get_file_info(name).size


def write(docs: DataFrame, *, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
          rows_per_file: int = 8192, frame_ids: int = 1 << 18, folder: str | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write them in ascending id order.

    Returns the manifest: (path, documents, tokens, start), ``start`` being the number of ids in all files
    before.  Files hold ranges of ids; rows of one id are ordered by a hash of their text, so
    that even one id on a third of all rows is spread.  Null ids come first: the files hold the least long
    for them, which is no id otherwise, and ``read`` gives null; null texts are empty.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-frames")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), whole_text(text_col).alias("text"))
    files = max(1, -(-rows.count() // rows_per_file))
    tie = F.xxhash64("text")
    ordered = rows.withColumn("tie", tie).repartitionByRange(files, "id", "tie").sortWithinPartitions("id", "tie")

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_level(vocabulary).encode, struct.pack("<I", end_id)
        writer = path = sink = None
        first, tokens = (0, 0), 0
        for batch in it:
            for start in range(0, batch.num_rows, 64):
                cols = batch.slice(start, 64).to_pydict()
                for i, text, t in zip(cols["id"], cols["text"], cols["tie"]):
                    if writer is None:
                        system, name = fs.FileSystem.from_uri(folder)
                        system.create_dir(name, recursive=True)
                        path = f"{folder}/{uuid.uuid4().hex}.ids.zst"
                        sink = system.open_output_stream(fs.FileSystem.from_uri(path)[1], compression=None)
                        writer, first = Writer(sink, frame_ids), (i, t)
                    ids = encode(text) + end
                    writer.add(i, ids)
                    tokens += len(ids) // 4
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_id": [first[0]], "first_tie": [first[1]], "documents": [len(writer.docs)], "tokens": [tokens]})

    manifest = stored(ordered.mapInArrow(save, "path string, first_id bigint, first_tie bigint, documents bigint, tokens bigint"), "manifest")
    # One row per file: the only global order is over this small table.
    before = Window.orderBy("first_id", "first_tie", "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", "documents", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))


def read(manifest: DataFrame, wanted: Iterable[int] | None = None, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in the files of a manifest."""
    only = None if wanted is None else set(wanted)

    def load(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                source, size = open_file(path)
                with source:
                    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                    for _, doc_id, place, ids in Reader(source, size).read(only):
                        for name, v in zip(out, (None if doc_id == NO_ID else doc_id, start + place, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)):
                            out[name].append(v)
                        if len(out["ids"]) >= 256:
                            yield pa.RecordBatch.from_pydict(out, schema=schema)
                            out = {k: [] for k in out}
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
