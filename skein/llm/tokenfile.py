"""Token-ID output: independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds frames of whole documents' ids (little-endian, two or four bytes each), a skippable frame
with the index of documents, and the seek table of the public seekable zstandard format (also a skippable
frame), so any zstandard decoder reads the ids and a reader that knows the table decompresses only the
frames that hold the documents it asks for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import fresh_path, stored
from skein.llm.tokens import encoder, tokenizer_path

# Fixed values of the seekable format: skippable frame magics, footer magic, checksum flag.
SKIP_INDEX, SKIP_TABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES, LEVEL = 1 << 18, 1
#: Bytes of text, and what a row counts besides, that a file holds about; rows that a reader gives at a time.
FILE_BYTES, ROW_BYTES, READ_ROWS = 256 << 20, 64, 1 << 16
_INDEX = np.dtype([("doc", "<i8"), ("known", "u1"), ("tokens", "<u8"), ("frame", "<u4")])


class CorruptFrame(ValueError):
    """A frame's bytes don't match its checksum, or the file isn't of this format."""


@dataclass
class Writer:
    """Writes documents, in the order given, to an open binary file."""

    out: object
    width: int = 4
    frame_bytes: int = FRAME_BYTES
    held: list[np.ndarray] = field(default_factory=list)
    held_bytes: int = 0
    index: list[np.ndarray] = field(default_factory=list)
    frames: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose ids are ids[offsets[k] : offsets[k + 1]]; `known` is false where the id of a document is null."""
        rows = np.zeros(len(doc_ids), _INDEX)
        rows["doc"], rows["known"], rows["tokens"] = doc_ids, known, np.diff(offsets)
        k = 0
        while k < len(doc_ids):
            room = max(1, (self.frame_bytes - self.held_bytes) // self.width)
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + room, side="right")) - 1)
            rows["frame"][k:end] = len(self.frames)
            self.held.append(ids[offsets[k] : offsets[end]].astype(f"<u{self.width}"))
            self.held_bytes += self.held[-1].nbytes
            k = end
            if self.held_bytes >= self.frame_bytes or k < len(doc_ids):
                self.flush()
        self.index.append(rows)

    def flush(self) -> None:
        raw = b"".join(a.tobytes() for a in self.held)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        rows = np.concatenate(self.index) if self.index else np.zeros(0, _INDEX)
        raw = struct.pack("<B", self.width) + rows.tobytes()
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
        body = packed + struct.pack("<QI", len(packed), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.out.write(struct.pack("<II", SKIP_INDEX, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames, (8 + len(body), 0, 0)])
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames) + 1, CHECKSUMS, SEEK_MAGIC))


class Reader:
    """Reads documents from an open, seekable binary file of `size` bytes; the last entry of the table is the index."""

    def __init__(self, source, size: int):
        self.source = source
        if size < 17:
            raise CorruptFrame("shorter than a seek table")
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS or 17 + 12 * n > size:
            raise CorruptFrame("no seek table")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.table, self.start = table[:-1], np.concatenate([[0], np.cumsum(table[:, 0])])
        tail = int(self.start[n - 1]) + int(table[-1, 0]) - 12
        length, check = struct.unpack("<QI", self._at(tail, 12))
        raw = zstandard.ZstdDecompressor().decompress(self._at(tail - length, length))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise CorruptFrame("index")
        self.width, self.index = raw[0], np.frombuffer(raw, _INDEX, offset=1)
        tokens = self.index["tokens"].astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(tokens)])
        first = np.searchsorted(self.index["frame"], np.arange(len(self.table)))
        self.frame_before = self.before[first]

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(size))

    def frame(self, k: int) -> np.ndarray:
        size, length, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.start[k], size), max_output_size=int(length))
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise CorruptFrame(f"frame {k}")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the index, ids) of the rows asked for, all if None; a frame is decompressed once if rows ascend."""
        at, ids = -1, np.zeros(0, np.uint32)
        for r in range(len(self.index)) if rows is None else rows:
            k = int(self.index["frame"][r])
            if k != at:
                at, ids = k, self.frame(k)
            a = self.before[r] - self.frame_before[k]
            yield r, ids[a : a + int(self.index["tokens"][r])]


def _store(uri: str):
    """(file system, path) of a URI of any store that pyarrow reads: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode `docs` and write one file for each range of doc_id to `folder`; returns the manifest.

    Ids ascend over the files in order of `part` and inside each; equal ids stand by text, null ids come first,
    null text counts as empty (its only token is `end_id`). The manifest (part, path, n_docs, n_tokens, first_id, last_id) lists
    the files that hold; a task that runs again writes a file of another name, so lost executors do no harm. There are as
    many files as shuffle partitions, and more where a file would hold more than FILE_BYTES.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    n = files
    if n is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    dealt = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, docs, tokens, ends = TaskContext.get().partitionId(), encoder(path), 0, 0, []
        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        name = f"{where}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        out = writer = None
        for batch in batches:
            keys = batch.column(0)
            known = np.array(keys.is_valid())
            if keys.null_count < len(keys):
                ends = [*ends[:1], *keys.drop_null()[:: max(1, len(keys) - keys.null_count - 1)].to_pylist()]
            values = np.array(keys.fill_null(0))
            for lo, hi, ids, offsets in enc.encode(batch.column(1).to_pylist()):
                if writer is None:
                    out = store.open_output_stream(name, compression=None)
                    writer = Writer(out, 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4)
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                writer.add(values[lo:hi], known[lo:hi], ids, offsets)
                docs, tokens = docs + hi - lo, tokens + int(offsets[-1])
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ends[0] if ends else None], pa.int64()), pa.array([ends[-1] if ends else None], pa.int64())], names=["part", "path", "n_docs", "n_tokens", "first_id", "last_id"])

    return stored(dealt.mapInArrow(run, "part int, path string, n_docs long, n_tokens long, first_id long, last_id long"), "token_manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files in `manifest`: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file: as few as partitions were written
    listed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    crcs = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()), np.int64, len(reader.index))
                for lo in range(0, len(crcs), READ_ROWS):
                    own = slice(lo, min(lo + READ_ROWS, len(crcs)))
                    keys = pa.array(reader.index["doc"][own], mask=reader.index["known"][own] == 0)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + reader.before[:-1][own]), pa.array(reader.index["tokens"][own].astype(np.int64)), pa.array(crcs[own])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, folder: str, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents of the files in `manifest` whose ids `wanted` holds: only the frames that hold them are read and
    decompressed, each once. Ids that no file has and null ids give no row; rows that share an id are all given.
    """
    spark = manifest.sparkSession
    files = manifest.filter(F.col("first_id").isNotNull()).orderBy("part").select("path", "first_id", "last_id").collect()  # a row for each file
    sent = spark.sparkContext.broadcast(([f.path for f in files], np.array([f.first_id for f in files], np.int64), np.array([f.last_id for f in files], np.int64)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, first, last = sent.value
        for batch in batches:
            ids = np.array(batch.column(0))
            at = np.searchsorted(first, ids, side="right") - 1
            held = np.flatnonzero((at >= 0) & (ids <= last[np.maximum(at, 0)])) if len(first) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([paths[k] for k in at[held]], pa.string()), pa.array(ids[held])], names=["path", "doc_id"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    rows = np.flatnonzero((reader.index["known"] == 1) & np.isin(reader.index["doc"], ids))
                    for lo in range(0, len(rows), 1024):
                        some = [(int(reader.index["doc"][r]), x.astype(np.int64)) for r, x in reader.documents(rows[lo : lo + 1024].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([x for _, x in some], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    asked = wanted.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    # the ids asked of a file are one row: never more than the file has documents of
    return asked.mapInArrow(locate, "path string, doc_id long").groupBy("path").agg(F.collect_list("doc_id").alias("ids")).mapInArrow(read, "doc_id long, ids array<long>")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write `docs` (doc_id, text) as token files and return what read_token_files finds in them."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id), folder)
