"""Token files: one zstandard frame per document, then a seek table with a checksum per frame.

Layout of a file: the documents' frames (ids as little-endian unsigned 32-bit integers); a skippable frame with
the documents' ids; a skippable frame with the seek table of the seekable zstandard format. Any zstandard
reader decompresses the file as a whole; a reader of single documents takes the table from the end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindermap.llm.tokens import encoder
from cindermap.session import materialize

# Fixed values of the format: skippable frames for the document ids and for the seek table, the table's last bytes.
IDS_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HAS_CHECKSUMS = 0x80
_ENTRY = struct.Struct("<III")
_BATCH_BYTES = 8 << 20
_ID = struct.Struct("<?q")  # whether the id is null, the id


def checksum(data: bytes) -> int:
    """Lowest 32 bits of the frame's content hash, as the format has it."""
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Writes documents to a binary stream, one independent frame each; only the table stays in memory."""

    def __init__(self, out, level: int = 3):
        self.out, self.frames = out, zstandard.ZstdCompressor(level=level)
        self.entries, self.ids, self.n_tokens = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) >= 1 << 32:
            raise ValueError(f"document {doc_id} has {len(ids)} bytes of ids; a frame of the format holds less than 4 GiB")
        frame = self.frames.compress(ids)
        self.out.write(frame)
        self.entries.append(_ENTRY.pack(len(frame), len(ids), checksum(ids)))
        self.ids.append(_ID.pack(doc_id is None, doc_id or 0))
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        footer = struct.pack("<IBI", len(self.entries), _HAS_CHECKSUMS, FOOTER_MAGIC)
        for magic, body in ((IDS_MAGIC, b"".join(self.ids)), (TABLE_MAGIC, b"".join(self.entries) + footer)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)


class Reader:
    """Documents of a file by their place; reads the table at the end, then only the frames that are asked for."""

    def __init__(self, file):
        self.file, self.frames = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & _HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - n * _ENTRY.size
        self.entries = list(_ENTRY.iter_unpack(self._at(table, n * _ENTRY.size)))
        self.ids = [None if null else i for null, i in _ID.iter_unpack(self._at(table - 8 - n * _ID.size, n * _ID.size))]
        self.places, place = [], 0
        for packed, _, _ in self.entries:
            self.places.append(place)
            place += packed

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def document(self, at: int) -> bytes:
        packed, size, wanted = self.entries[at]
        ids = self.frames.decompress(self._at(self.places[at], packed), max_output_size=size)
        if len(ids) != size or checksum(ids) != wanted:
            raise ValueError(f"frame {at} (document {self.ids[at]}) is damaged: its checksum differs")
        return ids


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, leading_space: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode documents and write them in ascending order of ``key`` to token files; one row per file.

    Documents are dealt by ranges of the key, each range is sorted and makes one file, so files in the order of
    ``part`` hold all documents in order. A null key comes first; rows of one key follow each
    other by a hash of the text; a null or empty text is its end id alone. A task writes under a name of its
    attempt and renames at the end, so a lost or repeated task leaves one whole file. ``folder``
    must be one that all executors share. No rows make no files.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(tokenizer, leading_space, special_as_text=False), struct.pack("<I", end_id), TaskContext.get()
        files, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/tokens-{task.partitionId():05d}.zst"
        own, writer = f"{path}.{task.taskAttemptId()}", None
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    files.create_dir(base, recursive=True)
                    stream = files.open_output_stream(own)
                    writer = Writer(stream)
                writer.add(doc, encode(body.as_py() or "") + end)
        if writer is not None:
            writer.close()
            stream.close()
            files.move(own, path)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [path.rsplit("/", 1)[1]], "n_docs": [len(writer.entries)], "n_tokens": [writer.n_tokens]})

    return materialize(ranged.mapInArrow(write, "part int, file string, n_docs long, n_tokens long"), "files")


def read_token_files(files: DataFrame, folder: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids.

    ``files``: the rows that writing returned. With ``doc_ids``, only the frames of these documents are read and decompressed.
    Every frame is checked against its checksum.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = materialize(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "files")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as file:
                    reader, out, held = Reader(file), [], 0
                    for at, (doc, entry) in enumerate(zip(reader.ids, reader.entries)):
                        if wanted is None or doc in wanted:
                            out.append((doc, start, entry[1] // 4, reader.document(at)))
                            held += entry[1]
                        start += entry[1] // 4
                        if held > _BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return placed.select("file", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
