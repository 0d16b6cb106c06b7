"""dBASE (DBF) tables as a Spark data source (S3).

Records have a fixed width, so a file splits into record ranges by arithmetic and
each task reads only its own bytes. Blank fields are missing; deleted records are
skipped. Character fields are text; a caller's schema may ask for text in any field.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS_PER_TASK = 500_000
RECORDS_PER_BATCH = 20_000


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    offset: int
    length: int
    decimals: int

    @property
    def spark_type(self) -> T.DataType:
        if self.kind in ("N", "F"):
            return T.DoubleType() if self.decimals or self.kind == "F" else T.LongType()
        if self.kind == "L":
            return T.BooleanType()
        return T.StringType()


@dataclass(frozen=True)
class Layout:
    records: int
    header_bytes: int
    record_bytes: int
    fields: tuple[Field, ...]


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    filesystem, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return filesystem.open_input_file(inner)


def _expand(path: str) -> list[str]:
    """A path may be one file, several joined by commas, or a folder of ``.dbf`` files."""
    from pyarrow import fs

    found = []
    for part in path.split(","):
        filesystem, inner = (
            fs.FileSystem.from_uri(part) if "://" in part else (fs.LocalFileSystem(), part.removeprefix("file:"))
        )
        info = filesystem.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            prefix = part[: len(part) - len(inner)] if part.endswith(inner) else ""
            names = filesystem.get_file_info(fs.FileSelector(inner))
            found += sorted(prefix + f.path for f in names if f.path.lower().endswith(".dbf"))
        else:
            found.append(part)
    return found


def read_layout(path: str) -> Layout:
    with _open(path) as f:
        head = f.read(32)
        records, header_bytes, record_bytes = struct.unpack("<IHH", head[4:12])
        described = f.read(header_bytes - 32)
    fields, offset = [], 1  # byte 0 of a record is the deletion mark
    for at in range(0, len(described) - 31, 32):
        entry = described[at : at + 32]
        if entry[0] == 0x0D:
            break
        name = entry[:11].split(b"\0", 1)[0].decode("ascii").strip()
        fields.append(Field(name, chr(entry[11]), offset, entry[16], entry[17]))
        offset += entry[16]
    return Layout(records, header_bytes, record_bytes, tuple(fields))


@dataclass
class RecordRange(InputPartition):
    path: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.stop))


class DbfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema = schema
        self.paths = _expand(options["path"])
        self.per_task = int(options.get("recordspertask", RECORDS_PER_TASK))
        self.encoding = options.get("encoding", "latin-1")

    def partitions(self) -> Sequence[InputPartition]:
        ranges = []
        for path in self.paths:
            n = read_layout(path).records
            ranges += [RecordRange(path, s, min(s + self.per_task, n)) for s in range(0, n, self.per_task)]
        return ranges or [RecordRange(self.paths[0], 0, 0)]

    def read(self, part: RecordRange) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        layout = read_layout(part.path)
        by_name = {f.name: f for f in layout.fields}
        arrow = {
            T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(),
            T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
        }
        with _open(part.path) as f:
            for start in range(part.start, part.stop, RECORDS_PER_BATCH):
                count = min(RECORDS_PER_BATCH, part.stop - start)
                f.seek(layout.header_bytes + start * layout.record_bytes)
                raw = np.frombuffer(f.read(count * layout.record_bytes), dtype=np.uint8)
                if len(raw) < count * layout.record_bytes:
                    raise ValueError(f"{part.path} ends within record {start + len(raw) // layout.record_bytes}, before the number its header gives")
                rows = raw.reshape(-1, layout.record_bytes)
                rows = rows[rows[:, 0] != ord("*")]
                columns = []
                for wanted in self.schema.fields:
                    field = by_name[wanted.name]
                    cells = np.ascontiguousarray(rows[:, field.offset : field.offset + field.length])
                    texts = [c.decode(self.encoding) for c in cells.view(f"S{field.length}").ravel().tolist()]
                    text = pc.utf8_trim_whitespace(pa.array(texts, pa.string()))
                    text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
                    target = arrow[type(wanted.dataType)]
                    if pa.types.is_boolean(target):
                        upper = pc.utf8_upper(text)
                        known = pc.is_in(upper, pa.array(["T", "Y", "F", "N"]))
                        yes = pc.is_in(upper, pa.array(["T", "Y"]))
                        columns.append(pc.if_else(known, yes, pa.scalar(None, pa.bool_())))
                    elif pa.types.is_string(target):
                        columns.append(text)
                    else:
                        number = pc.match_substring_regex(text, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
                        clean = pc.if_else(number, text, pa.scalar(None, pa.string()))
                        whole = pc.cast(clean, pa.float64()) if pa.types.is_floating(target) else pc.cast(
                            pc.replace_substring_regex(clean, r"^\+|\..*$", ""), target
                        )
                        columns.append(whole)
                yield pa.record_batch(columns, names=self.schema.names)


class DbfSource(DataSource):
    """``spark.read.format("dbf").load(path)``; options ``recordsPerTask`` and ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> T.StructType:
        first = _expand(self.options["path"])[0]
        return T.StructType([T.StructField(f.name, f.spark_type) for f in read_layout(first).fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbfReader(schema, self.options)


def read_dbf(spark: SparkSession, path: str, schema: T.StructType | None = None, records_per_task: int | None = None) -> DataFrame:
    """S3: DBF file or folder; with a schema, only its columns are decoded."""
    spark.dataSource.register(DbfSource)
    reader = spark.read.format("dbf")
    if schema is not None:
        reader = reader.schema(schema)
    if records_per_task:
        reader = reader.option("recordsPerTask", records_per_task)
    return reader.load(path)
