"""OpenStreetMap PBF files as a Spark data source: ``spark.read.format("osm_pbf").option("entity", "ways").load(path)``.

The driver walks the file's block headers (a few bytes each), checks the file header and deals byte ranges of blocks to
partitions; each task reads, inflates and decodes its own blocks. Files are opened through Arrow's file systems, so paths may
be local, hdfs://, s3:// or gs://. Entities are ``nodes``, ``ways`` and ``relations``; positions are fixed point, 1e-7 degrees.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the file format: size limits, field numbers (beside their uses), features that a reader must know.
MAX_HEADER, MAX_BLOB = 64 * 1024, 32 * 1024 * 1024
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
SCHEMAS = {
    "nodes": "node_id bigint, lat bigint, lng bigint, tags map<string,string>",
    "ways": "way_id bigint, nodes array<bigint>, tags map<string,string>",
    "relations": "relation_id bigint, members array<struct<type:int,id:bigint,role:string>>, tags map<string,string>",
}
#: Bytes of blocks that a partition holds, about.
PARTITION_BYTES = 64 * 1024 * 1024


class FormatError(ValueError):
    """The file is not one that can be read."""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: whole numbers unsigned, everything else as bytes."""
    at, end = 0, len(data)

    def whole() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= end or shift > 63:
                raise FormatError("a number is cut off")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value & 0xFFFFFFFFFFFFFFFF
            shift += 7

    while at < end:
        key = whole()
        kind = key & 7
        if kind == 0:
            yield key >> 3, whole()
            continue
        size = {1: 8, 5: 4}.get(kind, -1) if kind != 2 else whole()
        if size < 0 or at + size > end:
            raise FormatError("a field is cut off or of an unknown kind")
        yield key >> 3, data[at : at + size]
        at += size


def packed(data: bytes) -> np.ndarray:
    """The whole numbers of a packed field, as unsigned 64-bit ones."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise FormatError("a number is cut off")
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise FormatError("a number is too long")
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zigzag numbers as signed ones."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _sint(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _int64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Block(InputPartition):
    """Byte ranges of the bodies of some blocks."""

    ranges: list[tuple[int, int]]


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def blocks(source) -> Iterator[tuple[str, int, int]]:
    """(type, place, size) of each block's body in an open file."""
    at, total = 0, source.size()
    while at < total:
        source.seek(at)
        raw = source.read(4)
        if len(raw) < 4:
            raise FormatError("the file ends in a header's length")
        (size,) = struct.unpack(">i", raw)
        if not 0 < size <= MAX_HEADER:
            raise FormatError("a block header is too long")
        head = source.read(size)
        if len(head) < size:
            raise FormatError("the file ends in a block header")
        kind, body = "", -1
        for number, value in fields(head):
            if number == 1:
                kind = value.decode()
            elif number == 3:
                body = value
        if not 0 <= body <= MAX_BLOB:
            raise FormatError("a block is too long")
        at += 4 + size
        if at + body > total:
            raise FormatError("the file ends in a block")
        yield kind, at, body
        at += body


def inflated(blob: bytes) -> bytes:
    """The content of a block's body: as it is, or inflated."""
    raw = size = packed_data = None
    for number, value in fields(blob):
        if number == 1:
            raw = value
        elif number == 2:
            size = value
        elif number == 3:
            packed_data = value
        elif number in (4, 5, 6, 7):
            raise FormatError("the block's compression is not supported")
    if raw is not None:
        return raw
    if packed_data is None:
        raise FormatError("a block without content")
    if size is None:
        raise FormatError("a compressed block without its size")
    out = zlib.decompress(packed_data)
    if len(out) != size:
        raise FormatError("a block's size is wrong")
    return out


def check_header(data: bytes) -> None:
    """Raises for a file header that requires what this reader doesn't know."""
    required = {value.decode() for number, value in fields(data) if number == 4}
    if required - FEATURES:
        raise FormatError(f"unknown required features: {', '.join(sorted(required - FEATURES))}")


class Decoder:
    """One block's strings, granularity, offsets and groups."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[bytes] = []
        self.granularity, self.lat_offset, self.lng_offset = 100, 0, 0
        for number, value in fields(data):
            if number == 1:
                self.strings = [s.decode("utf-8", "replace") for k, s in fields(value) if k == 1]
            elif number == 2:
                self.groups.append(value)
            elif number == 17:
                self.granularity = value
            elif number == 19:
                self.lat_offset = _int64(value)
            elif number == 20:
                self.lng_offset = _int64(value)

    def rows(self, entity: str) -> Iterator[tuple]:
        wanted = {"nodes": {1: self.node, 2: self.dense}, "ways": {3: self.way}, "relations": {4: self.relation}}[entity]
        for group in self.groups:
            parts = [(number, value) for number, value in fields(group) if number in wanted]
            for number in sorted({n for n, _ in parts}):
                for k, value in parts:
                    if k == number:
                        yield from wanted[number](value)

    def fixed(self, raw, offset: int):
        """Fixed point of raw coordinates, which are in nanodegrees after granularity and offset; halves go up."""
        return (offset + self.granularity * raw + 50) // 100

    def tags(self, keys: bytes, values: bytes) -> list[tuple[str, str]]:
        return list({self.strings[int(k)]: self.strings[int(v)] for k, v in zip(packed(keys), packed(values), strict=False)}.items())

    def node(self, data: bytes) -> Iterator[tuple]:
        got = dict(fields(data))
        yield _sint(got.get(1, 0)), self.fixed(_sint(got.get(8, 0)), self.lat_offset), self.fixed(_sint(got.get(9, 0)), self.lng_offset), self.tags(got.get(2, b""), got.get(3, b""))

    def dense(self, data: bytes) -> Iterator[tuple]:
        got = dict(fields(data))
        ids, lats, lngs = (np.cumsum(signed(packed(got.get(k, b"")))) for k in (1, 8, 9))
        if not len(ids) == len(lats) == len(lngs):
            raise FormatError("dense nodes with columns of different lengths")
        words = packed(got.get(10, b"")).astype(np.int64).tolist()
        at = 0
        for i, lat, lng in zip(ids.tolist(), self.fixed(lats, self.lat_offset).tolist(), self.fixed(lngs, self.lng_offset).tolist(), strict=True):
            tags = {}
            while at < len(words) and words[at]:
                if at + 1 >= len(words):
                    raise FormatError("a tag without a value")
                tags[self.strings[words[at]]] = self.strings[words[at + 1]]
                at += 2
            at += 1  # what is left when the tags run out is untagged
            yield i, lat, lng, list(tags.items())

    def way(self, data: bytes) -> Iterator[tuple]:
        got = dict(fields(data))
        yield _int64(got.get(1, 0)), np.cumsum(signed(packed(got.get(8, b"")))).tolist(), self.tags(got.get(2, b""), got.get(3, b""))

    def relation(self, data: bytes) -> Iterator[tuple]:
        got = dict(fields(data))
        ids, kinds, roles = np.cumsum(signed(packed(got.get(9, b"")))).tolist(), packed(got.get(10, b"")).tolist(), packed(got.get(8, b"")).tolist()
        yield _int64(got.get(1, 0)), [{"type": int(t), "id": i, "role": self.strings[int(r)]} for t, i, r in zip(kinds, ids, roles, strict=True)], self.tags(got.get(2, b""), got.get(3, b""))


class Reader(DataSourceReader):
    def __init__(self, path: str, entity: str, arrow: pa.Schema):
        self.path, self.entity, self.arrow = path, entity, arrow

    def partitions(self) -> list[Block]:
        """Byte ranges of data blocks; the header and the order of blocks are checked here, once."""
        out: list[Block] = []
        held = PARTITION_BYTES
        with _opened(self.path) as source:
            for k, (kind, at, size) in enumerate(list(blocks(source))):
                if kind not in ("OSMHeader", "OSMData"):
                    raise FormatError(f"unknown block: {kind}")
                if (k == 0) != (kind == "OSMHeader"):
                    raise FormatError("the file must begin with its header" if k == 0 else "a second file header")
                if k == 0:
                    source.seek(at)
                    check_header(inflated(source.read(size)))
                    continue
                if held >= PARTITION_BYTES:
                    out.append(Block([]))
                    held = 0
                out[-1].ranges.append((at, size))
                held += size
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        """A batch for each block, so that a task holds one block at a time."""
        if partition is None:
            return
        with _opened(self.path) as source:
            for at, size in partition.ranges:
                source.seek(at)
                rows = list(Decoder(inflated(source.read(size))).rows(self.entity))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(self.arrow)], schema=self.arrow)


TAGS = pa.map_(pa.string(), pa.string())
ARROW = {
    "nodes": pa.schema([("node_id", pa.int64()), ("lat", pa.int64()), ("lng", pa.int64()), ("tags", TAGS)]),
    "ways": pa.schema([("way_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("tags", TAGS)]),
    "relations": pa.schema([("relation_id", pa.int64()), ("members", pa.list_(pa.struct([("type", pa.int32()), ("id", pa.int64()), ("role", pa.string())]))), ("tags", TAGS)]),
}


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _entity(self) -> str:
        entity = self.options.get("entity", "ways")
        if entity not in SCHEMAS:
            raise ValueError(f"entity must be one of {', '.join(SCHEMAS)}")
        return entity

    def schema(self) -> str:
        return SCHEMAS[self._entity()]

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._entity(), ARROW[self._entity()])


def read(spark: SparkSession, path: str, entity: str = "ways") -> DataFrame:
    """The nodes, ways or relations of a file."""
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osm_pbf").option("entity", entity).load(path)
