"""Zip archives as a data source: many tasks read one archive, each its own members by range.

Planning reads the central directories, and deals members to partitions of about
`bytes` compressed bytes; a task then seeks to its members' headers and inflates
them as a stream, so neither an archive nor a member is ever held whole.  A
member's checksum and size are verified when its rows have been read.

Archives must be in a store that pyarrow.fs reaches (local folders that all
machines share, object stores, HDFS); read_zipped() has another way for the rest.
Edge cases: folders and empty members have no rows; a member with only a header
has none; encrypted members and methods but stored and deflate raise; fields
missing at a row's end are null.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def opened(path: str):
    """A file that can be sought in, by path or URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Member:
    archive: str
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int


@dataclass
class Members(InputPartition):
    members: tuple[Member, ...]


def members_of(archive: str) -> list[Member]:
    """What the central directory lists, without folders and empty files."""
    with opened(archive) as file, zipfile.ZipFile(file) as z:
        found = []
        for i in z.infolist():
            if i.is_dir() or not i.file_size:
                continue
            if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{archive}: {i.filename} is encrypted or packed by method {i.compress_type}")
            found.append(Member(archive, i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type))
        return found


def dealt(members: list[Member], most: int) -> list[Members]:
    """Members in order, in partitions of at most `most` compressed bytes, or of one member."""
    out: list[Members] = []
    part: list[Member] = []
    held = 0
    for m in sorted(members, key=lambda m: (m.archive, m.offset)):
        if part and (held + m.packed > most or m.archive != part[0].archive):
            out.append(Members(tuple(part)))
            part, held = [], 0
        part.append(m)
        held += m.packed
    return [*out, Members(tuple(part))] if part else out


class Unpacked(io.RawIOBase):
    """The bytes of a member, inflated as they are read."""

    def __init__(self, file, member: Member, step: int = 1 << 18):
        self.file, self.member, self.step = file, member, step
        file.seek(member.offset)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{member.archive}: no member begins at {member.offset}")
        name, extra = struct.unpack("<HH", head[26:30])
        file.seek(member.offset + 30 + name + extra)
        self.left, self.ready, self.crc, self.size = member.packed, b"", 0, 0
        self.inflate = zlib.decompressobj(-15) if member.method == zipfile.ZIP_DEFLATED else None

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready:
            if self.inflate and self.inflate.unconsumed_tail:
                self.ready = self.inflate.decompress(self.inflate.unconsumed_tail, self.step)
            elif self.left:
                raw = self.file.read(min(self.step, self.left))
                if not raw:
                    raise ValueError(f"{self.member.archive}: {self.member.name} ends early")
                self.left -= len(raw)
                self.ready = self.inflate.decompress(raw, self.step) if self.inflate else raw
            else:
                if (self.crc, self.size) != (self.member.crc, self.member.size):
                    raise ValueError(f"{self.member.archive}: {self.member.name} doesn't match its checksum")
                return 0
        n = min(len(target), len(self.ready))
        target[:n] = self.ready[:n]
        self.crc, self.size = zlib.crc32(self.ready[:n], self.crc), self.size + n
        self.ready = self.ready[n:]
        return n


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.sep = schema.names, options.get("sep", ",")
        self.archives, self.most = json.loads(options["archives"]), int(options.get("bytes", 16 << 20))

    def partitions(self) -> list[Members]:
        return dealt([m for a in self.archives for m in members_of(a)], self.most)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with opened(partition.members[0].archive) as file:
            for member in partition.members:
                text = io.BufferedReader(Unpacked(file, member), 1 << 18)
                for part in pd.read_csv(text, sep=self.sep, dtype=str, header=0, names=self.names, index_col=False, keep_default_na=False, chunksize=20_000):
                    columns = [pa.array([x if isinstance(x, str) else None for x in part[n]], pa.string()) for n in self.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                if text.read(1):  # to its end, where the checksum is held against it
                    raise ValueError(f"{member.archive}: {member.name} has bytes behind its rows")


class Archives(DataSource):
    """Rows of the CSV members of zip archives as text columns; option archives: a JSON list of their paths."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)
