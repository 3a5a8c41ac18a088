"""Zip archives as a PySpark Python data source named ``ziptext``, and a sink for them.

Planning reads an archive's central directory, which stands at its end and holds no content, and deals the wanted
entries out by their compressed size; a task seeks to its own entries, so one archive is read by many tasks and none
holds more than an entry and a batch. Places are 64-bit numbers, for archives of any size. An entry that is damaged,
encrypted, packed in an unknown way or not UTF-8 is left out; an archive whose directory can't be read is an error.
"""

from __future__ import annotations

import bz2
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "filename string, content string"
#: Compressed bytes and entries of a partition, and bytes of content in a batch.
PART_BYTES, PART_ENTRIES, BATCH_BYTES = 8 << 20, 20_000, 4 << 20
_LOCAL, _HEAD = "<4s5H3L2H", 30  # the head before an entry, and its bytes


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Entries(InputPartition):
    """Entries of an archive in the file system of ``source``: (name, place, compressed bytes, method, checksum) each."""

    source: str
    path: str
    entries: list


class _Directory:
    """A file whose seeks to places before its beginning are OSErrors, which ``zipfile`` expects of archives of a few bytes."""

    def __init__(self, f):
        self.f = f

    def __getattr__(self, name):
        return getattr(self.f, name)

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.f.seek(to, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def content_of(f, place: int, size: int, method: int, crc: int) -> str | None:
    """The text of the entry at a place of a file, or None if it can't be had."""
    try:
        f.seek(place)
        head = struct.unpack(_LOCAL, f.read(_HEAD))
        if head[0] != b"PK\x03\x04":
            return None
        f.seek(place + _HEAD + head[9] + head[10])
        raw = f.read(size)
        if method == zipfile.ZIP_DEFLATED:
            raw = zlib.decompress(raw, -15)
        elif method == zipfile.ZIP_BZIP2:
            raw = bz2.decompress(raw)
        elif method != zipfile.ZIP_STORED:
            return None
        return raw.decode("utf-8") if zlib.crc32(raw) == crc else None
    except (struct.error, zlib.error, UnicodeDecodeError, OSError, ValueError):
        return None


class ZipReader(DataSourceReader):
    def __init__(self, path: str | Sequence[str], suffix: str):
        self.paths, self.suffix = [path] if isinstance(path, str) else list(path), suffix.lower()

    def _archives(self) -> list[tuple[str, str]]:
        out = []
        for source in self.paths:
            fs, root = file_system(source)
            if fs.get_file_info(root).type == pafs.FileType.Directory:
                out += [(source, p) for p in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.lower().endswith(".zip"))]
            else:
                out.append((source, root))
        return out

    def partitions(self):
        out = []
        for source, path in self._archives():
            with file_system(source)[0].open_input_file(path) as f, zipfile.ZipFile(_Directory(f)) as z:
                found = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(self.suffix) and not i.flag_bits & 1]
            part, held = [], 0
            for i in sorted(found, key=lambda i: i.header_offset):
                if part and (held + i.compress_size > PART_BYTES or len(part) >= PART_ENTRIES):
                    out.append(_Entries(source, path, part))
                    part, held = [], 0
                part.append((i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC))
                held += i.compress_size
            if part:
                out.append(_Entries(source, path, part))
        return out or [_Entries("", "", [])]

    def read(self, partition):
        if not partition.entries:
            return
        fs, _ = file_system(partition.source)
        names, texts, held = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["filename", "content"])

        with fs.open_input_file(partition.path) as f:
            for name, *at in partition.entries:
                text = content_of(f, *at)
                if text is None:
                    continue
                names.append(name)
                texts.append(text)
                held += len(text)
                if held > BATCH_BYTES:
                    yield batch()
                    names, texts, held = [], [], 0
        if names:
            yield batch()


class ZipSource(DataSource):
    """Options: ``suffix``, the end of the names that are wanted in any case (all by default); ``archives``, a JSON array of paths instead of one."""

    @classmethod
    def name(cls):
        return "ziptext"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        archives = self.options.get("archives")
        return ZipReader(self.options["path"] if archives is None else json.loads(archives), self.options.get("suffix", ""))


def read_archive(spark: SparkSession, path: str | Sequence[str], suffix: str = ".ttml") -> DataFrame:
    """``filename, content`` of the entries whose names end in ``suffix``: of an archive, of the ``.zip`` archives of a folder, or of several such."""
    spark.dataSource.register(ZipSource)
    source = spark.read.format("ziptext").option("suffix", suffix)
    return source.load(path) if isinstance(path, str) else source.option("archives", json.dumps(list(path))).load()


def write_archives(rows: DataFrame, folder: str) -> list[str]:
    """Write ``filename, content`` rows as archives, one a partition that has contents, and return their paths; null contents are left out.

    A task's archive has a name of its own and counts once the task has succeeded, so what a lost or repeated task
    leaves is not among the paths.
    """

    def run(batches):
        fs, root = file_system(folder)
        rows = ((n, c.as_py()) for b in batches for n, c in zip(b.column("filename").to_pylist(), b.column("content"), strict=True) if c.is_valid)
        first, name = next(rows, None), f"{uuid.uuid4().hex}.zip"
        if first is not None:
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(*first)
                for row in rows:
                    z.writestr(*row)
        yield pa.RecordBatch.from_arrays([pa.array([] if first is None else [f"{folder.rstrip('/')}/{name}"], pa.string())], names=["path"])

    return [r["path"] for r in rows.select("filename", "content").mapInArrow(run, "path string").collect()]
