"""Zip archives: ranges of entries, awkward entries, archives of any size."""

import io
import struct
import zipfile
from collections import Counter

import pytest
from pyarrow import fs as pafs

from strophe.sources import archive
from strophe.sources.archive import ZipReader, read_archive, write_archives


def test_many_entries_are_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(10_000):
            z.writestr(f"d{i % 7}/{i}.{'ttml' if i % 2 else 'TTML'}", f"text {i} é " * (1 + i % 5))
        z.writestr("other.txt", "x")
    df = read_archive(spark, path)
    archive_parts = ZipReader(path, ".ttml")
    assert len(archive_parts.partitions()) == 1
    rows = {r["filename"]: r["content"] for r in df.collect()}
    assert len(rows) == 10_000 and all(rows[f"d{i % 7}/{i}.{'ttml' if i % 2 else 'TTML'}"] == f"text {i} é " * (1 + i % 5) for i in range(0, 10_000, 333))


def test_ranges(spark, tmp_path, monkeypatch):
    """Each entry is in one range; a task reads its own entries only."""
    monkeypatch.setattr(archive, "PART_ENTRIES", 900)
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(10_000):
            z.writestr(f"{i}.ttml", f"text {i}")
    df = read_archive(spark, path)
    assert df.rdd.getNumPartitions() == 12 and Counter(df.selectExpr("count(*) as n", "count(distinct filename) as m", "min(content) as c").first().asDict()) == {"n": 10_000, "m": 10_000, "c": "text 0"}
    reader = ZipReader(path, ".ttml")
    parts = reader.partitions()
    places = [e[1] for p in parts for e in p.entries]
    assert places == sorted(places) and len(places) == 10_000
    monkeypatch.setattr(archive.zipfile, "ZipFile", None)  # tasks don't read the directory
    assert sum(b.num_rows for b in reader.read(parts[3])) == 900


def test_awkward_entries(spark, tmp_path):
    """Damaged, encrypted, oddly packed and non-UTF-8 entries are left out; others, of every known packing, are read."""
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored.ttml", "plain", zipfile.ZIP_STORED)
        z.writestr("deflated.ttml", "deflated " * 99, zipfile.ZIP_DEFLATED)
        z.writestr("bzip.ttml", "bzip " * 99, zipfile.ZIP_BZIP2)
        z.writestr("lzma.ttml", "lzma " * 99, zipfile.ZIP_LZMA)
        z.writestr("bytes.ttml", b"\xff\xfe")
        z.writestr("empty.ttml", "")
        z.writestr("damaged.ttml", "to be damaged " * 50, zipfile.ZIP_DEFLATED)
        z.writestr("wrong.ttml", "wrong checksum", zipfile.ZIP_STORED)
        z.writestr("secret.ttml", "secret")
        z.writestr("ünï.ttml", "name")
        z.writestr("twice.ttml", "one")
        z.mkdir("dir.ttml")
        at = {i.filename: i.header_offset for i in z.infolist()}
    with pytest.warns(UserWarning), zipfile.ZipFile(path, "a") as z:
        z.writestr("twice.ttml", "two")
    data = bytearray(path.read_bytes())
    data[at["damaged.ttml"] + 60] ^= 0xFF
    data[data.index(b"wrong checksum", at["wrong.ttml"])] ^= 1
    for i in range(len(data) - 46):  # the flag of an encrypted entry, in the directory
        if data[i : i + 4] == b"PK\x01\x02" and data[i + 46 : i + 57] == b"secret.ttml":
            struct.pack_into("<H", data, i + 8, 1)
    path.write_bytes(bytes(data))
    got = Counter((r["filename"], r["content"]) for r in read_archive(spark, str(path)).collect())
    want = {"stored.ttml": "plain", "deflated.ttml": "deflated " * 99, "bzip.ttml": "bzip " * 99, "empty.ttml": "", "ünï.ttml": "name"}
    assert got == Counter([*want.items(), ("twice.ttml", "one"), ("twice.ttml", "two")])


def test_folders_and_sink(spark, tmp_path):
    rows = [(f"{i}.ttml", None if i % 10 == 3 else f"text {i}") for i in range(50)]
    paths = write_archives(spark.createDataFrame(rows, archive.SCHEMA).repartition(3), str(tmp_path / "z"))
    (tmp_path / "z/note.txt").write_text("x")
    assert len(paths) == 3 and Counter(tuple(r) for r in read_archive(spark, str(tmp_path / "z")).collect()) == Counter(r for r in rows if r[1] is not None)
    assert sum(read_archive(spark, p).count() for p in paths) == 45
    assert write_archives(spark.createDataFrame([], archive.SCHEMA), str(tmp_path / "none")) == []
    (tmp_path / "e").mkdir()
    assert read_archive(spark, str(tmp_path / "e")).collect() == []
    (tmp_path / "e/bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a zip file"):
        read_archive(spark, str(tmp_path / "e")).collect()


def test_archives_of_a_few_bytes(spark, tmp_path):
    """An archive without entries ends before places that are looked at in larger ones; partitions without contents leave none."""
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/none.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "z/one.zip", "w") as z:
        z.writestr("a.ttml", "a")
    assert [tuple(r) for r in read_archive(spark, str(tmp_path / "z")).collect()] == [("a.ttml", "a")]
    assert read_archive(spark, str(tmp_path / "z/none.zip")).collect() == []
    rows = spark.createDataFrame([("b.ttml", "b"), ("c.ttml", None)], archive.SCHEMA).repartition(1).union(spark.createDataFrame([], archive.SCHEMA))
    paths = write_archives(rows, str(tmp_path / "w"))
    assert [str(p) for p in (tmp_path / "w").iterdir()] == paths and len(paths) == 1
    write_archives(rows, str(tmp_path / "w"))  # as by a task that ran twice: only the paths that were returned count
    assert [tuple(r) for r in read_archive(spark, paths).collect()] == [("b.ttml", "b")]
    assert read_archive(spark, []).collect() == []


class Sparse(io.RawIOBase):
    """A file of which only some stretches are not zero."""

    def __init__(self, size, stretches):
        self.size, self.stretches, self.at = size, stretches, 0

    def seekable(self):
        return True

    def readable(self):
        return True

    def seek(self, to, whence=0):
        self.at = to + (0, self.at, self.size)[whence]
        return self.at

    def tell(self):
        return self.at

    def read(self, n=-1):
        n = min(self.size - self.at if n < 0 else n, self.size - self.at)
        out = bytearray(n)
        for begin, data in self.stretches:
            lo, hi = max(begin, self.at), min(begin + len(data), self.at + n)
            if lo < hi:
                out[lo - self.at : hi - self.at] = data[lo - begin : hi - begin]
        self.at += n
        return bytes(out)


@pytest.mark.parametrize("gap", [3 << 30, 6 << 30])
def test_beyond_32_bits(tmp_path, monkeypatch, gap):
    """Entries behind places of more than 31 and 32 bits."""
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(30):
            z.writestr(f"{i}.ttml", f"text {i} " * 20)
    data = small.getvalue()
    f = Sparse(gap + len(data), [(gap, data)])  # the directory counts places from where the archive begins

    class Fs:
        def get_file_info(self, p):
            return type("I", (), {"type": pafs.FileType.File})

        def open_input_file(self, p):
            return Sparse(f.size, f.stretches)

    monkeypatch.setattr(archive, "file_system", lambda p: (Fs(), p))
    reader = ZipReader("big.zip", ".ttml")
    parts = reader.partitions()
    assert min(e[1] for p in parts for e in p.entries) >= gap
    assert [t for p in parts for b in reader.read(p) for t in b.column("content").to_pylist()] == [f"text {i} " * 20 for i in range(30)]
