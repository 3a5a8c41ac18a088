"""WARC archives as a PySpark Python data source named ``warc``.

Writing: each task writes gzip members, one per record, to a file of its own; the driver lists the files
of the tasks that succeeded in a manifest, so retried or speculative tasks leave nothing that is read. The
manifest also tells where records begin, which is where files are cut into partitions.

Reading: a record's head is inflated first and pushed filters are tested on it; the rest is jumped over by
the lengths in the member's extra field. Archives of other writers are read too: gzip files by ranges, whose
readers look for the first member that begins a record, and plain files, each as one partition in which
payloads are skipped by seeking. Members may hold any number of records, and heads may have any length. The
payload is decoded for wanted records only, and not at all with option ``payload=false``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .common import load, materialise, new_path, sieved

#: Payloads shorter than this are always stored whole.
MIN_REVISIT = 100
SPLIT_BYTES = 64 << 20
#: Bytes that are read and inflated at a time for a head, and for a payload.
HEAD, BODY = 4096, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_MANIFEST = "_manifest.json"
_FILTERABLE = ("record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


#: Bytes of a member written here before its deflate stream, and the name of the extra field that holds the member's length.
_START, _OWN = 12 + 12, b"St"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def member(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, first: int | None) -> bytes:
    """A record as a gzip member; ``first`` is the page that holds the payload if this is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if first is not None else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []), f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {_urn(first)}", f"WARC-Profile: {PROFILE}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = _OWN + struct.pack("<HQ", 8, _START + len(body) + 8)
    start = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return start + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class _Files(WriterCommitMessage):
    name: str
    size: int
    starts: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, size, starts = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(c) for c in ("page_id", "url", "payload_digest", "refers_to", "html")]
                for page_id, url, digest, first, html in zip(*columns, strict=True):
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    record = member(page_id.as_py(), url.as_py(), payload, len(payload), digest.as_py(), first.as_py())
                    out.write(record)
                    if not starts or size - starts[-1] >= SPLIT_BYTES:
                        starts.append(size)
                    size += len(record)
        return _Files(name, size, starts)

    def commit(self, messages):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = [[m.name, m.size, m.starts] for m in messages if m is not None and m.size]
        with fs.open_output_stream(f"{root}/{_MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int


class _Window:
    """Bytes of a file by position, read in large steps."""

    def __init__(self, f, size: int, step: int = 4 << 20):
        self.f, self.size, self.step, self.at, self.data = f, size, step, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.f.seek(pos)
            self.at, self.data = pos, self.f.read(max(n, min(self.step, self.size - pos)))
        return self.data[pos - self.at : pos - self.at + n]


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


class _Stream:
    """Bytes of a plain file from ``at`` on, as far as they are asked for."""

    def __init__(self, w: _Window, at: int):
        self.w, self.at, self.data = w, at, bytearray()

    def more(self, size: int) -> bool:
        part = self.w.get(self.at, min(size, self.w.size - self.at)) if self.at < self.w.size else b""
        self.at += len(part)
        self.data += part
        return bool(part)

    def until(self, mark: bytes, limit: int | None = None) -> bytes | None:
        """What stands before the mark, which is passed over; None if it isn't found within ``limit`` bytes."""
        look = 0
        while (i := self.data.find(mark, look, limit)) < 0:
            look = max(0, len(self.data) - len(mark) + 1)
            if limit is not None and len(self.data) >= limit or not self.more(HEAD):
                return None
        out = bytes(self.data[:i])
        del self.data[: i + len(mark)]
        return out

    def read(self, n: int) -> bytes:
        while len(self.data) < n and self.more(BODY):
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def skip(self, n: int) -> None:
        self.at += max(0, n - len(self.data))
        del self.data[:n]

    def another(self) -> bool:
        """Pass over line ends; whether anything follows."""
        while True:
            rest = self.data.lstrip(b"\r\n")
            if rest:
                self.data = rest
                return True
            self.data = bytearray()
            if not self.more(HEAD):
                return False


class _Member(_Stream):
    """Inflated bytes of the gzip member at ``at``."""

    def __init__(self, w: _Window, at: int):
        super().__init__(w, at)
        self.z = zlib.decompressobj(31)

    def more(self, size: int) -> bool:
        while not self.z.eof:
            part = self.z.unconsumed_tail
            if not part:
                part = self.w.get(self.at, min(HEAD, self.w.size - self.at)) if self.at < self.w.size else b""
                self.at += len(part)
                if not part:
                    raise ValueError("a gzip member that doesn't end")
            out = self.z.decompress(part, size)
            if out:
                self.data += out
                return True
        return False

    def skip(self, n: int) -> None:
        while n and (self.data or self.more(BODY)):
            m = min(n, len(self.data))
            del self.data[:m]
            n -= m

    def end(self) -> int:
        """Where the member ends in the file."""
        while self.more(BODY):
            self.data = bytearray()
        return self.at - len(self.z.unused_data)


def _parsed(stream: _Stream, wanted, with_payload: bool, alone: bool = False):
    """(head fields, payload or None, whether it is wanted) of each record of the stream, or of the first alone."""
    while stream.another():
        head = stream.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        left, http, kind = int(fields.get("content-length", 0)), b"", fields.get("warc-type")
        if fields.get("content-type", "").startswith("application/http"):
            http = stream.until(b"\r\n\r\n", left)
            left -= 0 if http is None else len(http) + 4
        stated = _fields(http or b"").get("content-length", "")
        record = {
            "page_id": _page(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page(fields.get("warc-refers-to")), "payload_digest": fields.get("warc-payload-digest", "").partition(":")[2] or None,
            "payload_bytes": int(stated) if stated.isdigit() else left if kind != "revisit" else None,
        }
        take = wanted(record)
        payload = None
        if take and with_payload and kind != "revisit":
            payload = stream.read(left)
        elif not alone:
            stream.skip(left)
        yield record, payload, take
        if alone:
            return


def records(f, size: int, start: int, end: int, wanted, with_payload: bool):
    """(head fields, payload or None) of the wanted records of a file.

    Of a gzip file, those whose member begins in [start, end); of a plain file, which is read from its
    beginning, all. The payload of a record is what stands behind its HTTP head, or its whole block.
    """
    w = _Window(f, size)
    if size and w.get(0, min(2, size)) != b"\x1f\x8b":
        for record, payload, take in _parsed(_Stream(w, 0), wanted, with_payload) if start == 0 else ():
            if take:
                yield record, payload
        return
    pos = _first(w, start, end)
    while pos is not None and pos < end:
        after = _next_member(w, pos)
        member_ = _Member(w, pos)
        for record, payload, take in _parsed(member_, wanted, with_payload, alone=after is not None):
            if take:
                yield record, payload
        pos = member_.end() if after is None else after
        if pos >= size:
            return


def _next_member(w: _Window, pos: int) -> int | None:
    """Where the member at ``pos``, which holds one record, ends by its own word; None if it must be inflated to tell.

    Only members written here are known to hold one record. The skip lengths of other writers (first half of
    their field) are the member's, too, but say nothing of how many records it holds, so such members are
    inflated; nothing is passed over unread.
    """
    head = w.get(pos, min(24, w.size - pos))
    if len(head) < 24 or not head[3] & 4 or head[10:16] != struct.pack("<H", 12) + _OWN + struct.pack("<H", 8):
        return None
    end = pos + struct.unpack("<Q", head[16:24])[0]
    return end if end == w.size or (pos + _START < end < w.size - 1 and w.get(end, 2) == b"\x1f\x8b") else None


def _first(w: _Window, start: int, end: int) -> int | None:
    """Position of the first member at or after start whose data begins a WARC record."""
    pos = start
    while pos < min(end, w.size):
        block = w.get(pos, min(1 << 16, w.size - pos))
        i = block.find(b"\x1f\x8b\x08")
        if i < 0:
            pos += max(1, len(block) - 2)
            continue
        try:
            if zlib.decompressobj(31).decompress(w.get(pos + i, min(512, w.size - pos - i)), 5) == b"WARC/":
                return pos + i
        except zlib.error:
            pass
        pos += i + 1
    return None


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split: int):
        self.path, self.payload, self.split, self.tests = path, payload, split, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _FILTERABLE and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in _FILTERABLE and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in _FILTERABLE and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path)
        info = fs.get_file_info(f"{root}/{_MANIFEST}")
        if info.type == pafs.FileType.File:
            out = []
            for name, size, starts in json.loads(fs.open_input_stream(info.path).read()):
                out += [_Range(name, a, b) for a, b in zip(starts, [*starts[1:], size])]
            return out or [_Range("", 0, 0)]
        out = []  # archives of another writer
        for x in fs.get_file_info(pafs.FileSelector(root)):
            if x.base_name.endswith(".warc.gz"):
                out += [_Range(x.base_name, at, min(x.size, at + self.split)) for at in range(0, x.size, self.split)]
            elif x.base_name.endswith(".warc"):
                out.append(_Range(x.base_name, 0, x.size))
        return out or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        tests, names = self.tests, [c.split()[0] for c in SCHEMA.split(", ")]
        wanted = lambda r: all(r[k] is not None if v is None else r[k] in v for k, v in tests)
        fs, root = file_system(self.path)
        kinds = {"payload": pa.binary(), "target_uri": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}
        schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])
        rows, held = [], 0
        with fs.open_input_file(f"{root}/{partition.name}") as f:
            for record, payload in records(f, f.size(), partition.start, partition.end, wanted, self.payload):
                rows.append({**record, "payload": payload})
                held += 200 + len(payload or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Archive ``page_id, url, html`` rows: one record a row, later copies of a payload as revisits.

    Of equal payloads of at least ``min_revisit`` bytes the row with the smallest page_id is the response;
    rows that repeat this page_id are responses too, null page_ids rank last. Null html is empty. Other
    columns are ignored; an empty table gives an archive without records. Digests are grouped, not
    payloads; only pages that pass a sieve for digests that occur twice are shuffled.
    """
    register(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest")).withColumn("h", F.xxhash64("payload_digest"))
    firsts = (
        rows.filter(F.octet_length("html") >= min_revisit).groupBy("payload_digest", "h")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    )
    firsts = materialise(firsts, "repeated-payloads")
    later = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    joined = sieved(rows, "h", firsts.select("h")).join(firsts.select("payload_digest", "first"), "payload_digest", "left")
    joined = joined.unionByName(sieved(rows, "h", firsts.select("h"), hit=False).withColumn("first", F.lit(None).cast("long")))
    joined = joined.select("page_id", "url", "payload_digest", later.cast("long").alias("refers_to"), "html")
    joined.write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder; ``payload`` is null for revisits, and for all with payload=False.

    ``page_id`` and ``refers_to`` are the numbers at the end of the record ids, null where there are none.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def _measured(batches):
    """Length and digest of what was read; a revisit states those of the payload it refers to."""
    for b in batches:
        n, d = b.column("payload_bytes").to_pylist(), b.column("payload_digest").to_pylist()
        for i, p in enumerate(b.column("payload")):
            if p.is_valid:
                v = p.as_py()
                n[i], d[i] = len(v), hashlib.sha256(v).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), pa.array(n, pa.int64()), pa.array(d, pa.string()), b.column("record_type"), b.column("refers_to")],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )


def op1_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).mapInArrow(_measured, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f
"""
