import gzip
import hashlib
import io
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strophe.llm import warc
from strophe.llm.warc import OP1_SQL, member, op1_warc, read_warc, records, write_warc

BIG = "<html>" + "lorem ipsum " * 30 + "</html>"
PAGES = [
    (1, "http://a/ 1", BIG), (2, None, BIG), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, "u", None), (6, "ü", ""), (7, "x", "é" * 200), (0, "x", "é" * 200),
    (8, "x", "a\r\n\r\nb" * 40), (None, "n", BIG), (None, None, None), (9, "long", "日 0123" * 50_000), (1, "again", BIG), (10, "x", "é" * 50), (11, "x", "é" * 50), (12, "x", "é" * 49),
]
SCHEMA = "page_id long, url string, html string, payload_digest string, refers_to long, first long, n int"


def table(spark, pages=PAGES):
    return spark.createDataFrame([(*p, "x", 1, 2, 3) for p in pages], SCHEMA).repartition(3)


def brute(pages):
    out = Counter()
    for i, _, h in pages:
        p = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        later = len(p) >= 100 and first is not None and i != first
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if later else "response", first if later else None] += 1
    return out


@pytest.fixture
def archive(spark, tmp_path):
    write_warc(table(spark), str(tmp_path / "w"))
    return str(tmp_path / "w")


def test_round_trip(spark, archive):
    got = read_warc(spark, archive).collect()
    assert Counter(tuple(r)[i] for r in got for i in [0]) == Counter(p[0] for p in PAGES)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute(PAGES)
    texts = {(i, h or "") for i, _, h in PAGES}
    for r in got:
        if r["record_type"] == "response":
            assert (r["page_id"], r["payload"].decode()) in texts and hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None


@pytest.mark.parametrize("split", [1, 97, 700, 1 << 20])
def test_ranges_see_each_record_once(spark, tmp_path, monkeypatch, split):
    """Cut at the writer's marks, and, without its manifest, wherever the reader likes."""
    monkeypatch.setattr(warc, "SPLIT_BYTES", split)
    path = tmp_path / "w"
    write_warc(table(spark), str(path))
    assert read_warc(spark, str(path), payload=False).count() == len(PAGES)
    (path / "_manifest.json").unlink()
    for f in path.glob("*.crc"):
        f.unlink()
    assert spark.read.format("warc").option("splitBytes", max(split, 50)).load(str(path)).count() == len(PAGES)


def test_pushdown_skips_payloads(spark, archive):
    df = read_warc(spark, archive).filter((F.col("record_type") == "revisit") & F.col("page_id").isin(2, 7, 8))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter(" not in plan and {r["page_id"] for r in df.collect()} == {2, 7}
    assert read_warc(spark, archive, payload=False).filter("payload is not null").count() == 0


def test_unwanted_records_are_not_inflated(monkeypatch):
    big = [member(i, "u", b"x" * 5_000_000, 5_000_000, "d", None) for i in range(3)]
    data, inflated = b"".join(big), []
    real = warc.zlib.decompressobj

    class Counting:
        def __init__(self, *a):
            self.z = real(*a)

        def decompress(self, *a):
            out = self.z.decompress(*a)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.z, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    got = list(records(io.BytesIO(data), len(data), 0, len(data), lambda r: r["page_id"] == 1, True))
    assert [len(p) for _, p in got] == [5_000_000] and sum(inflated) < 5_100_000


def test_members_of_other_writers():
    ours = [member(i, "u", f"page {i}".encode(), 6, "d", None) for i in range(5)]
    data = b"".join(gzip.compress(gzip.decompress(m)) for m in ours)
    assert all(m[3] == 4 for m in ours) and [p for _, p in records(io.BytesIO(data), len(data), 0, len(data), lambda r: True, True)] == [f"page {i}".encode() for i in range(5)]


def test_only_files_of_the_manifest_are_read(spark, archive, tmp_path):
    (tmp_path / "w/part-stray.warc.gz").write_bytes(member(99, "u", b"stray", 5, "d", None))
    assert read_warc(spark, archive).filter("page_id = 99").count() == 0


def test_query_and_sql(spark, tmp_path):
    import duckdb

    pages = [p for p in PAGES if p[0] is not None and p != (1, "again", BIG)]
    table(spark, pages).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in op1_warc(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == Counter(con.execute(OP1_SQL).fetchall()) == brute(pages)


def test_empty(spark, tmp_path):
    write_warc(table(spark).limit(0), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).collect() == []


def record(kind, block, content="application/http; msgtype=response", number=1):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{number}>\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


FOREIGN = [
    (record("warcinfo", b"software: x\r\n\r\n", "application/warc-fields"), b"software: x\r\n\r\n"),
    (record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nWARC/1.0 more"), b"body\r\n\r\nWARC/1.0 more"),
    (record("request", b"GET / HTTP/1.1\r\n\r\n"), b""), (record("response", b"HTTP/1.1 200 OK"), b"HTTP/1.1 200 OK"),
    (record("resource", b"plain\r\n\r\nblock", "text/plain"), b"plain\r\n\r\nblock"), (record("conversion", b"", "text/plain"), b""),
    (record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"), None), (record("metadata", b"x" * 600_000, "text/plain"), b"x" * 600_000),
]


def with_extra(data, extra):
    """A gzip member with the fields in its head."""
    return data[:3] + b"\x04" + data[4:10] + struct.pack("<H", len(extra)) + extra + data[10:]


def skip_lengths(raw, two=True, wrong=0):
    """A member with the field of skip lengths: of the compressed and the plain member in 32 bits each, or one in 64 bits."""
    data = gzip.compress(raw)
    size = len(data) + 14 + wrong
    return with_extra(data, b"sl" + struct.pack("<H", 8) + (struct.pack("<II", size, len(raw)) if two else struct.pack("<Q", size)))


@pytest.mark.parametrize("split", [120, 5000, 1 << 20])
@pytest.mark.parametrize("form", ["two", "one", "wrong", "other", "mixed", "groups"])
def test_extra_fields_of_other_writers(form, split):
    """Whatever the extra fields say, each record comes back once, in any split."""
    raw = [record("resource", (b"block %d " % i) * (1 + 200 * (i % 3)), "a/b", i) for i in range(20)]
    make = {
        "two": skip_lengths, "one": lambda r: skip_lengths(r, False), "wrong": lambda r: skip_lengths(r, wrong=-7), "groups": skip_lengths,
        "other": lambda r: with_extra(gzip.compress(r), b"XX\x02\0abSt\x08\0" + b"\xff" * 8), "mixed": lambda r: skip_lengths(r, len(r) % 2 == 0) if len(r) % 3 else gzip.compress(r),
    }[form]
    parts = [b"".join(raw[i : i + 4]) for i in range(0, 20, 4)] if form == "groups" else raw
    data = b"".join(map(make, parts)) + (member(77, "u", b"ours", 4, "d", None) if form == "mixed" else b"")
    got = [r["page_id"] for at in range(0, len(data), split) for r, _ in records(io.BytesIO(data), len(data), at, min(len(data), at + split), lambda r: True, True)]
    assert got == [*range(20), *([77] if form == "mixed" else [])]


def test_a_wrong_length_of_our_own_field():
    """A length that doesn't lead to a member is not believed."""
    bad = bytearray(member(1, "u", b"one", 3, "d", None))
    bad[16:24] = struct.pack("<Q", 40)
    data = bytes(bad) + member(2, "u", b"two", 3, "d", None)
    assert [r["page_id"] for r, _ in records(io.BytesIO(data), len(data), 0, len(data), lambda r: True, True)] == [1, 2]


def test_payload_of_64_mib(spark, tmp_path):
    """A payload of 64 MiB goes through Spark and comes back whole."""
    text = "0123456789abcdef" * (4 << 20)
    write_warc(table(spark, [(1, "u", text), (2, "u", "small " * 30)]), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "w")).selectExpr("page_id", "payload_bytes", "sha2(payload, 256) as h", "payload_digest").collect()}
    want = hashlib.sha256(text.encode()).hexdigest()
    assert (got[1]["payload_bytes"], got[1]["h"], got[1]["payload_digest"]) == (64 << 20, want, want) and got[2]["payload_bytes"] == 180


@pytest.mark.parametrize("form", ["plain", "a member each", "one member", "members of three"])
def test_archives_of_other_writers(spark, tmp_path, form):
    """Plain files and gzip members of one, some or all records give every record with its payload."""
    raw = [r for r, _ in FOREIGN]
    groups = {"plain": [], "a member each": [[r] for r in raw], "one member": [raw], "members of three": [raw[i : i + 3] for i in range(0, len(raw), 3)]}[form]
    data = b"".join(gzip.compress(b"".join(g)) for g in groups) or b"".join(raw)
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    warc.register(spark)
    df = spark.read.format("warc").option("splitBytes", 300).load(str(tmp_path))
    got = Counter((r["record_type"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect())
    kinds = "warcinfo response request response resource conversion revisit metadata".split()
    assert got == Counter(zip(kinds, (p for _, p in FOREIGN), strict=True))
    assert sorted(r["payload_bytes"] for r in df.filter("record_type <> 'revisit'").collect()) == sorted(len(p) for _, p in FOREIGN if p is not None)
    assert [bytes(p) for _, p in records(io.BytesIO(data), len(data), 0, len(data), lambda r: r["record_type"] == "resource", True)] == [b"plain\r\n\r\nblock"]


def test_payloads_of_plain_files_are_skipped():
    data = record("resource", b"x" * 40_000_000, "a/b") + record("resource", b"last", "a/b", 2)

    class Reads(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            Reads.seen += n
            return super().read(n)

    got = list(records(Reads(data), len(data), 0, len(data), lambda r: r["page_id"] == 2, True))
    assert [p for _, p in got] == [b"last"] and Reads.seen < 10_000_000


def test_head_of_any_length(spark, tmp_path):
    """A URL of two million characters leaves its record whole."""
    url = "http://long/" + "a" * 2_000_000
    write_warc(table(spark, [(1, url, BIG), (2, url, BIG), (3, "u", "short")]), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert got[1]["target_uri"] == url and got[1]["payload"].decode() == BIG and got[1]["payload_bytes"] == len(BIG)
    assert got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == len(BIG) and got[3]["payload"] == b"short"


def test_damaged_archives_raise():
    for data in (b"no archive at all", gzip.compress(b"WARC/1.0\r\nWARC-Type: x"), gzip.compress(FOREIGN[1][0])[:-20]):
        with pytest.raises(ValueError):
            list(records(io.BytesIO(data), len(data), 0, len(data), lambda r: True, True))
