import contextlib
import json
import os
import time
import zipfile

import pytest
from helpers import ttml
from pyspark.sql import functions as F

from strophe.functions.ids import lyric_id_of
from strophe.functions.lyrics import formatted
from strophe.sources import catalogue, files, index
from strophe.sources.catalogue import Catalogue, SyncResult, sync_once
from strophe.sources.ttml import build_catalogue, clock_ms, parse, parse_ttml
from strophe.streaming.ingest import ingest_stream

SAMPLE = """<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata" xmlns:x="urn:x">
<head><metadata><x:meta key="musicName" value="Name"/><x:meta key="artists" value="A"/><x:meta key="artists" value="B"/><x:meta key="zzz" value="q"/></metadata></head>
<body><div><p begin="01:02:03.040" end="01:02:07"><span begin="01:02:03.040" end="01:02:05">Rivers </span><span begin="01:02:05" end="01:02:07">bend</span><span ttm:role="x-translation">Flüsse</span></p></div>
<div><p begin="59.999s" end="1:00.005">Small hours</p><p begin="2:30" end="2:41.7">Over the hill<span ttm:role="x-bg" begin="2:31" end="2:33.25">ooh, again</span></p></div></body></tt>"""


def test_ttml(spark):
    df = spark.createDataFrame([("1-a.ttml", SAMPLE), ("2-b.ttml", "no xml"), ("3-c.ttml", None), ("4-d.ttml", "<tt/>"), ("5-e.ttml", '<tt><p begin="x" end="1">t</p></tt>')], "filename string, content string")
    got = {r["filename"]: r["f"] for r in df.select("filename", formatted(parse("content")["lines"]).alias("f")).collect()}
    f = got["1-a.ttml"]
    assert f["plain_lyrics"] == "Small hours\nOver the hill\n(ooh, again)\nRivers bend" and f["duration"] == 3727.0
    assert f["synced_lyrics"] == "[00:59.99] Small hours\n[02:30.00] Over the hill\n[02:31.00] (ooh, again)\n[62:03.04] Rivers bend"
    for k in ("2-b.ttml", "3-c.ttml", "4-d.ttml", "5-e.ttml"):
        assert tuple(got[k]) == (None, None, 0.0)
    rows = {r["filename"]: r for r in build_catalogue(df).collect()}
    assert set(rows) == {"1-a.ttml", "4-d.ttml"}
    r = rows["1-a.ttml"]
    assert (r["timestamp"], r["track_names"], r["artist_names"], r["normalized_artist_names"]) == (1, ["Name"], ["A", "B"], ["a", "b"])
    assert (r["lyric_text"], r["raw_ttml"]) == ("Rivers bend\nSmall hours\nOver the hill", SAMPLE) and "ooh, again" in r["bg_vocal_text"]


def test_clock():
    assert [clock_ms(x) for x in ("1.5", "00:01.500", "1:00:00", "2.25s", "0:59.9999")] == [1500, 1500, 3600000, 2250, 59999]
    for bad in (None, "", "x", "1:2:3:4"):
        with pytest.raises(ValueError):
            clock_ms(bad)
    assert parse_ttml("<other/>") is None


LINES = [
    '{"rawLyricFile":"1-a.ttml","metadata":[["ncmMusicId",["1"]],["isrc",[]]]}', "", "   ", "broken", '{"rawLyricFile":5}', '{"metadata":[]}', '{"rawLyricFile":"x.ttml","metadata":[["k"]]}',
    ' {"rawLyricFile":"1-a.ttml","metadata":[["ncmMusicId",["2"]],["ncmMusicId",["3"]],["ttmlAuthorGithub",["9"]],["odd",["z"]]]} ',
    '{"rawLyricFile":"2-b.ttml","metadata":[]}', '{"rawLyricFile":"3-c.ttml","metadata":[]}',
]


def test_index(spark, tmp_path):
    (tmp_path / "index.jsonl").write_text("\n".join(LINES))
    got = {r["filename"]: r["metadata"] for r in index.read_index(spark, str(tmp_path / "index.jsonl")).collect()}
    assert set(got) == {"1-a.ttml", "2-b.ttml", "3-c.ttml"}
    assert [(m["key"], m["values"]) for m in got["1-a.ttml"]] == [("ncmMusicId", ["2"]), ("ncmMusicId", ["3"]), ("ttmlAuthorGithub", ["9"]), ("odd", ["z"])]


def archive(path, names):
    with zipfile.ZipFile(path, "w") as z:
        for n in names:
            z.writestr(n, ttml(("00:01.000", "00:02.000", f"words of {n}")))
        z.writestr("note.txt", "x")
        z.writestr("bad.ttml", b"\xff\xfe")
        z.writestr("broken.ttml", "<tt")
        z.mkdir("dir.ttml")
    return str(path)


def test_sync(spark, tmp_path):
    zipped = archive(tmp_path / "all.zip", ["1-a.ttml", "2-b.ttml", "9-z.TTML"])
    (tmp_path / "index.jsonl").write_text("\n".join(LINES))
    remote = index.read_index(spark, str(tmp_path / "index.jsonl")).cache()
    cat = Catalogue(spark, str(tmp_path / "cat"))
    assert cat.count() == 0 and cat.meta("commit") is None
    assert sync_once(cat, remote, "c1", zipped) == SyncResult("Updated", 2, "full")
    rows = {r["filename"]: r for r in cat.read().collect()}
    assert set(rows) == {"1-a.ttml", "2-b.ttml"} and rows["1-a.ttml"]["ncm_music_ids"] == ["2", "3"] and rows["1-a.ttml"]["author_ids"] == ["9"]
    assert sync_once(cat, remote, "c1", zipped).status == "Skipped"
    assert sync_once(cat, remote, "c2", zipped, fetch=lambda n: None) == SyncResult("Updated", 0, "incremental")
    assert cat.meta("commit") == "c2"
    text = ttml(("00:01.000", "00:02.000", "third"))
    assert sync_once(cat, remote, "c3", fetch=lambda n: text) == SyncResult("Updated", 1, "incremental")
    assert sync_once(cat, remote, "c4", fetch=lambda n: text) == SyncResult("Skipped", 0, "incremental")
    more = spark.createDataFrame([(f"{i}-n.ttml", []) for i in range(3)], "filename string, metadata array<struct<key:string,values:array<string>>>")
    assert sync_once(cat, more, "c5", archive(tmp_path / "n.zip", ["0-n.ttml"]), fetch=lambda n: text, limit=2) == SyncResult("Updated", 1, "full")
    assert cat.count() == 4


def test_upsert_keeps_ids(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path / "cat"))
    files_ = lambda t: spark.createDataFrame([("1-a.ttml", ttml(("0:01", "0:02", t)))], files.SCHEMA)
    cat.upsert(build_catalogue(files_("old")).withColumn("id", F.lit(5).cast("long")))
    before = cat.read()
    cat.upsert(build_catalogue(files_("new")))
    after = cat.read().collect()
    assert [(r["id"], r["lyric_text"]) for r in after] == [(5, "new")]
    assert before.first()["lyric_text"] == "old"  # a reader keeps its version
    cat.compact()
    assert [(r["id"], r["lyric_text"]) for r in cat.read().collect()] == [(5, "new")] and before.first()["lyric_text"] == "old"


def songs(spark, *named):
    return build_catalogue(spark.createDataFrame([(n, ttml(("0:01", "0:02", t))) for n, t in named], files.SCHEMA))


def test_upsert_writes_the_new_rows_only(spark, tmp_path, monkeypatch):
    """Rows go to deltas; of equal file names the newest row counts; deltas are merged when they are many."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    cat.upsert(songs(spark, *[(f"{i}-a.ttml", "old") for i in range(20)]))
    cat.upsert(songs(spark, ("3-a.ttml", "new")))
    cat.upsert(songs(spark, ("3-a.ttml", "newer"), ("99-b.ttml", "first")).withColumn("timestamp", F.lit(1).cast("long")).unionByName(songs(spark, ("99-b.ttml", "second"))))
    state = cat._state()
    assert [d["rows"] for d in state["deltas"]] == [1, 2]
    want = {f"{i}-a.ttml": "old" for i in range(20)} | {"3-a.ttml": "newer", "99-b.ttml": "second"}
    have = lambda: {r["filename"]: r["lyric_text"] for r in cat.read().collect()}
    assert have() == want and cat.count() == 21
    monkeypatch.setattr(catalogue, "DELTAS", 2)
    cat.upsert(songs(spark, ("4-a.ttml", "merged")))
    assert cat._state()["deltas"] == [] and have() == want | {"4-a.ttml": "merged"}


def test_no_update_is_lost(spark, tmp_path):
    """A writer that another one overtakes between reading and publishing builds on the other's state."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    cat.set_meta("a", "1")
    other, real = Catalogue(spark, str(tmp_path / "cat")), cat._publish

    def late(name, text):
        cat._publish = real
        other.set_meta("b", "2")
        other.set_meta("a", "4")
        return real(name, text)

    cat._publish = late
    cat.set_meta("c", "3")
    assert (cat.meta("a"), cat.meta("b"), cat.meta("c")) == ("4", "2", "3")
    assert sorted(p.name for p in (tmp_path / "cat/log").glob("*.json")) == [f"{i:012d}.json" for i in range(1, 5)]


def test_publishing(spark, tmp_path, monkeypatch):
    """A name is given once, to a whole file, by links and by renaming alike; drafts that a crash left are no states."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    cat.set_meta("a", "1")
    (tmp_path / "cat/drafts/left").write_text('{"base"')
    assert not cat._publish("log/000000000001.json", "other") and cat._publish("log/000000000002.json", json.dumps(cat._state())) and cat.meta("a") == "1"
    real = cat._path

    class Named:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "shared"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(cat, "_path", lambda name: (Named(real(name)[0]), real(name)[1]))
    assert cat._publish("x/1", "one") and not cat._publish("x/1", "two") and (tmp_path / "cat/x/1").read_text() == "one"
    assert [p.name for p in (tmp_path / "cat/drafts").iterdir() if not p.name.startswith(".")] == ["left"]


def test_threads(spark, tmp_path):
    """Writers side by side lose nothing: marks, rows, ids and counts are those of all of them."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "cat")
    Catalogue(spark, root).upsert(songs(spark, ("0-base.ttml", "base")))

    def marks(k):
        for i in range(25):
            Catalogue(spark, root).set_meta(f"{k}-{i}", str(i))

    def upserts(k):
        for i in range(2):
            Catalogue(spark, root).upsert(songs(spark, (f"{k}-{i}.ttml", f"song {k} {i}"), ("9-same.ttml", f"by {k}")))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda f: f[0](f[1]), [(marks, "x"), (marks, "y"), (upserts, 1), (upserts, 2)]))
    cat = Catalogue(spark, root)
    assert {f"{k}-{i}": str(i) for k in "xy" for i in range(25)}.items() <= cat._state()["meta"].items()
    rows = {r["filename"]: r["lyric_text"] for r in cat.read().collect()}
    assert rows.keys() == {f"{k}-{i}.ttml" for k in (1, 2) for i in range(2)} | {"0-base.ttml", "9-same.ttml"} and rows["9-same.ttml"] in ("by 1", "by 2")
    assert cat.count() == cat.read().count() == 6
    assert cat.text_index().length == sum(max(0, len(t) - 2) for t in rows.values())
    found = {r["id"] for r in cat.text_index().hits(spark, "by ").collect()}
    assert found == {lyric_id_of("9-same.ttml")}


def test_single_flight_and_version(spark, tmp_path, monkeypatch):
    cat = Catalogue(spark, str(tmp_path / "cat"))
    zipped = archive(tmp_path / "all.zip", ["1-a.ttml"])
    remote = spark.createDataFrame([("1-a.ttml", [])], "filename string, metadata array<struct<key:string,values:array<string>>>")

    def no_version():
        raise OSError("unreachable")

    with cat.single_flight():
        assert sync_once(cat, remote, None, zipped) == SyncResult("Skipped", 0, "busy")
    assert sync_once(cat, remote, archive=zipped, version=no_version) == SyncResult("Updated", 1, "full") and cat.meta("commit") is None
    assert sync_once(cat, remote, archive=zipped, version=lambda: "v1").status == "Skipped" and cat.meta("commit") == "v1"
    assert sync_once(cat, remote, archive=zipped, version=lambda: "v1") == SyncResult("Skipped", 0, "none")


def test_expired_lease(spark, tmp_path, monkeypatch):
    """A lease that isn't renewed goes to the next sync; what the old holder commits after that is refused, and the new lease stays."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    zipped = archive(tmp_path / "all.zip", ["1-a.ttml"])
    remote = spark.createDataFrame([("1-a.ttml", [])], "filename string, metadata array<struct<key:string,values:array<string>>>")
    monkeypatch.setattr(catalogue.Catalogue, "_renewed", lambda self, renew: contextlib.nullcontext())
    with cat.single_flight() as old:
        old.set_meta("by", "old")
        assert sync_once(cat, remote, archive=zipped).strategy == "busy"
        cat._update(lambda s: {**s, "lease": {**s["lease"], "until": time.time() - 1}})  # the holder was cut off for too long
        with cat.single_flight() as new:
            new.set_meta("by", "new")
            for commit in (lambda: old.set_meta("by", "old again"), lambda: old.upsert(songs(spark, ("2-b.ttml", "late")))):
                with pytest.raises(catalogue.Fenced):
                    commit()
            new.upsert(songs(spark, ("3-c.ttml", "kept")))
            assert new.lease == old.lease + 1
            with pytest.raises(catalogue.Busy), cat.single_flight():
                pass
        assert cat.meta("by") == "new" and cat.count() == 1
        with cat.single_flight() as third:
            held = cat._state()["lease"]
            assert held["number"] == third.lease and held["until"] > time.time()
    assert sync_once(cat, remote, archive=zipped) == SyncResult("Updated", 1, "full")


def test_lease_is_renewed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "LEASE", 0.9)
    cat = Catalogue(spark, str(tmp_path / "cat"))
    with cat.single_flight() as mine:
        for _ in range(6):
            time.sleep(0.4)
            with pytest.raises(catalogue.Busy), cat.single_flight():
                pass
        mine.set_meta("still", "mine")
    with cat.single_flight():
        assert cat.meta("still") == "mine"


def test_sweep_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    """Folders of a writer that goes on stay; one whose claim ran out is deleted, and its writer can't commit it."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    cat.upsert(songs(spark, ("1-a.ttml", "a")))
    folders = lambda: {p.name.split("-")[0] for k in ("data", "index") for p in (tmp_path / f"cat/{k}").iterdir()}
    monkeypatch.setattr(catalogue.Catalogue, "_renewed", lambda self, renew: contextlib.nullcontext())
    old = time.time() - 2 * catalogue.LEASE
    real = cat._with_delta

    def age(*a):
        for k in ("data", "index"):
            for p in (tmp_path / f"cat/{k}").iterdir():
                os.utime(p, (old, old))

    def swept(state, seen, entry, written, batch, lapse=False):
        age()
        if lapse:
            other = Catalogue(spark, cat.root)
            other._update(lambda s: {**s, "claims": dict.fromkeys(s["claims"], time.time() - 1)})
            state = other._state()
        Catalogue(spark, cat.root)._sweep()
        return real(Catalogue(spark, cat.root)._state(), seen, entry, written, batch)

    cat._with_delta = swept
    cat.upsert(songs(spark, ("2-b.ttml", "b")))
    assert {r["lyric_text"] for r in cat.read().collect()} == {"a", "b"}
    before = folders()
    cat._with_delta = lambda *a: swept(*a, lapse=True)
    with pytest.raises(catalogue.Fenced):
        cat.upsert(songs(spark, ("3-c.ttml", "c")))
    assert folders() == before and {r["lyric_text"] for r in cat.read().collect()} == {"a", "b"}


def test_folder(spark, tmp_path):
    (tmp_path / "1-a.ttml").write_text(SAMPLE)
    (tmp_path / "b.TTML").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_text("x")
    assert [r["filename"] for r in files.read_folder(spark, str(tmp_path)).collect()] == ["1-a.ttml"]


def test_stream(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    zipped = archive(tmp_path / "all.zip", ["1-a.ttml", "2-b.ttml", "3-c.ttml"])
    cat = Catalogue(spark, str(tmp_path / "cat"))
    (tmp_path / "in/i1.jsonl").write_text("\n".join(LINES[:8]))
    ingest_stream(spark, str(tmp_path / "in"), cat, zipped, str(tmp_path / "ckpt"))
    assert cat.count() == 1
    (tmp_path / "in/i2.jsonl").write_text("\n".join(LINES[8:]))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), cat, zipped, str(tmp_path / "ckpt"))
    assert cat.count() == 3 and cat.batch(str(tmp_path / "ckpt")) == 1
    # A crash after the commit of the catalogue, before that of the stream: the batch comes again and is known by its number.
    for p in (tmp_path / "ckpt/commits").glob("*1*"):
        p.unlink()
    monkeypatch.setattr(catalogue, "_sync", None)
    before = cat._newest()
    ingest_stream(spark, str(tmp_path / "in"), cat, zipped, str(tmp_path / "ckpt"))
    assert cat._newest() == before and list((tmp_path / "ckpt/commits").glob("1"))


def test_batches_are_taken_once(spark, tmp_path):
    """The state that takes a batch's rows knows its number, so it can't be taken again, in whatever order writers come."""
    cat = Catalogue(spark, str(tmp_path / "cat"))
    assert cat.upsert(songs(spark, ("1-a.ttml", "first")), batch=("s", 0)) and cat.upsert(songs(spark, ("1-a.ttml", "second")), batch=("s", 1))
    number = cat._newest()[0]
    assert not cat.upsert(songs(spark, ("1-a.ttml", "first")), batch=("s", 0)) and cat._newest()[0] == number
    late, real = Catalogue(spark, cat.root), cat._with_delta

    def overtaken(state, *a):
        cat._with_delta = real
        late.upsert(songs(spark, ("1-a.ttml", "third")), batch=("s", 2))
        return real(late._state(), *a)

    cat._with_delta = overtaken
    assert not cat.upsert(songs(spark, ("1-a.ttml", "third")), batch=("s", 2))
    assert [r["lyric_text"] for r in cat.read().collect()] == ["third"] and cat.batch("s") == 2 and cat.batch("t") is None and len(cat._state()["deltas"]) == 2
