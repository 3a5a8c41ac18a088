"""Stored postings against the tests on every song, through upserts and merges."""

import random

import pytest
from helpers import frame, song
from pyspark.sql import functions as F

from strophe.operators import lookup, songindex
from strophe.operators.lookup import IdQuery
from strophe.operators.metadata import SearchQuery, rough_match, search_by_fields
from strophe.operators.songindex import SongIndex, bucket_of, places_of, write_songs
from strophe.sources.catalogue import Catalogue

WORDS = ["Rain", "rain", "Ü", "ß", "日本", "の", "歌", "x", "Night", "night (live)", "A", "", "of the", "THE", "🙂", "un[plugged]", "Café"]


def songs(spark, ids, seed):
    rng = random.Random(seed)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3)))
    some = lambda pool: sorted({rng.choice(pool) for _ in range(rng.randint(0, 3))})
    return frame(
        spark,
        *[
            song(f"{i}-s.ttml", i, [name() for _ in range(rng.randint(0, 3))], [name() for _ in range(rng.randint(0, 2))], [name()][: rng.randint(0, 1)],
                 ncm_music_ids=some("12345"), spotify_ids=some(["a", "ü", "a\nb", ""]), author_ids=some("78"))
            for i in ids
        ],
    )


QUERIES = [
    SearchQuery(track="rain"), SearchQuery(track="Rain", artist="x"), SearchQuery(album="ü"), SearchQuery(artist="日本"), SearchQuery(track=""), SearchQuery(q="rain"), SearchQuery(q="x"),
    SearchQuery(q="the night (live) of the 日本 rain"), SearchQuery(q="Café A Ü x"), SearchQuery(q="nothing like it"), SearchQuery(q=""), SearchQuery(q="rain", track="night", author_id="7"), SearchQuery(q="  🙂  "),
]


def same(spark, cat, part=slice(None)):
    index, rows = cat.song_index(), cat.read().cache()
    for q in QUERIES[part]:
        want = [tuple(r) for r in search_by_fields(rows, q).select("id", "score").collect()]
        assert [tuple(r) for r in search_by_fields(rows, q, index).select("id", "score").collect()] == want, q
        few = index.candidates(spark, q.prepared().q, {k: getattr(q.prepared(), k) for k in songindex.NAMES})
        if few is not None:
            assert {r["id"] for r in rows.filter(rough_match(q.prepared())).collect()} <= {r["id"] for r in few.collect()}, q
    for wanted in ({"ncm_music_ids": ["1"]}, {"ncm_music_ids": ["1", "2", "2"], "spotify_ids": ["ü"]}, {"spotify_ids": ["a\nb", ""], "author_ids": ["7"]}, {"isrcs": ["none"]}, {}):
        hits = F.lit(bool(wanted))
        for k, vs in wanted.items():
            for v in vs:
                hits = hits & F.array_contains(k, v)
        assert sorted(r["id"] for r in index.with_all(spark, wanted).collect()) == sorted(r["id"] for r in rows.filter(hits).collect()), wanted


def test_upserts_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(songindex, "DENSE", 4)  # arrays and bitmaps side by side
    monkeypatch.setattr(songindex, "BLOCK", 16)
    monkeypatch.setattr(songindex, "FOLDER", 200)
    cat = Catalogue(spark, str(tmp_path / "cat"))
    cat.upsert(songs(spark, range(60), 1))
    assert cat._state()["base"]["songs"][1] > 1
    same(spark, cat, slice(0, 13, 4))
    cat.upsert(songs(spark, [3, 4, 70], 2))
    monkeypatch.setattr(songindex, "SMALL", 0)
    cat.upsert(songs(spark, [4, 71], 3))
    same(spark, cat, slice(6, 8))
    cat.compact()
    assert len(cat.song_index().segments) == 1
    same(spark, cat, slice(11, 13))


def test_a_lookup_reads_its_folders(spark, tmp_path, monkeypatch):
    """Of many folders a lookup reads one for each value, and few songs are scored."""
    monkeypatch.setattr(songindex, "FOLDER", 50)
    rows = frame(spark, *[song(f"{i}-s.ttml", i, [f"title number {i}"], [f"artist {i % 7}"], ncm_music_ids=[str(i % 50)], isrcs=[f"I{i}"]) for i in range(400)]).cache()
    segment = write_songs(rows, str(tmp_path / "i"))
    index = SongIndex((segment,))
    assert segment.buckets >= 64
    read = index._postings(spark, 0, [("isrcs", "I77")]).inputFiles()
    assert read and index.with_all(spark, {"isrcs": ["I77"], "ncm_music_ids": ["27"]}).count() == 1
    plan = index._postings(spark, 0, [("isrcs", "I77")])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and f"= {bucket_of('isrcs', 'I77', segment.buckets)})" in plan.split("PartitionFilters")[1]
    found = index.candidates(spark, None, {"track": "number 123", "artist": None, "album": None})
    assert found.count() == 1 and index.candidates(spark, "artist 3 title number 123", {}).count() < 40
    assert [r["id"] for r in lookup.find_by_ids(rows, IdQuery(isrcs=("I5",)), index=index).collect()] == [r["id"] for r in rows.filter("timestamp = 5").collect()]
    long = " ".join(f"w{i}" for i in range(2000))
    assert index.candidates(spark, long, {}) is None and search_by_fields(rows, SearchQuery(q=long), index).count() == 0


def test_bits(spark):
    rng = random.Random(4)
    places = sorted(rng.sample(range(32768), 900))
    df = spark.createDataFrame([(p,) for p in places], "p int").agg(F.bitmap_construct_agg("p").alias("bits"))
    assert df.select(places_of(F.col("bits"))).first()[0] == places


def test_empty(spark, tmp_path):
    none = write_songs(frame(spark, song("1-s.ttml")).limit(0), str(tmp_path / "i"))
    assert none.songs == 0 and SongIndex((none,)).with_all(spark, {"isrcs": ["x"]}).collect() == [] and SongIndex(()).candidates(spark, "x", {}).collect() == []
    bare = write_songs(frame(spark, song("1-s.ttml")), str(tmp_path / "i"))
    assert SongIndex((bare,)).with_all(spark, {"isrcs": ["x"]}).collect() == []


@pytest.mark.parametrize("word", ["a", "ab", "abc", "abcd", "abcdefgh"])
def test_cover(word):
    pieces = songindex._cover(word)
    assert all(p in word for p in pieces) and max(map(len, pieces)) == min(3, len(word))
    covered = {i + j for p in pieces for i in range(len(word)) if word.startswith(p, i) for j in range(len(p))}
    assert covered == set(range(len(word)))
