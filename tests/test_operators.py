import sqlite3

import pytest
from helpers import frame, song
from pyspark.sql import functions as F

from strophe.operators import fulltext, lookup, metadata, paging, ranking
from strophe.operators.lookup import IdQuery
from strophe.operators.metadata import SearchQuery
from strophe.operators.paging import BadPage, Pagination
from strophe.schema import SONG_COLUMNS


@pytest.fixture(scope="module")
def songs(spark):
    return frame(
        spark,
        song("1-a.ttml", 1, ["ME!"], ["Taylor Swift"], ["Lover"], ncm_music_ids=["1", "2"], spotify_ids=["s"], author_ids=["7"], author_usernames=["u"]),
        song("2-b.ttml", 2, ["ME!"], ["Taylor Swift", "Other"], ["Lover"], ncm_music_ids=["2"], spotify_ids=["s"], author_ids=["7"]),
        song("3-c.ttml", 3, ["Love Story"], ["Taylor Swift"], ["Fearless"], ncm_music_ids=["3", "3"], author_usernames=["u"]),
        song("4-d.ttml", 4, ["夜曲"], ["周杰伦"], ["十一月的萧邦"], isrcs=["I"]),
        song("5-e.ttml", 4, [""], [], []),
    ).cache()


def names(df):
    return [r["filename"] for r in df.collect()]


def test_find_by_ids(songs):
    find = lambda q: sorted(names(lookup.find_by_ids(songs, q)))
    one = songs.filter("filename = '1-a.ttml'").first()["id"]
    assert find(IdQuery(id=one, ncm_music_ids=("3",))) == ["1-a.ttml"]
    assert find(IdQuery(filename="3-c.ttml", isrcs=("nope",))) == ["3-c.ttml"] and find(IdQuery(filename="9.ttml")) == []
    assert find(IdQuery(ncm_music_ids=("2",))) == ["1-a.ttml", "2-b.ttml"]
    assert find(IdQuery(ncm_music_ids=("1", "2"), spotify_ids=("s",))) == ["1-a.ttml"]
    assert find(IdQuery(spotify_ids=("S",))) == [] == find(IdQuery())
    assert names(lookup.pick_latest(lookup.find_by_ids(songs, IdQuery(spotify_ids=("s",))))) == ["2-b.ttml"]
    assert IdQuery(id=1).is_exact and not IdQuery(isrcs=("I",)).is_exact


def test_last_of_equal_ids(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "c", 1), (2, "d", 0)], "id long, v string, seq int")
    assert sorted((r["id"], r["v"]) for r in lookup.last_by(df, "id", "seq").collect()) == [(1, "b"), (2, "d")]


def test_postings(songs):
    rows = {tuple(r) for r in lookup.postings(songs).select("kind", "value").collect()}
    assert ("isrcs", "I") in rows and ("author_usernames", "u") in rows
    assert lookup.postings(songs).filter("value = '3'").count() == 1


def found(songs, **q):
    return [(r["filename"], r["score"]) for r in metadata.search_by_fields(songs, SearchQuery(**q)).collect()]


def test_search(songs):
    assert found(songs, track="ME!", artist="Taylor Swift") == [("1-a.ttml", 7), ("2-b.ttml", 4)]
    assert found(songs, q="Taylor Swift ME!") == [("2-b.ttml", 7), ("1-a.ttml", 7)]  # both artists are carved out, newer first
    assert found(songs, track="Completely Different Song") == []
    assert found(songs, track="love") == []  # contained, but too unlike to score
    assert found(songs, q="夜曲周杰倫") == [("4-d.ttml", 7)]
    assert [x[0] for x in found(songs, author_username="u")] == ["3-c.ttml", "1-a.ttml"]
    assert [x[0] for x in found(songs, author_id="nobody", author_username="u")] == ["3-c.ttml", "1-a.ttml"]
    assert [x[0] for x in found(songs, author_id="7", author_username="u")] == ["1-a.ttml"]
    assert found(songs, author_id="nobody") == [] == found(songs, author_id="nobody", author_username="u", track="me!")
    assert len(found(songs)) == 5


def test_rough_keyword(songs):
    passes = lambda q: sorted(names(songs.filter(metadata.rough_match(SearchQuery(q=q)))))
    assert passes("swift lover") == ["1-a.ttml", "2-b.ttml"]
    assert passes("xx taylor swift me! yy") == ["1-a.ttml", "2-b.ttml"]
    assert passes("swift nothing") == []
    assert passes("夜曲x") == ["4-d.ttml"]


@pytest.mark.parametrize("size", [10_000, 2])
def test_batch(spark, songs, monkeypatch, size):
    monkeypatch.setattr(metadata, "BATCH_QUERIES", size)
    q = spark.createDataFrame([("a", "me!", "taylor swift", None), ("b", "love story", None, None), ("c", "none", None, None)], "query_id string, track string, artist string, album string")
    got = metadata.search_batch(songs.select(*SONG_COLUMNS), q, 1).collect()
    ids = {r["filename"]: r["id"] for r in songs.collect()}
    assert {r["query_id"]: r["id"] for r in got} == {"a": ids["1-a.ttml"], "b": ids["3-c.ttml"]}


DOCS = [
    ("first line\nHello World Lyric\nlast line", ""), ("", "only in background vocal\nSunshine vocal"), ("", ""), ("aaaaa aaa", "aaa"),
    ("Café ÉTÉ hello\nhello hello", "hello"), ("over the\nline", ""), ('say "Hello" twice', "He said"), ("肖邦的夜曲 肖邦", ""),
]


def lyric_frame(spark):
    return frame(spark, *[song(f"{i}.ttml", i, lyric=a, bg=b) for i, (a, b) in enumerate(DOCS)])


@pytest.mark.parametrize("keyword", ["hello", "aaa", "caf", "Sunshine", "the\nline", "he", 'He"llo', "肖邦的", "line"])
def test_bm25_against_sqlite(spark, keyword):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(name UNINDEXED, lyric_text, bg_vocal_text, tokenize='trigram')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", [(f"{i}.ttml", a, b) for i, (a, b) in enumerate(DOCS)])
    phrase = '"' + keyword.replace('"', '""') + '"'
    want = dict(db.execute("SELECT name, bm25(f, 0.0, 1.0, 0.25) FROM f WHERE f MATCH ?", (phrase,)).fetchall()) if len(keyword) >= 3 else {}
    df = lyric_frame(spark).select("filename", "lyric_text", "bg_vocal_text")
    got = {r["filename"]: r["rank"] for r in fulltext.bm25(df, keyword).collect()}
    assert got == pytest.approx(want)


def test_fulltext_search(spark):
    df = lyric_frame(spark)
    ids = {r["id"]: r["filename"] for r in df.collect()}
    for exact in (False, True):
        got = {ids[r["id"]]: r for r in fulltext.search(df, "Hello", 10, exact).collect()}
        assert got["0.ttml"]["snippet"] == "first line\n<mark>Hello</mark> World Lyric\nlast line"
        bg = fulltext.search(df, "Sunshine", 10, exact).first()
        assert (bg["field"], bg["snippet"]) == ("BackgroundVocal", "only in background vocal\n<mark>Sunshine</mark> vocal")
        across = fulltext.search(df, "the\nline", 10, exact).first()
        assert (across["field"], across["snippet"]) == ("MainLyric", None)
    assert fulltext.search(df, "hello", 1).count() == 1 and fulltext.search(df, "  ", 5).count() == 0


def test_merge(spark, songs):
    ids = [r["id"] for r in songs.orderBy("timestamp", "filename").collect()]
    meta = spark.createDataFrame([(ids[0], 1, 5), (ids[1], 2, 3), (ids[2], 3, 1)], "id long, timestamp long, score int")
    lyric = spark.createDataFrame(
        [(ids[1], 0.5, "MainLyric", "x"), (ids[2], 0.1, "BackgroundVocal", None), (ids[3], 0.2, "BackgroundVocal", None), (999999, 0.0, "MainLyric", None)],
        "id long, rank double, field string, snippet string",
    )
    show = lambda df: [(ids.index(r["id"]), r["priority"], r["score"]) for r in ranking.ordered(df).collect()]
    assert show(ranking.merge(songs, meta, lyric, False)) == [(1, 5, 3), (0, 5, 5), (2, 4, 1), (3, 1, 0)]
    assert show(ranking.merge(songs, meta, lyric, True)) == [(1, 5, 3), (2, 4, 1)]
    assert show(ranking.merge(songs, meta, lyric, True, full_metadata=True)) == [(2, 5, 7), (3, 5, 7), (1, 5, 7)]
    assert ranking.merge(songs, meta.limit(0), lyric.limit(0), False).count() == 0


def test_paging(spark):
    assert Pagination.parse() == Pagination(1, 50) and Pagination.parse(" 2 ", "100") == Pagination(2, 100)
    for page, size, message in (("0", None, "'page' must be at least 1."), ("x", None, "'page' must be a positive integer."), (None, "101", "'pageSize' must not exceed 100."), (None, "-1", "'pageSize' must be a positive integer.")):
        with pytest.raises(BadPage, match=message):
            Pagination.parse(page, size)
    p = Pagination(2, 10)
    assert [r["id"] for r in p.slice(spark.range(25).orderBy("id")).collect()] == list(range(10, 20))
    assert p.info(25) == {"page": 2, "pageSize": 10, "total": 25, "totalPages": 3, "hasMore": True}
    assert Pagination(1, 10).info(0) == {"page": 1, "pageSize": 10, "total": 0, "totalPages": 0, "hasMore": False}
    assert p.info_frame(spark.range(20)).first().asDict() == {"page": 2, "page_size": 10, "total": 20, "total_pages": 2, "has_more": False}
    huge = Pagination.parse(str((1 << 64) - 1))
    assert huge.offset == (1 << 64) - 1 and huge.slice(spark.range(3)).count() == 0
    assert Pagination(2, 50).lyric_window == 300 and Pagination(9, 100).lyric_window == paging.WINDOW_CAP


def test_filters_reach_the_scan(spark, songs, tmp_path):
    songs.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = lookup.raw_text(stored, "1-a.ttml")._jdf.queryExecution().toString()
    assert "EqualTo(filename,1-a.ttml)" in plan
    plan = metadata.search_by_fields(stored, SearchQuery(track="me!"))._jdf.queryExecution().executedPlan().toString()
    assert "raw_ttml" not in plan and "lyric_text" not in plan
    plan = Pagination(2, 10).slice(metadata.search_by_fields(stored, SearchQuery(track="me!")))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and F is not None
