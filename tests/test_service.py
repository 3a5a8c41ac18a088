import hashlib
import hmac
import json

import pytest
from helpers import two_songs

from strophe.functions.ids import MAX_ID
from strophe.operators.lookup import IdQuery
from strophe.operators.metadata import SearchQuery
from strophe.operators.paging import Pagination
from strophe.plans import dialect, service
from strophe.plans.dialect import BadRequest


@pytest.fixture(scope="module")
def songs(spark):
    return two_songs(spark).cache()


ITEM = '"id":699269132670751,"filename":"test_song_one.ttml","musicNames":["Test Song One"],"artistNames":["Artist Alpha"],"albumNames":[],"ncmMusicIds":["1001"],"qqMusicIds":[],"appleMusicIds":[],"spotifyIds":["sp1001"],"isrcs":[],"authorIds":[],"authorUsernames":[]'
PAGE = '"pagination":{"page":1,"pageSize":50,"total":1,"totalPages":1,"hasMore":false}'


def test_search_response(songs):
    assert service.search_response(songs, "musicName=Test+Song+One") == f'{{"status":200,"data":{{"items":[{{{ITEM}}}],{PAGE}}}}}'
    context = '"matchContext":{"snippet":"<mark>Hello</mark> World Lyric"}'
    assert service.search_response(songs, "lyricText=Hello") == f'{{"status":200,"data":{{"items":[{{{ITEM},{context}}}],{PAGE}}}}}'


def test_get_response(songs):
    raw = songs.filter("id = 699269132670751").first()["raw_ttml"]
    want = f'{{"status":200,"data":{{{ITEM},"lyrics":{json.dumps(raw)},"format":"ttml"}}}}'
    assert service.get_response(songs, "spotifyId=sp1001") == want
    with pytest.raises(service.NotFound) as e:
        service.get_response(songs, "spotifyId=missing")
    assert service.error_body(e.value) == {"status": 404, "error": "Not Found", "message": "No lyrics found for the provided query."}


LRC = {
    1: '{"id":699269132670751,"name":"Test Song One","trackName":"Test Song One","artistName":"Artist Alpha","albumName":"","duration":3.0,"instrumental":false,"plainLyrics":"Hello World Lyric","syncedLyrics":"[00:01.00] Hello World Lyric"}',
    2: '{"id":5440178231786117,"name":"Test Song Two","trackName":"Test Song Two","artistName":"Artist Beta","albumName":"","duration":4.0,"instrumental":false,"plainLyrics":"Second Song Lyric","syncedLyrics":"[00:02.00] Second Song Lyric"}',
}


def test_lrclib(songs):
    assert service.lrclib_response(service.lrclib_search(songs, "q=Artist")) == f"[{LRC[2]},{LRC[1]}]"
    assert service.lrclib_response(service.lrclib_get(songs, "track_name=Test+Song+One&artist_name=Artist+Alpha"), single=True) == LRC[1]
    assert service.lrclib_response(service.lrclib_get_by_id(songs, "5440178231786117"), single=True) == LRC[2]
    with pytest.raises(service.NotFound):
        service.lrclib_response(service.lrclib_get(songs, "track_name=Nothing&artist_name=Nobody"), single=True)
    with pytest.raises(BadRequest, match="Invalid ID format"):
        service.lrclib_get_by_id(songs, "x")


def test_weak_metadata_falls_through_to_lyrics(songs):
    hits = service.search_lyric(songs, SearchQuery(q="World Lyric"), Pagination()).collect()
    assert [(r["id"], r["priority"]) for r in hits] == [(699269132670751, 3)]
    only = service.search_lyric(songs, SearchQuery(lyric_text="lyric"), Pagination()).collect()
    assert [r["priority"] for r in only] == [5, 5]
    # a text query that meets every song: their scores give way to perfect ones
    every = service.search_lyric(songs, SearchQuery(artist="artist", lyric_text="hello"), Pagination()).collect()
    assert [(r["id"], r["score"]) for r in every] == [(699269132670751, 7)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("q=a", SearchQuery(q="a")), ("musicName=a&q=b", SearchQuery(track="a")), ("q=+&musicName=x", SearchQuery(track="x")), ("musicName=a&musicName=b", SearchQuery(track="b")),
        ("authorId=1&authorUsername=u&lyricText=l", SearchQuery(author_id="1", author_username="u", lyric_text="l")), ("q=%E5%A4%9C", SearchQuery(q="夜")), ("albumName=a+b&zzz=1", SearchQuery(album="a b")),
    ],
)
def test_parse_search(text, want):
    assert dialect.parse_search(text) == (want, Pagination())


@pytest.mark.parametrize(
    ("text", "message"),
    [("", "Missing valid"), ("q=", "Missing valid"), ("page=2&pageSize=x", "Missing valid"), ("q=a&page=0", "at least 1"), ("q=a&pageSize=101", "must not exceed 100"), ("zzz=1", "Missing valid")],
)
def test_bad_search(text, message):
    with pytest.raises(BadRequest, match=message):
        dialect.parse_search(text)


def test_lrclib_dialects():
    assert dialect.parse_search("track_name=a&musicName=b&page=2", dialect.LRCLIB_SEARCH) == (SearchQuery(track="a"), Pagination(2))
    assert dialect.parse_exact("track_name=a&artist_name=b&q=c") == SearchQuery(track="a", artist="b")
    for bad in ("track_name=a", "artist_name=b&track_name=+", ""):
        with pytest.raises(BadRequest, match="Both"):
            dialect.parse_exact(bad)


def test_parse_get():
    assert dialect.parse_get("ncmMusicId=1&ncmMusicId=2&isrc=+&isrc=x") == IdQuery(ncm_music_ids=("1", "2"), isrcs=("x",))
    assert dialect.parse_get(f"id={MAX_ID}&filename=a.ttml&format=ttml") == IdQuery(id=MAX_ID, filename="a.ttml")
    for bad, message in (
        ("id=x&format=lrc&filename=a", "Invalid ID"), ("format=lrc&filename=a", "Unsupported format: 'lrc'"), ("filename=a.TTML", "Invalid filename: 'a.TTML'"),
        ("format=ttml", "At least one"), ("id=%205", "Invalid ID"), ("", "At least one"),
    ):
        with pytest.raises(BadRequest, match=message):
            dialect.parse_get(bad)


def test_webhook_status_and_headers(songs):
    body, secret, ran = b"{}", "s3", []
    signature = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    assert service.webhook_sync({"Authorization": "Bearer s3"}, body, secret, lambda: ran.append(1)) == {"status": 200, "message": "Sync triggered"}
    assert service.verify_webhook({"X-Hub-Signature-256": signature}, body, secret) and ran == [1]
    for h in ({}, {"Authorization": "Bearer no"}, {"X-Hub-Signature-256": "sha256=zz"}, {"X-Hub-Signature-256": signature[:-1] + "x"}):
        with pytest.raises(service.Unauthorized):
            service.webhook_sync(h, body, secret, lambda: None)
    assert service.error_body(service.Unauthorized())["status"] == 401 and service.error_body(RuntimeError("secret"))["message"] == "An internal error occurred."
    assert service.error_body(service.Upstream("x"))["status"] == 502
    assert service.status(songs, "1", {"commit": "c"}, 5)["runtime"] == {"uptimeSeconds": 5, "lyricCount": 2}
    assert service.cache_control("get", True) != service.cache_control("get") and service.cache_control("status") == "no-store"


def test_missing_lyrics_are_fetched(spark, songs):
    """Compatibility routes ask ``fetch`` for files that aren't stored; a search goes on without them, a get fails."""
    from pyspark.sql import functions as F

    raw = {r["filename"]: r["raw_ttml"] for r in songs.collect()}
    bare = songs.withColumn("raw_ttml", F.lit(""))
    asked = []

    def fetch(name):
        asked.append(name)
        if name == "test_song_two.ttml":
            raise OSError("down")
        return raw[name]

    lost = LRC[2].replace("4.0", "0.0").replace('"Second Song Lyric"', "null").replace('"[00:02.00] Second Song Lyric"', "null")
    assert service.lrclib_response(service.lrclib_search(bare, "q=Artist", fetch)) == f"[{lost},{LRC[1]}]" and sorted(asked) == sorted(raw)
    assert service.lrclib_response(service.lrclib_get(bare, "track_name=Test+Song+One&artist_name=Artist+Alpha", fetch), single=True) == LRC[1]
    with pytest.raises(OSError, match="down"):
        service.lrclib_get_by_id(bare, "5440178231786117", fetch)
    with pytest.raises(service.Upstream):
        service.lrclib_get_by_id(bare, "5440178231786117")


def test_failed_lyric_search_leaves_metadata(songs, monkeypatch):
    from pyspark.errors import PySparkException

    def fail(*a, **k):
        raise PySparkException("no index")

    monkeypatch.setattr(service.fulltext, "search", fail)
    assert json.loads(service.search_response(songs, "q=Test+Song+One"))["data"]["pagination"]["total"] >= 1
    assert json.loads(service.search_response(songs, "lyricText=Hello"))["data"]["items"] == []


def test_stored_index(songs, tmp_path):
    """A search through the text index equals one through all texts, for phrases of any kind."""
    from strophe.operators import fulltext, textindex

    segment = textindex.write_segment(songs, str(tmp_path / "index"))
    index = textindex.TextIndex((segment,), segment.docs, segment.length)
    for phrase in ("lyric", "Hello W", "ello world", "zzz", "he", "d Song L", 'a"b', "\\E."):
        want = [tuple(r) for r in fulltext.search(songs, phrase, 10).collect()]
        assert [tuple(r) for r in fulltext.search(songs, phrase, 10, index=index).collect()] == want
    assert service.search_response(songs, "lyricText=Hello", index) == service.search_response(songs, "lyricText=Hello")


def test_phrase_table(tmp_path):
    from strophe.functions.text import load_phrases, simplify_text

    (tmp_path / "t.txt").write_text("# comment\n頭髮\t头发\n發\t发\n髮\t发 髪\n頭\t头\nbroken\n", encoding="utf-8")
    table = load_phrases(str(tmp_path / "t.txt"))
    assert table == {"頭髮": "头发", "發": "发", "髮": "发", "頭": "头"}
    assert simplify_text("頭髮發x頭", {**table, "頭髮": "TF"}) == "TF发x头" and simplify_text("", {}) == ""
    assert SearchQuery(track="頭髮", table=table).prepared().track == "头发"
