"""Small catalogues."""

from strophe.functions.ids import lyric_id_of
from strophe.functions.text import normalize_text
from strophe.schema import ARRAY_COLUMNS, CATALOGUE


def ttml(*lines):
    """A file of (begin, end, text) lines."""
    body = "".join(f'<p begin="{a}" end="{b}">{t}</p>' for a, b, t in lines)
    return f'<tt xmlns="http://www.w3.org/ns/ttml"><body><div>{body}</div></body></tt>'


def song(filename, timestamp=0, tracks=(), artists=(), albums=(), lyric="", bg="", raw="", **arrays):
    row = {c: [] for c in ARRAY_COLUMNS}
    row |= {"track_names": list(tracks), "artist_names": list(artists), "album_names": list(albums)}
    row |= {f"normalized_{k}": [normalize_text(x) for x in row[k]] for k in ("track_names", "artist_names", "album_names")}
    row |= {k: list(v) for k, v in arrays.items()}
    row |= {"id": lyric_id_of(filename), "filename": filename, "timestamp": timestamp, "lyric_text": lyric, "bg_vocal_text": bg, "raw_ttml": raw}
    return tuple(row[f.name] for f in CATALOGUE)


def frame(spark, *songs):
    return spark.createDataFrame(list(songs), CATALOGUE)


def two_songs(spark):
    return frame(
        spark,
        song("test_song_one.ttml", 1600000000, ["Test Song One"], ["Artist Alpha"], ncm_music_ids=["1001"], spotify_ids=["sp1001"],
             lyric="Hello World Lyric", raw=ttml(("00:01.000", "00:03.000", "Hello World Lyric"))),
        song("test_song_two.ttml", 1700000000, ["Test Song Two"], ["Artist Beta"], ncm_music_ids=["1002"], spotify_ids=["sp1002"],
             lyric="Second Song Lyric", raw=ttml(("00:02.000", "00:04.000", "Second Song Lyric"))),
    )
