"""The catalogue's schema and the names of match tiers."""

from pyspark.sql import types as T

_NAMES = T.ArrayType(T.StringType(), False)

ARRAY_COLUMNS = (
    "track_names", "artist_names", "album_names",
    "normalized_track_names", "normalized_artist_names", "normalized_album_names",
    "ncm_music_ids", "qq_music_ids", "apple_music_ids", "spotify_ids", "isrcs",
    "author_ids", "author_usernames",
)
TEXT_COLUMNS = ("lyric_text", "bg_vocal_text", "raw_ttml")
PLATFORM_COLUMNS = ("ncm_music_ids", "qq_music_ids", "apple_music_ids", "spotify_ids", "isrcs")
POSTING_COLUMNS = (*PLATFORM_COLUMNS, "author_ids", "author_usernames")

CATALOGUE = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("filename", T.StringType(), False), T.StructField("timestamp", T.LongType(), False)]
    + [T.StructField(c, _NAMES, False) for c in ARRAY_COLUMNS]
    + [T.StructField(c, T.StringType(), False) for c in TEXT_COLUMNS]
)
#: What searching by metadata needs: everything but the large texts.
SONG_COLUMNS = ("id", "filename", "timestamp", *ARRAY_COLUMNS)

NO_MATCH, VERY_LOW, LOW, MEDIUM, PRETTY_HIGH, HIGH, VERY_HIGH, PERFECT = range(8)
TIER_NAMES = ("NoMatch", "VeryLow", "Low", "Medium", "PrettyHigh", "High", "VeryHigh", "Perfect")
