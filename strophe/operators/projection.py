"""Response items as columns and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Response key of each catalogue column, in order.
SONG_KEYS = (
    ("id", "id"), ("filename", "filename"), ("musicNames", "track_names"), ("artistNames", "artist_names"), ("albumNames", "album_names"),
    ("ncmMusicIds", "ncm_music_ids"), ("qqMusicIds", "qq_music_ids"), ("appleMusicIds", "apple_music_ids"), ("spotifyIds", "spotify_ids"),
    ("isrcs", "isrcs"), ("authorIds", "author_ids"), ("authorUsernames", "author_usernames"),
)


def song_item(df: DataFrame, lyrics: str | None = None, snippet: str | None = None, has_context: Column | None = None) -> DataFrame:
    """Native items; ``lyrics`` and ``snippet`` name columns. Absent parts are null, which JSON leaves out."""
    columns = [F.col(c).alias(k) for k, c in SONG_KEYS]
    if lyrics:
        columns += [F.col(lyrics).alias("lyrics"), F.lit("ttml").alias("format")]
    if snippet:
        shown = F.col(snippet).isNotNull() if has_context is None else has_context
        columns.append(F.when(shown, F.struct(F.col(snippet).alias("snippet"))).alias("matchContext"))
    return df.select(*columns)


def first_or_empty(names: str) -> Column:
    return F.coalesce(F.get(F.col(names), F.lit(0)), F.lit(""))


def lrclib_item(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Compatibility items: first names, and formatted lyrics that may be missing."""
    return df.select(
        "id", first_or_empty("track_names").alias("name"), first_or_empty("track_names").alias("trackName"),
        first_or_empty("artist_names").alias("artistName"), first_or_empty("album_names").alias("albumName"),
        F.coalesce(F.col(formatted)["duration"], F.lit(0.0)).alias("duration"), F.lit(False).alias("instrumental"),
        F.col(formatted)["plain_lyrics"].alias("plainLyrics"), F.col(formatted)["synced_lyrics"].alias("syncedLyrics"),
    )


def to_json(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """One column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("json"))
