"""Weighted scores of songs against queries, as tiers 0 (no match) to 7 (perfect)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HIGH, LOW, MEDIUM, NO_MATCH, PERFECT, PRETTY_HIGH, VERY_HIGH, VERY_LOW
from .similarity import artist_points, best_name
from .text import let

TITLE_WEIGHT, ARTIST_WEIGHT, ALBUM_WEIGHT = 1.0, 1.0, 0.4
BEST = 10.0
FULL = BEST * (TITLE_WEIGHT + ARTIST_WEIGHT + ALBUM_WEIGHT)
#: Least scaled score of each tier; fixed values.
TIERS = ((21.0, PERFECT), (19.0, VERY_HIGH), (17.0, HIGH), (15.0, PRETTY_HIGH), (11.0, MEDIUM), (6.5, LOW), (2.5, VERY_LOW))


def classify(score: Column) -> Column:
    out = F.when(score >= TIERS[0][0], TIERS[0][1])
    for least, tier in TIERS[1:]:
        out = out.when(score >= least, tier)
    return out.otherwise(NO_MATCH)


def score_fields(title: Column, artist: Column, album: Column) -> Column:
    """Tier for normalised title, artist and album queries, each null if not asked for."""
    total = (
        best_name(title, F.col("normalized_track_names")) * TITLE_WEIGHT
        + artist_points(artist, F.col("normalized_artist_names")) * ARTIST_WEIGHT
        + best_name(album, F.col("normalized_album_names")) * ALBUM_WEIGHT
    )
    asked = lambda q, w: F.when(q.isNotNull(), BEST * w).otherwise(0.0)
    possible = asked(title, TITLE_WEIGHT) + asked(artist, ARTIST_WEIGHT) + asked(album, ALBUM_WEIGHT)
    scaled = F.when((possible > 0) & (possible < FULL), total * (F.lit(FULL) / possible)).otherwise(total)
    return let(scaled, classify)


def _first_in(names: Column, text: Column) -> Column:
    """The first non-empty name that the text contains, or null."""
    return F.get(F.filter(names, lambda n: (n != "") & F.contains(text, n)), F.lit(0))


def _without(text: Column, name: Column) -> Column:
    return F.when(name.isNull(), text).otherwise(F.trim(F.replace(text, name, F.lit(""))))


def score_keyword(q: Column) -> Column:
    """Tier for one normalised keyword: artist and album are carved out of it, the rest is the title."""
    artists, albums, tracks = (F.col(f"normalized_{k}_names") for k in ("artist", "album", "track"))

    def with_artist(artist: Column) -> Column:
        return let(_without(q, artist), lambda rest: let(_first_in(albums, rest), lambda album: with_album(artist, rest, album)))

    def with_album(artist: Column, rest: Column, album: Column) -> Column:
        cut = _without(rest, album)
        return let(F.when(cut == "", rest).otherwise(cut), lambda title: scored(artist, album, title))

    def scored(artist: Column, album: Column, title: Column) -> Column:
        parts = F.struct(
            best_name(title, tracks).alias("t"),
            F.when(artist.isNotNull(), 10).otherwise(artist_points(q, artists)).alias("a"),
            F.when(album.isNotNull(), 10).otherwise(best_name(q, albums)).alias("b"),
        )

        def tier(p: Column) -> Column:
            t, a, b = p["t"], p["a"], p["b"]
            total = b * ALBUM_WEIGHT + a * ARTIST_WEIGHT + t * TITLE_WEIGHT
            worth = lambda c, w: F.when(c, BEST * w).otherwise(0.0)
            possible = worth(a > 0, ARTIST_WEIGHT) + worth(b > 0, ALBUM_WEIGHT) + worth((title != "") | (t > 0), TITLE_WEIGHT)
            return let(total * (F.lit(FULL) / F.when(possible == 0, FULL).otherwise(possible)), classify)

        return let(parts, tier)

    return let(_first_in(artists, q), with_artist)


def priority(score: Column, has_lyric: Column, is_main: Column) -> Column:
    """Bucket of a merged hit, 5 first."""
    return (
        F.when(score >= MEDIUM, 5).when((score > 0) & has_lyric, 4).when(has_lyric & is_main, 3)
        .when(score > 0, 2).when(has_lyric, 1).otherwise(0)
    )
