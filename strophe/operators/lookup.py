"""Finding songs by id, file name and platform ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import lyric_id_of
from ..schema import PLATFORM_COLUMNS, POSTING_COLUMNS
from .songindex import SongIndex


@dataclass(frozen=True)
class IdQuery:
    """An id or file name decides alone; else every platform id given must be on the song."""

    id: int | None = None
    filename: str | None = None
    ncm_music_ids: tuple[str, ...] = field(default=())
    qq_music_ids: tuple[str, ...] = field(default=())
    apple_music_ids: tuple[str, ...] = field(default=())
    spotify_ids: tuple[str, ...] = field(default=())
    isrcs: tuple[str, ...] = field(default=())

    @property
    def is_exact(self) -> bool:
        return self.id is not None or self.filename is not None


def id_predicate(query: IdQuery) -> Column:
    if query.id is not None:
        return F.col("id") == F.lit(query.id).cast("long")
    if query.filename is not None:  # the hash can be pushed to the scan, the name decides
        return (F.col("id") == F.lit(lyric_id_of(query.filename)).cast("long")) & (F.col("filename") == query.filename)
    terms = [F.array_contains(c, v) for c in PLATFORM_COLUMNS for v in getattr(query, c)]
    out = F.lit(bool(terms))
    for t in terms:
        out = out & t
    return out


def last_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``seq``; pre-aggregated before its shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("row")).select(key, *[F.col("row")[c].alias(c) for c in rest])


def find_by_ids(songs: DataFrame, query: IdQuery, seq: str | None = None, index: SongIndex | None = None) -> DataFrame:
    """Songs that match; with ``seq`` (load order) the last of songs that share an id.

    With the ``index`` of the songs, platform ids are looked up in its folders; the arrays are tested on what that finds.
    """
    if index is not None and not query.is_exact:
        songs = songs.join(index.with_all(songs.sparkSession, {c: list(getattr(query, c)) for c in PLATFORM_COLUMNS}), "id", "left_semi")
    out = songs.filter(id_predicate(query))
    return last_by(out, "id", seq) if seq and query.is_exact else out


def pick_latest(songs: DataFrame) -> DataFrame:
    """One song, the newest; of equally new ones that with the smallest id."""
    return songs.orderBy(F.desc("timestamp"), F.asc("id")).limit(1)


def postings(songs: DataFrame) -> DataFrame:
    """The inverted index ``kind, value, id``: one row for each value that a song has, in one scan."""

    def pairs(kind: str) -> Column:
        return F.transform(kind, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    entries = F.flatten(F.array(*map(pairs, POSTING_COLUMNS)))
    return songs.select("id", F.inline(F.array_distinct(entries)))


def raw_text(catalogue: DataFrame, filename: str) -> DataFrame:
    """The stored file of a name; no row if it is missing or empty. The name filter reaches the scan."""
    return catalogue.filter((F.col("filename") == filename) & (F.col("raw_ttml") != "")).select("raw_ttml")
