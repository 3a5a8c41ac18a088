"""Fuzzy search by names: a cheap filter, then a tiered score, then a total order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_fields, score_keyword
from ..functions.text import any_contains, contains_ascii_ci, normalize_text, simplify_text
from ..schema import NO_MATCH, PERFECT, SONG_COLUMNS
from .songindex import SongIndex


@dataclass(frozen=True)
class SearchQuery:
    q: str | None = None
    track: str | None = None
    artist: str | None = None
    album: str | None = None
    lyric_text: str | None = None
    author_id: str | None = None
    author_username: str | None = None
    #: Conversion of Traditional characters or phrases, see :func:`simplify_text`; None is the built-in one.
    table: Mapping[str, str] | None = field(default=None, compare=False, repr=False)

    @property
    def has_text(self) -> bool:
        return any(x is not None for x in (self.q, self.track, self.artist, self.album))

    def prepared(self) -> SearchQuery:
        """With simplified, normalised names; author fields stay as given."""
        plain = simplify_text if self.table is None else partial(simplify_text, table=self.table)
        norm = lambda s: None if s is None else normalize_text(plain(s))
        return replace(self, q=norm(self.q), track=norm(self.track), artist=norm(self.artist), album=norm(self.album))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def rough_keyword(q: Column, words: Column) -> Column:
    """A track and an artist lie within the keyword, or every word meets some name, either containing the other."""
    wrapped = lambda names: F.exists(names, lambda n: contains_ascii_ci(q, n))

    def meets(word: Column) -> Column:
        near = lambda n: contains_ascii_ci(n, word) | ((F.octet_length(n) > 1) & contains_ascii_ci(word, n))
        return F.exists("track_names", near) | F.exists("artist_names", near) | F.exists("album_names", near)

    return (wrapped(F.col("track_names")) & wrapped(F.col("artist_names"))) | F.forall(words, meets)


def rough_match(query: SearchQuery) -> Column:
    """The cheap filter for a prepared query; everything passes an empty one."""
    out = F.lit(True)
    if query.q is not None:
        out = out & rough_keyword(F.lit(query.q), F.array(*map(F.lit, query.q.split())).cast("array<string>"))
    for column, value in (("normalized_track_names", query.track), ("normalized_artist_names", query.artist), ("normalized_album_names", query.album)):
        if value is not None:
            out = out & any_contains(F.col(column), F.lit(value))
    for column, value in (("author_ids", query.author_id), ("author_usernames", query.author_username)):
        if value is not None:
            out = out & F.array_contains(column, value)
    return out


def score(query: SearchQuery) -> Column:
    """Tier for a prepared query with text."""
    if query.q is not None and query.track is None and query.artist is None and query.album is None:
        return score_keyword(F.lit(query.q))
    title = query.track if query.track is not None else query.q
    artist = query.artist if query.artist is not None else query.q
    return score_fields(_text(title), _text(artist), _text(query.album))


def author_candidates(songs: DataFrame, query: SearchQuery) -> DataFrame:
    """Songs of the author: of the two keys those that anyone has must hold; none known, none found.

    Whether a key is known takes one look at the catalogue that stops at the first hit.
    """
    asked = [(c, v) for c, v in (("author_ids", query.author_id), ("author_usernames", query.author_username)) if v is not None]
    if not asked:
        return songs
    known = asked if len(asked) == 1 else [(c, v) for c, v in asked if not songs.filter(F.array_contains(c, v)).select("id").isEmpty()]
    out = F.lit(bool(known))
    for c, v in known:
        out = out & F.array_contains(c, v)
    return songs.filter(out)


def search_hits(songs: DataFrame, query: SearchQuery, index: SongIndex | None = None) -> DataFrame:
    """Unordered hits with ``score``; without text fields every candidate is perfect.

    With the ``index`` of the songs, only those whose names have the query's pieces are tested and scored.
    """
    query = query.prepared()
    few = None if index is None else index.candidates(songs.sparkSession, query.q, {"track": query.track, "artist": query.artist, "album": query.album})
    if few is not None:
        songs = songs.join(few, "id", "left_semi")
    found = author_candidates(songs, query)
    if not query.has_text:
        return found.withColumn("score", F.lit(PERFECT))
    return found.filter(rough_match(query)).withColumn("score", score(query)).filter(F.col("score") > NO_MATCH)


def search_by_fields(songs: DataFrame, query: SearchQuery, index: SongIndex | None = None) -> DataFrame:
    """Hits by score, then newest, then smallest id."""
    columns = [c for c in songs.columns if c in SONG_COLUMNS]
    return search_hits(songs.select(*columns), query, index).orderBy(F.desc("score"), F.desc("timestamp"), F.asc("id"))


#: Queries of a batch that go into one scan of the songs.
BATCH_QUERIES = 10_000


def search_batch(songs: DataFrame, queries: DataFrame, per_query: int) -> DataFrame:
    """Many queries at once: ``query_id`` and nullable ``track, artist, album`` (normalised) against all songs.

    Extension. Queries are expanded into the songs' scan as an array, so the catalogue is read once for each
    BATCH_QUERIES of them and not shuffled; only hits are. The list of queries must fit the driver.
    """
    from pyspark.sql import Window

    rows = queries.select("query_id", "track", "artist", "album").collect()
    kind = f"array<struct<query_id:{queries.schema['query_id'].dataType.simpleString()},track:string,artist:string,album:string>>"
    near = lambda names, v: v.isNull() | any_contains(F.col(names), v)

    def hits_of(part: list) -> DataFrame:
        wanted = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("query_id", "track", "artist", "album")]) for r in part]).cast(kind)
        some = F.filter(wanted, lambda w: near("normalized_track_names", w["track"]) & near("normalized_artist_names", w["artist"]) & near("normalized_album_names", w["album"]))
        return songs.withColumn("w", F.explode(some)).select(
            F.col("w.query_id").alias("query_id"), "id", "timestamp", score_fields(F.col("w.track"), F.col("w.artist"), F.col("w.album")).alias("score")
        )

    hits = hits_of(rows[:BATCH_QUERIES])
    for at in range(BATCH_QUERIES, len(rows), BATCH_QUERIES):
        hits = hits.unionByName(hits_of(rows[at : at + BATCH_QUERIES]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("timestamp"), F.asc("id"))
    return hits.filter("score > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_query)
