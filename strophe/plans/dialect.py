"""Request query strings as search and id queries."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl

from ..functions.ids import parse_id
from ..operators.lookup import IdQuery
from ..operators.metadata import SearchQuery
from ..operators.paging import Pagination


class BadRequest(ValueError):
    pass


@dataclass(frozen=True)
class Dialect:
    """Parameter names and the query fields they set; ``required`` fields must all be there."""

    fields: dict[str, str]
    required: tuple[str, ...] = ()


NATIVE_SEARCH = Dialect({
    "q": "q", "musicName": "track", "artistName": "artist", "albumName": "album", "lyricText": "lyric_text",
    "authorId": "author_id", "authorUsername": "author_username",
})
LRCLIB_SEARCH = Dialect({"q": "q", "track_name": "track", "artist_name": "artist", "album_name": "album"})
LRCLIB_GET = Dialect({"track_name": "track", "artist_name": "artist", "album_name": "album"}, ("track", "artist"))
ID_LISTS = {"ncmMusicId": "ncm_music_ids", "qqMusicId": "qq_music_ids", "appleMusicId": "apple_music_ids", "spotifyId": "spotify_ids", "isrc": "isrcs"}


def _pairs(query: str) -> list[tuple[str, str]]:
    """Decoded pairs whose value isn't blank."""
    return [(k, v) for k, v in parse_qsl(query, keep_blank_values=True, errors="replace") if v.strip()]


def _fields(query: str, dialect: Dialect) -> tuple[dict[str, str], dict[str, str]]:
    found, page = {}, {}
    for k, v in _pairs(query):
        if k in ("page", "pageSize"):
            page[k] = v
        elif k in dialect.fields:
            found[dialect.fields[k]] = v
    return found, page


def parse_search(query: str, dialect: Dialect = NATIVE_SEARCH) -> tuple[SearchQuery, Pagination]:
    """The last value of a parameter counts; ``q`` counts only alone. Page errors come after missing fields."""
    found, page = _fields(query, dialect)
    if not found:
        raise BadRequest("Missing valid search parameters.")
    if len(found) > 1:
        found.pop("q", None)
    try:
        return SearchQuery(**found), Pagination.parse(page.get("page"), page.get("pageSize"))
    except ValueError as e:
        raise BadRequest(str(e)) from None


def parse_exact(query: str, dialect: Dialect = LRCLIB_GET) -> SearchQuery:
    found, _ = _fields(query, dialect)
    if any(r not in found for r in dialect.required):
        raise BadRequest("Both 'track_name' and 'artist_name' are required for precise matching.")
    return SearchQuery(**found)


def parse_get(query: str) -> IdQuery:
    """Platform ids add up. Errors in this order: id, format, file name, nothing asked."""
    found: dict = {}
    wanted_format = "ttml"
    for k, v in _pairs(query):
        if k == "id":
            try:
                found["id"] = parse_id(v)
            except ValueError as e:
                raise BadRequest(str(e)) from None
        elif k == "filename":
            found["filename"] = v
        elif k == "format":
            wanted_format = v
        elif k in ID_LISTS:
            found[ID_LISTS[k]] = (*found.get(ID_LISTS[k], ()), v)
    if wanted_format != "ttml":
        raise BadRequest(f"Unsupported format: '{wanted_format}'. Only 'ttml' is currently supported.")
    if not found.get("filename", ".ttml").endswith(".ttml"):
        raise BadRequest(f"Invalid filename: '{found['filename']}'. Must end with '.ttml'.")
    if not found:
        raise BadRequest(f"At least one parameter is required (id, filename, {', '.join(ID_LISTS)}).")
    return IdQuery(**found)
