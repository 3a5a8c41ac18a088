"""Service calls over a catalogue: frames and JSON responses. There is no server here."""

from __future__ import annotations

import hashlib
import hmac
import json
import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lyrics import formatted
from ..operators import fulltext, lookup, projection, ranking
from ..operators.metadata import SearchQuery, search_by_fields, search_hits
from ..operators.paging import Pagination
from ..operators.songindex import SongIndex
from ..schema import MEDIUM, SONG_COLUMNS
from ..sources.ttml import parse
from . import dialect
from .dialect import BadRequest

log = logging.getLogger(__name__)

WEAK_HITS = 10
#: Lyric files fetched at a time for a page.
FETCHES = 10
#: Cache-Control by kind of route; fixed values.
CACHE_CONTROL = {
    "exact": "public, max-age=1209600, s-maxage=2592000",
    "weak": "public, max-age=259200, s-maxage=604800, stale-while-revalidate=86400",
    "search": "public, max-age=3600, s-maxage=7200, stale-while-revalidate=1800",
    "error": "public, max-age=3600, s-maxage=7200",
    "none": "no-store",
}


class NotFound(LookupError):
    pass


class Unauthorized(PermissionError):
    pass


class Upstream(RuntimeError):
    """A remote store failed."""


def error_body(error: Exception) -> dict:
    """Status, name and public message of an error."""
    if isinstance(error, NotFound):
        return {"status": 404, "error": "Not Found", "message": str(error) or "No lyrics found for the provided query."}
    if isinstance(error, BadRequest):
        return {"status": 400, "error": "Bad Request", "message": str(error)}
    if isinstance(error, Unauthorized):
        return {"status": 401, "error": "Unauthorized", "message": "Invalid or missing authorization token."}
    if isinstance(error, Upstream):
        return {"status": 502, "error": "Bad Gateway", "message": "Upstream service unavailable."}
    return {"status": 500, "error": "Internal Server Error", "message": "An internal error occurred."}


def is_weak(meta: DataFrame) -> bool:
    """Whether metadata hits call for lyrics too: none, none of medium tier, or fewer than ten."""
    row = meta.agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n")).first()
    return row["n"] < WEAK_HITS or row["best"] < MEDIUM


NO_LYRICS = "id long, timestamp long, rank double, field string, snippet string"


def search_lyric(
    catalogue: DataFrame, query: SearchQuery, page: Pagination, index: fulltext.TextIndex | None = None, held: list | None = None, lyrics: bool = True,
    names: SongIndex | None = None,
) -> DataFrame:
    """All merged hits of a hybrid search for a page, ordered; lyric hits are limited by the page's window.

    ``index`` is the catalogue's text index, ``names`` its index of songs. Metadata hits are scored once; to keep them for the
    merge they are persisted, and appended to ``held`` for the caller to release. Without ``held`` they are
    scored again. Without ``lyrics`` no lyric is a hit.
    """
    songs = catalogue.select(*SONG_COLUMNS)
    meta = search_hits(songs, query, names).select("id", "timestamp", "score")
    if held is not None:
        held.append(meta.persist())
    explicit = query.lyric_text is not None
    keyword = query.lyric_text if explicit else query.q if query.q is not None and is_weak(meta) else None
    if keyword is None or not lyrics:
        lyric = catalogue.sparkSession.createDataFrame([], NO_LYRICS)
    else:
        lyric = fulltext.search(catalogue, keyword, page.lyric_window, index=index)
    full = explicit and not query.has_text and query.author_id is None and query.author_username is None
    if explicit and not full:
        full = meta.count() == songs.count()
    return ranking.ordered(ranking.merge(songs, meta, lyric, explicit, full))


def search_page(catalogue: DataFrame, query: SearchQuery, page: Pagination, index: fulltext.TextIndex | None = None, names: SongIndex | None = None) -> tuple[DataFrame, dict]:
    """Native items of a page, in order, and the page's description.

    If the lyric search fails, the page has metadata hits only.
    """
    held: list[DataFrame] = []
    try:
        try:
            hits = search_lyric(catalogue, query, page, index, held, names=names).persist()
            held.append(hits)
            info = page.info(hits.count())
        except (PySparkException, Py4JError):
            if query.lyric_text is None and query.q is None:
                raise
            log.exception("lyric search failed")
            hits = search_lyric(catalogue, query, page, None, held, lyrics=False, names=names).persist()
            held.append(hits)
            info = page.info(hits.count())
        top = page.slice(ranking.ordered(hits)).withColumn("place", F.monotonically_increasing_id())
        rows = top.drop("timestamp").join(catalogue.select(*SONG_COLUMNS), "id").orderBy("place")
        items = projection.song_item(rows, snippet="snippet", has_context=F.col("field").isNotNull())
        # the page holds at most 100 rows
        return catalogue.sparkSession.createDataFrame(items.collect(), items.schema), info
    finally:
        for df in held:
            df.unpersist()


def search_response(catalogue: DataFrame, query: str, index: fulltext.TextIndex | None = None, names: SongIndex | None = None) -> str:
    asked, page = dialect.parse_search(query)
    items, info = search_page(catalogue, asked, page, index, names)
    rows = [json.loads(r["json"]) for r in projection.to_json(items).collect()]
    return _json({"status": 200, "data": {"items": rows, "pagination": info}})


def get_response(catalogue: DataFrame, query: str, fetch: Callable[[str], str | None] | None = None, names: SongIndex | None = None) -> str:
    """The newest song that an id query finds, with its file, or ``fetch``'s if that isn't stored."""
    found = lookup.pick_latest(lookup.find_by_ids(catalogue.select(*SONG_COLUMNS), dialect.parse_get(query), index=names))
    row = found.first()
    if row is None:
        raise NotFound
    text = lookup.raw_text(catalogue, row["filename"]).first()
    lyrics = text[0] if text else fetch(row["filename"]) if fetch else None
    if lyrics is None:
        raise NotFound
    one = catalogue.sparkSession.createDataFrame([row], found.schema).withColumn("raw", F.lit(lyrics))
    return _json({"status": 200, "data": json.loads(projection.to_json(projection.song_item(one, lyrics="raw")).first()["json"])})


Fetch = Callable[[str], str | None]


def _compatible(catalogue: DataFrame, hits: DataFrame, fetch: Fetch | None, strict: bool) -> DataFrame:
    """Compatibility items of a page of at most 100 hits, in order, with the stored files or ``fetch``'s.

    A file that is neither stored nor fetched leaves its item without lyrics, or, if ``strict``, raises the
    error of the fetch. The page's ids are pushed to the scan of the files.
    """
    spark, rows = catalogue.sparkSession, hits.collect()
    stored = catalogue.filter(F.col("id").isin([r["id"] for r in rows])).select("id", "raw_ttml").collect() if rows else []
    texts = {r["id"]: r["raw_ttml"] for r in stored if r["raw_ttml"]}

    def get(name: str) -> str | None:
        try:
            found = fetch(name) if fetch is not None else None
            if found is None:
                raise Upstream(f"no lyric file for {name}")
            return found
        except Exception:
            if strict:
                raise
            log.warning("no lyric file for %s", name)
            return None

    lost = [r for r in rows if r["id"] not in texts]
    with ThreadPoolExecutor(FETCHES) as pool:
        texts.update(zip([r["id"] for r in lost], pool.map(get, [r["filename"] for r in lost]), strict=True))
    raw = spark.createDataFrame([(i, r["id"], texts[r["id"]]) for i, r in enumerate(rows)], "place long, text_id long, raw string")
    known = spark.createDataFrame(rows, hits.schema)
    items = known.join(raw, F.col("id") == F.col("text_id")).withColumn("formatted", formatted(parse("raw")["lines"]))
    return projection.lrclib_item(items.orderBy("place"))


def lrclib_search(catalogue: DataFrame, query: str, fetch: Fetch | None = None, names: SongIndex | None = None) -> DataFrame:
    """Compatibility items of a page; lyrics that are neither stored nor fetched are null."""
    asked, page = dialect.parse_search(query, dialect.LRCLIB_SEARCH)
    return _compatible(catalogue, page.slice(search_by_fields(catalogue.select(*SONG_COLUMNS), asked, names)), fetch, strict=False)


def lrclib_get(catalogue: DataFrame, query: str, fetch: Fetch | None = None, names: SongIndex | None = None) -> DataFrame:
    """The best hit's compatibility item, if it is of medium tier at least; a file that can't be had is an error."""
    hits = search_by_fields(catalogue.select(*SONG_COLUMNS), dialect.parse_exact(query), names).limit(1).filter(F.col("score") >= MEDIUM)
    return _compatible(catalogue, hits, fetch, strict=True)


def lrclib_get_by_id(catalogue: DataFrame, id_text: str, fetch: Fetch | None = None) -> DataFrame:
    from ..functions.ids import InvalidId, parse_id

    try:
        wanted = parse_id(id_text)
    except InvalidId as e:
        raise BadRequest(str(e)) from None
    hits = lookup.find_by_ids(catalogue.select(*SONG_COLUMNS), lookup.IdQuery(id=wanted))
    return _compatible(catalogue, hits, fetch, strict=True)


def lrclib_response(items: DataFrame, single: bool = False) -> str:
    rows = [json.loads(r["json"]) for r in projection.to_json(items, keep_nulls=True).collect()]
    if single and not rows:
        raise NotFound
    return _json(rows[0] if single else rows)


def status(catalogue: DataFrame, version: str, build: Mapping[str, str], uptime_seconds: int) -> dict:
    return {"status": "ok", "version": version, "build": dict(build), "runtime": {"uptimeSeconds": uptime_seconds, "lyricCount": catalogue.count()}}


def verify_webhook(headers: Mapping[str, str], body: bytes, secret: str) -> bool:
    """A bearer token equal to the secret, or a valid SHA-256 signature of the body."""
    held = {k.lower(): v for k, v in headers.items()}
    if hmac.compare_digest(held.get("authorization", "").encode(), f"Bearer {secret}".encode()):
        return True
    signature = held.get("x-hub-signature-256", "")
    wanted = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return signature.startswith("sha256=") and hmac.compare_digest(signature.removeprefix("sha256=").lower().encode(), wanted.encode())


def webhook_sync(headers: Mapping[str, str], body: bytes, secret: str, trigger: Callable[[], None]) -> dict:
    if not verify_webhook(headers, body, secret):
        raise Unauthorized
    trigger()
    return {"status": 200, "message": "Sync triggered"}


def cache_control(route: str, exact: bool = False) -> str:
    if route == "get":
        return CACHE_CONTROL["exact" if exact else "weak"]
    return CACHE_CONTROL.get(route, CACHE_CONTROL["none"])


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
