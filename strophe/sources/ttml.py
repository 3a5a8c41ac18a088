"""Timed lyrics (TTML) as columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.ids import filename_timestamp, lyric_id
from ..functions.lyrics import LINE_TYPE, joined_text
from ..functions.text import normalize_names
from ..schema import CATALOGUE

PARSED = f"struct<lines:array<{LINE_TYPE}>,title:array<string>,artist:array<string>,album:array<string>,author_ids:array<string>,author_names:array<string>>"
#: Metadata keys of the file's head and the field each fills.
HEAD_KEYS = {"musicName": "title", "artists": "artist", "album": "album", "ttmlAuthorGithub": "author_ids", "ttmlAuthorGithubLogin": "author_names"}
_ROLE = "{http://www.w3.org/ns/ttml#metadata}role"
_CLOCK = re.compile(r"(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d+))?(s?)")


def clock_ms(text: str | None) -> int:
    """Milliseconds of ``[[h:]m:]s[.fff]`` or ``12.5s``; ValueError for anything else."""
    m = _CLOCK.fullmatch((text or "").strip())
    if not m:
        raise ValueError(f"bad time {text!r}")
    hours, minutes, seconds = (int(x or 0) for x in m.groups()[:3])
    return ((hours * 60 + minutes) * 60 + seconds) * 1000 + int(((m[4] or "") + "000")[:3])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node, skip: tuple[str, ...]) -> str:
    parts = [node.text or ""]
    for child in node:
        if child.get(_ROLE) not in skip:
            parts.append(_text(child, skip))
        parts.append(child.tail or "")
    return "".join(parts)


_ASIDE = ("x-bg", "x-translation", "x-roman")


def parse_ttml(raw: str | None) -> dict | None:
    """Lines with background vocals, and the head's metadata; None if it isn't a readable TTML file."""
    if raw is None:
        return None
    try:
        root = ET.fromstring(raw)
        if _local(root.tag) != "tt":
            return None
        lines = []
        for p in root.iter():
            if _local(p.tag) != "p":
                continue
            bg = next((x for x in p if x.get(_ROLE) == "x-bg"), None)
            line = {"start": clock_ms(p.get("begin")), "end": clock_ms(p.get("end")), "text": _text(p, _ASIDE).strip(), "bg": None}
            if bg is not None:
                line["bg"] = {
                    "start": clock_ms(bg.get("begin") or p.get("begin")), "end": clock_ms(bg.get("end") or p.get("end")), "text": _text(bg, _ASIDE).strip(),
                }
            lines.append(line)
    except (ET.ParseError, ValueError):
        return None
    out: dict = {"lines": lines, "title": [], "artist": [], "album": [], "author_ids": [], "author_names": []}
    for node in root.iter():
        if _local(node.tag) == "meta" and node.get("key") in HEAD_KEYS and node.get("value"):
            out[HEAD_KEYS[node.get("key")]].append(node.get("value"))
    return out


def _parse_batches(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ["lines", "title", "artist", "album", "author_ids", "author_names"]
    for s in texts:
        rows = [parse_ttml(t) or {} for t in s]
        yield pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, columns=names)


def parse(raw: str | Column) -> Column:
    """Arrow-batched :func:`parse_ttml`; an unreadable file gives a struct of nulls."""
    return pandas_udf(_parse_batches, PARSED)(raw)


def build_catalogue(files: DataFrame) -> DataFrame:
    """Catalogue rows of ``filename, content``; unreadable files are dropped."""
    parsed = files.select("filename", "content", parse("content").alias("p")).filter("p.lines is not null")
    none = F.array().cast("array<string>")
    p = lambda n: F.coalesce(F.col(f"p.{n}"), none)
    values: dict[str, Column] = {
        "id": lyric_id(F.col("filename")), "filename": F.col("filename"), "timestamp": filename_timestamp(F.col("filename")),
        "track_names": p("title"), "artist_names": p("artist"), "album_names": p("album"),
        "normalized_track_names": normalize_names(p("title")), "normalized_artist_names": normalize_names(p("artist")), "normalized_album_names": normalize_names(p("album")),
        "author_ids": p("author_ids"), "author_usernames": p("author_names"),
        "lyric_text": joined_text(F.col("p.lines")), "bg_vocal_text": joined_text(F.col("p.lines"), background=True), "raw_ttml": F.col("content"),
    }
    return parsed.select(*[values.get(f.name, none).alias(f.name) for f in CATALOGUE])
