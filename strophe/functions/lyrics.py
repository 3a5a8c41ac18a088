"""Lyric lines as plain text and LRC, snippets and highlighting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LINE_TYPE = "struct<start:long,end:long,text:string,bg:struct<start:long,end:long,text:string>>"


def lrc_timestamp(ms: Column) -> Column:
    """``[mm:ss.cc]``; hundredths are cut off, minutes may have more digits."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    minutes = F.floor(ms / 60000)
    shown = F.when(minutes < 100, two(minutes)).otherwise(minutes.cast("string"))
    return F.concat(F.lit("["), shown, F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), two(F.floor(ms % 1000 / 10)), F.lit("]"))


def ordered_lines(lines: Column) -> Column:
    """Main and background lines with text, by start time, main first, else in their order."""
    indexed = F.transform(lines, lambda x, i: F.array(
        F.struct(x["start"].alias("start"), F.lit(0).alias("bg"), i.alias("i"), x["text"].alias("text")),
        F.struct(x["bg"]["start"].alias("start"), F.lit(1).alias("bg"), i.alias("i"),
                 F.when(x["bg"]["text"] != "", F.concat(F.lit("("), x["bg"]["text"], F.lit(")"))).otherwise(F.lit("")).alias("text")),
    ))
    return F.array_sort(F.filter(F.flatten(indexed), lambda x: x["text"].isNotNull() & (x["text"] != "")))


def formatted(lines: Column) -> Column:
    """Struct ``plain_lyrics, synced_lyrics, duration``; texts are null without lines, a null parse has duration 0."""
    rows = ordered_lines(lines)
    some = F.size(rows) > 0
    ends = F.transform(lines, lambda x: F.greatest(x["end"], F.coalesce(x["bg"]["end"], F.lit(0).cast("long"))))
    return F.struct(
        F.when(some, F.array_join(F.transform(rows, lambda x: x["text"]), "\n")).alias("plain_lyrics"),
        F.when(some, F.array_join(F.transform(rows, lambda x: F.concat(lrc_timestamp(x["start"]), F.lit(" "), x["text"])), "\n")).alias("synced_lyrics"),
        F.coalesce(F.array_max(ends) / 1000.0, F.lit(0.0)).alias("duration"),
    )


def joined_text(lines: Column, background: bool = False) -> Column:
    """Texts of main or of background lines, one a line."""
    if background:
        lines = F.filter(lines, lambda x: x["bg"].isNotNull())
    return F.coalesce(F.array_join(F.transform(lines, lambda x: x["bg"]["text"] if background else x["text"]), "\n"), F.lit(""))


def highlight_text(text: str, keyword: str) -> str:
    """Wrap each occurrence, without regard to case, from the left and without overlap, in ``<mark>``."""
    if not keyword or not text:
        return text
    low, n = keyword.lower(), len(keyword.lower())
    out, at, i = [], 0, 0
    while i + n <= len(text):
        if text[i : i + n].lower() == low:
            out += [text[at:i], "<mark>", text[i : i + n], "</mark>"]
            at = i = i + n
        else:
            i += 1
    return "".join([*out, text[at:]])


def snippet_of(text: str | None, keyword: str) -> str | None:
    """The first line with the keyword and a line each side, highlighted; None without one."""
    if not text or not text.strip() or not keyword.strip():
        return None
    lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]
    low = keyword.lower()
    for i, line in enumerate(lines):
        if low in line.lower():
            return highlight_text("\n".join(lines[max(0, i - 1) : i + 2]), keyword)
    return None


def exact_snippet(keyword: str):
    """Arrow-batched :func:`snippet_of`; case mapping is per occurrence, so lengths may differ in any script."""

    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet_of(t, keyword))

    return run


def quoted(keyword: str) -> str:
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def snippet(text: Column, keyword: str) -> Column:
    """:func:`snippet_of` on the JVM; equal to it where lower-casing keeps a text's length."""
    if not keyword.strip():
        return F.lit(None).cast("string")
    lines = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    found = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(keyword.lower()))), True).cast("int")
    context = F.array_join(F.slice(lines, F.greatest(found - 1, F.lit(1)), F.when(found > 1, 3).otherwise(2)), "\n")
    marked = F.regexp_replace(context, F.lit(f"(?iu)({quoted(keyword)})"), F.lit("<mark>$1</mark>"))
    return F.when(found > 0, marked)
