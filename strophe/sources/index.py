"""Index lines: one JSON object a line with a file name and a list of metadata pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata keys and the catalogue column that each overlays.
OVERLAY_KEYS = {
    "ncmMusicId": "ncm_music_ids", "qqMusicId": "qq_music_ids", "appleMusicId": "apple_music_ids", "spotifyId": "spotify_ids",
    "isrc": "isrcs", "ttmlAuthorGithub": "author_ids", "ttmlAuthorGithubLogin": "author_usernames",
}


def parse_lines(lines: DataFrame) -> DataFrame:
    """``filename, metadata`` of ``value, seq`` rows; of lines for one file the one with the largest seq.

    Blank and malformed lines are skipped: those that are not an object with a string and a list of
    (string, list of strings) pairs. Pairs are read as arrays of raw JSON values, for their two parts
    differ in type.
    """
    raw = lines.select("seq", F.trim("value").alias("line")).filter(F.col("line") != "")
    top = F.from_json("line", "rawLyricFile string, metadata array<array<string>>")
    rows = raw.select("seq", top.alias("r")).filter("r.rawLyricFile is not null and r.metadata is not null")
    pairs = F.transform("r.metadata", lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), F.from_json(F.get(p, F.lit(1)), "array<string>").alias("values"), F.size(p).alias("n")))
    ok = F.forall("pairs", lambda p: (p["n"] == 2) & p["key"].isNotNull() & p["values"].isNotNull())
    good = rows.select("seq", F.col("r.rawLyricFile").alias("filename"), pairs.alias("pairs")).filter(ok)
    kept = F.transform("pairs", lambda p: F.struct(p["key"].alias("key"), p["values"].alias("values")))
    return good.groupBy("filename").agg(F.max_by(kept, "seq").alias("metadata"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index at a path. A line's place is its file and its position among the file's lines.

    ``monotonically_increasing_id`` follows the order of splits, so later lines of a file get larger
    numbers.
    """
    return parse_lines(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))


def values_of(metadata: Column, key: str) -> Column:
    """Values of all pairs with a key, in order."""
    return F.flatten(F.transform(F.filter(metadata, lambda p: p["key"] == key), lambda p: p["values"]))


def overlay(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with the index's values where these are not empty; rows without an entry stay."""
    joined = rows.join(index.select("filename", F.col("metadata").alias("__metadata")), "filename", "left")
    out = {}
    for key, column in OVERLAY_KEYS.items():
        if column in rows.columns:
            new = values_of(F.col("__metadata"), key)
            out[column] = F.when(F.size(F.coalesce(new, F.array().cast("array<string>"))) > 0, new).otherwise(F.col(column))
    return joined.withColumns(out).select(*rows.columns)


def missing(index: DataFrame, local: DataFrame) -> DataFrame:
    """File names of the index that the catalogue lacks."""
    return index.select("filename").join(local.select("filename"), "filename", "left_anti")
