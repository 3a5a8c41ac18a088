"""Stored postings of songs by platform ids, authors and pieces of names, as compressed sets of song numbers.

A segment covers some rows of a catalogue and never changes. Its songs have numbers: a block by a hash of the id, and a
place of at most 15 bits in the block. A posting ``kind, value, block`` holds the places of the songs that have the
value: as a short array, or, where they are many, as a bitmap. Postings lie in folders by a checksum of
(kind, value), as many as the segment's size asks for, sorted, so a lookup reads one folder for each value it wants.

Values are platform ids and author keys as they are, and of names every piece of one to three characters and
both ends. A name that contains a word has all pieces of the word; both ends of a name that lies within a text are
pieces of the text. So songs that a search by names could find are told from the pieces, and the exact test runs on these alone.
"""

from __future__ import annotations

import json
import uuid
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold
from ..schema import POSTING_COLUMNS

#: Songs of a block on average (a place has 15 bits), places from which a posting is a bitmap, postings of a folder, folders at most.
BLOCK, DENSE, FOLDER, FOLDERS = 1 << 14, 512, 1 << 20, 4096
#: Characters of a piece and of an end, characters and words of a query that is looked up by pieces (beyond, songs are scanned), and
#: replaced songs up to which they are broadcast.
PIECE, END, CHARS, WORDS, SMALL = 3, 8, 200, 12, 100_000
NAMES = ("track", "artist", "album")
_SCHEMA = "kind string, value string, block int, places array<int>, bits binary, bucket int"


class SongSegment(NamedTuple):
    """Folder of a segment, its number of posting folders and its songs."""

    path: str
    buckets: int
    songs: int


def _pieces(name: Column) -> Column:
    """Every piece of one to three characters."""
    n = F.char_length(name)

    def of(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substr(name, i, F.lit(k)))

    return F.flatten(F.array(*map(of, range(1, PIECE + 1))))


def entries() -> Column:
    """(kind, value) of a song: ids and authors, pieces of normalised names by field, of raw names of any field, and beginnings of raw names."""

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    raw = F.transform(F.concat(*[F.col(f"{k}_names") for k in NAMES]), ascii_fold)
    out = [tagged(c, F.col(c)) for c in POSTING_COLUMNS]
    out += [tagged(f"in:{k}", F.flatten(F.transform(F.transform(f"normalized_{k}_names", ascii_fold), _pieces))) for k in NAMES]
    out.append(tagged("in", F.flatten(F.transform(raw, _pieces))))
    out += [tagged(f"begin:{k}", F.transform(f"{k}_names", lambda n: F.left(ascii_fold(n), F.lit(END)))) for k in NAMES]
    out += [tagged(f"end:{k}", F.transform(f"{k}_names", lambda n: F.right(ascii_fold(n), F.lit(END)))) for k in NAMES]
    return F.flatten(F.array(*out))


def _bucket(kind: Column, value: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(F.concat(kind, F.lit("\n"), value), "UTF-8")) % buckets).cast("int")


def bucket_of(kind: str, value: str, buckets: int) -> int:
    return zlib.crc32(f"{kind}\n{value}".encode()) % buckets


def write_songs(songs: DataFrame, root: str) -> SongSegment:
    """The segment of catalogue rows, in a new folder below ``root``."""
    spark, path = songs.sparkSession, f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    n = songs.count()
    blocks = -(-n // BLOCK) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    songs.select("id", block.alias("block")).withColumn("place", place).write.parquet(f"{path}/songs")
    numbers = spark.read.schema("id long, block int, place int").parquet(f"{path}/songs")
    values = songs.join(numbers, "id").select("block", "place", F.inline(entries())).filter("value is not null")
    found = values.groupBy("kind", "value", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))  # a block has under 2**15 songs
    found.write.parquet(f"{path}/found")
    found = spark.read.parquet(f"{path}/found")
    buckets = min(FOLDERS, 1 << max(0, -(-found.count() // FOLDER) - 1).bit_length())
    dense = found.filter(F.size("places") >= DENSE).select("kind", "value", "block", F.explode("places").alias("place"))
    dense = dense.groupBy("kind", "value", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
    sparse = found.filter(F.size("places") < DENSE)
    rows = sparse.select("kind", "value", "block", "places", F.lit(None).cast("binary").alias("bits"))
    rows = rows.unionByName(dense.select("kind", "value", "block", F.lit(None).cast("array<int>").alias("places"), "bits"))
    rows = rows.withColumn("bucket", _bucket(F.col("kind"), F.col("value"), buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "value", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/found")
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)  # the postings hold it all
    return SongSegment(path, buckets, n)


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1


def places_of(bits: Column) -> Column:
    """Places of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), 8 * F.octet_length(bits) - 1), lambda p: _bit(bits, p))


def _listed(values) -> str:
    """Values as SQL literals: one expression for all, for a call for each would take longer than the lookup."""
    return ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _pieces_of(text: str, sizes) -> list[str]:
    return list(dict.fromkeys(text[i : i + k] for k in sizes for i in range(len(text) - k + 1)))


def _cover(word: str) -> list[str]:
    """Pieces that together cover a word, the longest there are."""
    k = min(PIECE, len(word))
    return list(dict.fromkeys(word[i : i + k] for i in [*range(0, len(word) - k, k), len(word) - k]))


def _folded(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class SongIndex(NamedTuple):
    """Segments from old to new; a song in a newer one replaces the song of that id in older ones."""

    segments: tuple[SongSegment, ...]

    def _postings(self, spark: SparkSession, number: int, wanted: list[tuple[str, str]]) -> DataFrame:
        """The postings of some values in a segment; only their folders are read."""
        s = self.segments[number]
        kinds: dict[str, list[str]] = {}
        for k, v in wanted:
            kinds.setdefault(k, []).append(v)
        hit = " or ".join(f"(kind = '{k}' and value in ({_listed(vs)}))" for k, vs in kinds.items())
        folders, values = sorted({bucket_of(k, v, s.buckets) for k, v in wanted}), sorted({v for _, v in wanted})
        return spark.read.schema(_SCHEMA).parquet(f"{s.path}/postings").filter(f"bucket in ({_listed(folders)}) and value in ({_listed(values)}) and ({hit})")

    def _ids(self, spark: SparkSession, number: int, places: DataFrame) -> DataFrame:
        """Ids of ``block, places`` rows, without songs that newer segments replace."""
        s = self.segments[number]
        songs = spark.read.schema("id long, block int, place int").parquet(f"{s.path}/songs")
        out = places.select("block", F.explode("places").alias("place")).join(songs, ["block", "place"]).select("id")
        later = [x for x in self.segments[number + 1 :] if x.songs]
        gone = None
        for x in later:
            mine = spark.read.schema("id long").parquet(f"{x.path}/songs")
            gone = mine if gone is None else gone.unionByName(mine)
        if gone is None:
            return out
        return out.join(F.broadcast(gone) if sum(x.songs for x in later) <= SMALL else gone, "id", "left_anti")

    def _union(self, spark: SparkSession, of) -> DataFrame:
        out = spark.createDataFrame([], "id long")
        for number, s in enumerate(self.segments):
            if s.songs:
                out = out.unionByName(self._ids(spark, number, of(number)))
        return out

    def with_all(self, spark: SparkSession, wanted: dict[str, list[str]]) -> DataFrame:
        """``id`` of the songs that have every wanted value; none if nothing is wanted.

        In each block that has them all, bitmaps are ANDed, short arrays intersected, and what both leave is looked up.
        """
        pairs = [(k, v) for k, vs in wanted.items() for v in dict.fromkeys(vs)]
        if not pairs:
            return spark.createDataFrame([], "id long")

        def of(number: int) -> DataFrame:
            rows = self._postings(spark, number, pairs)
            per = rows.groupBy("block").agg(
                F.count(F.lit(1)).alias("n"), F.collect_list("places").alias("lists"), F.count("bits").alias("maps"), F.bitmap_and_agg("bits").alias("both"),
            ).filter(F.col("n") == len(pairs))
            few = F.aggregate(F.slice("lists", 2, len(pairs)), F.get("lists", F.lit(0)), F.array_intersect)
            few = F.when(F.col("maps") > 0, F.filter(few, lambda p: _bit(F.col("both"), p))).otherwise(few)
            return per.select("block", F.when(F.size("lists") > 0, few).otherwise(places_of(F.col("both"))).alias("places"))

        return self._union(spark, of)

    def candidates(self, spark: SparkSession, q: str | None, fields: dict[str, str | None]) -> DataFrame | None:
        """``id`` of the songs that a search by names (normalised) could find, some more; None if pieces can't tell.

        ``q`` is a keyword of the rough filter, ``fields`` are track, artist and album names.
        """
        asked = [v for v in (q, *fields.values()) if v]
        if sum(map(len, asked)) > CHARS or (q is not None and len(q.split()) > WORDS):
            return None
        wanted: set[tuple[str, str]] = set()

        def keys(kind: str, values: list[str]) -> Column:
            wanted.update((kind, v) for v in values)
            return F.from_json(F.lit(json.dumps([f"{kind}\n{v}" for v in values])), "array<string>")

        def places(key: Column) -> Column:
            return F.coalesce(F.element_at("sets", key), F.array().cast("array<int>"))

        def every(kind: str, values: list[str]) -> Column:
            wanted.add((kind, values[0]))
            return F.aggregate(keys(kind, values[1:]), places(F.lit(f"{kind}\n{values[0]}")), lambda have, k: F.array_intersect(have, places(k)))

        def some(kind: str, values: list[str]) -> Column:
            return F.array_distinct(F.flatten(F.transform(keys(kind, values), places)))

        def within(field: str, text: str) -> Column:
            ends = ["", *_pieces_of(text, range(1, END + 1))]
            return F.array_intersect(some(f"begin:{field}", ends), some(f"end:{field}", ends))

        parts = [every(f"in:{k}", _cover(_folded(v))) for k, v in fields.items() if v]
        if q is not None and q.split():
            text = _folded(q)
            met = None
            for w in dict.fromkeys(text.split()):
                near = F.array_union(every("in", _cover(w)), F.array_distinct(F.flatten(F.array(*[within(k, w) for k in NAMES]))))
                met = near if met is None else F.array_intersect(met, near)
            parts.append(F.array_union(met, F.array_intersect(within("track", text), within("artist", text))))
        if not parts:
            return None
        whole = parts[0]
        for x in parts[1:]:
            whole = F.array_intersect(whole, x)

        def of(number: int) -> DataFrame:
            rows = self._postings(spark, number, sorted(wanted)).withColumn("places", F.when(F.col("bits").isNull(), F.col("places")).otherwise(places_of(F.col("bits"))))
            sets = F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\n"), "value"), "places"))).alias("sets")
            return rows.groupBy("block").agg(sets).select("block", whole.alias("places"))

        return self._union(spark, of)
