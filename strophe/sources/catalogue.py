"""A catalogue on Parquet as a base with small deltas behind a log of states, and its incremental update."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.songindex import SongIndex, SongSegment, write_songs
from ..operators.textindex import Segment, TextIndex, merge_segments, write_segment
from ..schema import CATALOGUE
from . import files, index
from .archive import read_archive
from .ttml import build_catalogue

log = logging.getLogger(__name__)

INCREMENTAL_LIMIT = 500
#: Deltas from which they are merged, with the base if they hold more than one row in so many of it; rows up to which a delta is broadcast.
DELTAS, BASE_SHARE, DELTA_ROWS = 16, 8, 20_000
#: States whose folders are kept for readers, and seconds for which a lease or the claim on a new folder holds unless it is renewed.
KEPT_STATES, LEASE = 3, 3600
#: Seconds for which the files of old states stay, far longer than a writer takes from reading a state to publishing the next.
LOG_SECONDS = 86_400


class Busy(RuntimeError):
    """Another sync runs."""


class Fenced(RuntimeError):
    """The lease under which a writer began, or its claim on a folder, is no longer its own; nothing was changed."""


class _Changed(Exception):
    """The rows that a change was prepared on are no longer the newest."""


def _empty() -> dict:
    return {"base": None, "deltas": [], "meta": {}, "batches": {}, "lease": {"number": 0, "until": 0}, "claims": {}}


class Catalogue:
    """``root/log`` holds numbered states: the base, the deltas over it in order, with their index segments, and key-value marks.

    Folders and states are never changed once written. A state is written under another name and published as the
    next number only if that is free, so it is whole when it is seen, and of two writers one builds its change anew on
    the other's state. Readers keep the folders they opened as long as these belong to one of the last states.

    A catalogue with a ``lease`` commits only while that is the newest lease; see :meth:`single_flight`. ``kinds`` are the
    postings that are kept, of texts and of songs; all writers of a catalogue must name the same.
    """

    def __init__(self, spark: SparkSession, root: str, lease: int | None = None, kinds: tuple[str, ...] = ("texts", "songs")):
        self.spark, self.root, self.lease, self.kinds = spark, root.rstrip("/"), lease, kinds

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _publish(self, name: str, text: str) -> bool:
        """Put a whole file under a name unless that is taken; whether it was put."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, path = self._path(name)
        _, draft = self._path(f"drafts/{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        fs.mkdirs(draft.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # renaming would replace a file there; a second link to the draft does not
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, path, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(draft, False)
        return True

    def _numbers(self) -> list[int]:
        fs, path = self._path("log")
        if not fs.exists(path):
            return []
        return sorted((int(n.split(".")[0]) for n in (x.getPath().getName() for x in fs.listStatus(path)) if n.endswith(".json") and not n.startswith(".")), reverse=True)

    def _read(self, number: int) -> dict:
        fs, path = self._path(f"log/{number:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _newest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        return (numbers[0], self._read(numbers[0])) if numbers else (0, _empty())

    def _state(self) -> dict:
        return self._newest()[1]

    def _update(self, change: Callable[[dict], dict | None]) -> dict:
        """Publish the next state, made by ``change`` of the newest one, again and again until none came between; None changes nothing."""
        while True:
            number, state = self._newest()
            if self.lease is not None and state["lease"]["number"] != self.lease:
                raise Fenced("another sync has taken over")
            new = change(json.loads(json.dumps(state)))
            if new is None:
                return state
            if self._publish(f"log/{number + 1:012d}.json", json.dumps(new)):
                break
        for n in self._numbers()[4 * KEPT_STATES :]:
            fs, path = self._path(f"log/{n:012d}.json")
            if fs.exists(path) and fs.getFileStatus(path).getModificationTime() < 1000 * (time.time() - LOG_SECONDS):
                fs.delete(path, False)
        return new

    def _sweep(self) -> None:
        """Delete the folders that neither the last states nor a claim names; claims that ran out go first, so that they can't be used."""

        def lapse(state: dict) -> dict | None:
            held = {k: t for k, t in state["claims"].items() if t > time.time()}
            return {**state, "claims": held} if held != state["claims"] else None

        claims = self._update(lapse)["claims"]
        known = [self._read(n) for n in self._numbers()[:KEPT_STATES]]
        named = {e["folder"] for s in known for e in (s["base"], *s["deltas"]) if e} | set(claims)
        for kind in ("data", "index"):
            fs, path = self._path(kind)
            for x in fs.listStatus(path) if fs.exists(path) else ():
                if x.getPath().getName().split("-")[0] not in named and x.getModificationTime() < 1000 * (time.time() - LEASE):
                    fs.delete(x.getPath(), True)

    @contextmanager
    def _renewed(self, renew: Callable[[], None]):
        """Calls ``renew`` three times a LEASE while the body runs."""
        done = threading.Event()

        def run():
            while not done.wait(max(0.05, LEASE / 3)):
                try:
                    renew()
                except Exception:
                    log.exception("not renewed")

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    @contextmanager
    def _claimed(self):
        """The name of a new folder, which no sweep deletes while the body runs."""
        folder = uuid.uuid4().hex

        def claim(state: dict) -> dict:
            return {**state, "claims": {**state["claims"], folder: time.time() + LEASE}}

        self._update(claim)
        with self._renewed(lambda: self._update(lambda s: claim(s) if folder in s["claims"] else None)):
            yield folder

    def meta(self, key: str) -> str | None:
        return self._state()["meta"].get(key)

    def set_meta(self, key: str, value: str) -> None:
        self._update(lambda s: {**s, "meta": {**s["meta"], key: value}})

    def batch(self, stream: str) -> int | None:
        """Number of the last batch of a stream that was taken in."""
        return self._state()["batches"].get(stream)

    def _load(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(CATALOGUE).parquet(f"{self.root}/data/{entry['folder']}")

    def _over(self, older: DataFrame | None, entry: dict) -> DataFrame:
        new = self._load(entry)
        if older is None:
            return new
        names = new.select("filename")
        names = F.broadcast(names) if entry["rows"] <= DELTA_ROWS else names
        return older.join(names, "filename", "left_anti").select(*CATALOGUE.names).unionByName(new)

    def read(self, state: dict | None = None) -> DataFrame:
        """The newest row of each file name."""
        state, deltas = state or self._state(), None
        for d in state["deltas"]:
            deltas = self._over(deltas, d)
        if deltas is None:
            return self._load(state["base"]) if state["base"] else self.spark.createDataFrame([], CATALOGUE)
        if state["base"] is None:
            return deltas
        names, few = deltas.select("filename"), sum(d["rows"] for d in state["deltas"]) <= DELTA_ROWS
        return self._load(state["base"]).join(F.broadcast(names) if few else names, "filename", "left_anti").select(*CATALOGUE.names).unionByName(deltas)

    def count(self) -> int:
        """Songs, as the states add them up."""
        return self.text_index().docs

    def text_index(self, state: dict | None = None) -> TextIndex:
        """The segments of the base and the deltas, as of the newest state."""
        state = state or self._state()
        entries = [e for e in (state["base"], *state["deltas"]) if e]
        segments = tuple(Segment(f"{self.root}/index/{e['segment'][0]}", *e["segment"][1:]) for e in entries)
        return TextIndex(segments, *(sum(s[k] - e["replaced"][i] for s, e in zip(segments, entries, strict=True)) for i, k in enumerate((2, 3))))

    def song_index(self, state: dict | None = None) -> SongIndex:
        """Postings of ids, authors and names of the base and the deltas, as of the newest state."""
        state = state or self._state()
        entries = [e for e in (state["base"], *state["deltas"]) if e]
        if not all(e["songs"] for e in entries):
            raise ValueError("the catalogue keeps no postings of songs")
        return SongIndex(tuple(SongSegment(f"{self.root}/index/{e['songs'][0]}", *e["songs"][1:]) for e in entries))

    def _entry(self, folder: str, written: DataFrame, segment: Segment, replaced: tuple[int, int]) -> dict:
        songs = write_songs(written, f"{self.root}/index/{folder}-songs") if "songs" in self.kinds else None
        name = lambda s: s and [s.path.removeprefix(f"{self.root}/index/"), *s[1:]]
        return {"folder": folder, "rows": segment.docs, "segment": name(segment), "songs": name(songs), "replaced": list(replaced)}

    def _write(self, rows: DataFrame, folder: str) -> DataFrame:
        path = f"{self.root}/data/{folder}"
        rows.select(*CATALOGUE.names).write.parquet(path)
        return self.spark.read.schema(CATALOGUE).parquet(path)

    def _replaced(self, state: dict, written: DataFrame) -> tuple[int, int]:
        """How many songs of a state the written rows replace, and these songs' trigrams."""
        ids, n = written.select(F.col("id").alias("new_id")), written.count()
        ids, whole, at = F.broadcast(ids) if n <= DELTA_ROWS else ids, self.text_index(state), []
        for number, s in enumerate(whole.segments):
            docs, newer = self.spark.read.schema("id long, d long").parquet(f"{s.path}/docs"), whole._newer(self.spark, number)
            at.append(docs if newer is None else docs.join(newer, F.col("id") == F.col("gone"), "left_anti"))
        if not at:
            return 0, 0
        docs = at[0]
        for x in at[1:]:
            docs = docs.unionByName(x)
        r = docs.join(ids, F.col("id") == F.col("new_id"), "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("total")).first()
        return r["n"], r["total"]

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows; a file name that exists gets the new row's values but keeps its id. Whether this changed the catalogue.

        Of rows for one file name the newest counts, of these the one with the largest id. Only the rows and their
        index segment are written; what is there is read for its names, ids and lengths, and whole only when deltas are merged.
        ``batch`` names a stream and its batch: the state that takes the rows records it, and a batch that was
        recorded, or an older one, changes nothing. If another writer adds one of the file names meanwhile, the rows are
        prepared anew on its state.
        """
        rows = rows.groupBy("filename").agg(F.max_by(F.struct(*CATALOGUE.names), F.struct("timestamp", "id")).alias("r")).select("r.*")
        while True:
            seen = self._state()
            if batch is not None and seen["batches"].get(batch[0], -1) >= batch[1]:
                return False
            with self._claimed() as folder:
                ids = self.read(seen).select("filename", F.col("id").alias("old_id"))
                written = self._write(rows.join(ids, "filename", "left").withColumn("id", F.coalesce("old_id", "id")), folder)
                segment = write_segment(written, f"{self.root}/index/{folder}-text", "texts" in self.kinds)
                entry = self._entry(folder, written, segment, self._replaced(seen, written))
                try:
                    state = self._update(lambda s: self._with_delta(s, seen, entry, written, batch))
                except _Changed:
                    continue
            break
        deltas = state["deltas"]
        if len(deltas) > DELTAS:
            self.compact(whole=state["base"] is None or sum(d["rows"] for d in deltas) * BASE_SHARE > state["base"]["rows"])
        return any(d["folder"] == entry["folder"] for d in deltas) or (state["base"] or {}).get("folder") == entry["folder"]

    def _with_delta(self, state: dict, seen: dict, entry: dict, written: DataFrame, batch: tuple[str, int] | None) -> dict | None:
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return None
        if entry["folder"] not in state["claims"]:
            raise Fenced("the claim on the new rows has run out")
        folders = {d["folder"] for d in seen["deltas"]}
        if state["base"] != seen["base"] or not folders <= {d["folder"] for d in state["deltas"]}:
            raise _Changed
        for d in state["deltas"]:
            if d["folder"] not in folders and not self._load(d).select("filename").join(written.select("filename"), "filename", "left_semi").isEmpty():
                raise _Changed
        state["claims"].pop(entry["folder"])
        if batch is not None:
            state["batches"][batch[0]] = batch[1]
        if state["base"] is None and not state["deltas"]:
            return {**state, "base": entry}
        return {**state, "deltas": [*state["deltas"], entry]}

    def compact(self, whole: bool = True) -> None:
        """Merge the deltas into a new base or, unless ``whole``, into one delta. Index segments are merged as postings."""
        seen = self._state()
        if not seen["deltas"]:
            return
        part = seen if whole else {**seen, "base": None}
        with self._claimed() as folder:
            written = self._write(self.read(part), folder)
            merged = self.text_index(part)
            segment = merge_segments(self.spark, merged, f"{self.root}/index/{folder}-text")
            docs, length = (sum(d["segment"][k] - d["replaced"][i] for d in seen["deltas"]) for i, k in enumerate((2, 3)))
            entry = self._entry(folder, written, segment, (0, 0) if whole else (segment.docs - docs, segment.length - length))
            gone = [d["folder"] for d in seen["deltas"]]

            def swap(state: dict) -> dict | None:
                if state["base"] != seen["base"] or [d["folder"] for d in state["deltas"]][: len(gone)] != gone:
                    return None  # another merge came first
                if folder not in state["claims"]:
                    raise Fenced("the claim on the merged rows has run out")
                state["claims"].pop(folder)
                rest = state["deltas"][len(gone) :]
                return {**state, "base": entry, "deltas": rest} if whole else {**state, "deltas": [entry, *rest]}

            self._update(swap)
        self._sweep()

    @contextmanager
    def single_flight(self):
        """The catalogue under a lease of its own, for a sync; :class:`Busy` if another holds one. Nobody waits.

        The lease has a number and is renewed while the body runs. One that ran out, because its holder died or was
        cut off, is passed to the next with a larger number; what the old holder commits after that is refused.
        """
        number = 0

        def acquire(state: dict) -> dict:
            nonlocal number
            if state["lease"]["until"] > time.time():
                raise Busy
            number = state["lease"]["number"] + 1
            return {**state, "lease": {"number": number, "until": time.time() + LEASE}}

        self._update(acquire)

        def held(until: float) -> None:
            self._update(lambda s: {**s, "lease": {"number": number, "until": until}} if s["lease"]["number"] == number else None)

        try:
            with self._renewed(lambda: held(time.time() + LEASE)):
                yield Catalogue(self.spark, self.root, number, self.kinds)
        finally:
            held(0)


@dataclass(frozen=True)
class SyncResult:
    status: str  # Skipped or Updated
    count: int
    strategy: str


def sync_once(
    catalogue: Catalogue, remote: DataFrame, commit: str | None = None, archive: str | None = None, fetch=None, limit: int = INCREMENTAL_LIMIT,
    version: Callable[[], str | None] | None = None, batch: tuple[str, int] | None = None,
) -> SyncResult:
    """Bring new files of a remote index into the catalogue.

    Nothing happens if another sync runs, or if ``commit``, or what ``version`` says, is the stored one; a
    version that can't be had does not stop the sync. A catalogue that is empty, or more than ``limit`` new
    files, takes the zip ``archive``; else files come one by one through ``fetch``, and from the archive if
    that fails. The index's metadata overlays the files' own. Files that can't be read are skipped, and
    rows that vanished upstream stay. ``batch`` names a stream and its batch, which is taken in once; a batch that was
    is skipped without a look at its rows.
    """
    last = None if batch is None else catalogue.batch(batch[0])
    if last is not None and last >= batch[1]:
        return SyncResult("Skipped", 0, "batch")
    if commit is None and version is not None:
        try:
            commit = version()
        except Exception:
            log.exception("no remote version; going on without")
    try:
        with catalogue.single_flight() as leased:
            return _sync(leased, remote, commit, archive, fetch, limit, batch)
    except Busy:
        return SyncResult("Skipped", 0, "busy")


def _sync(catalogue: Catalogue, remote: DataFrame, commit, archive, fetch, limit, batch) -> SyncResult:
    if commit is not None and catalogue.meta("commit") == commit:
        return SyncResult("Skipped", 0, "none")
    local = catalogue.read()
    wanted = index.missing(remote, local).persist()
    try:
        n = wanted.count()
        full = local.isEmpty() or n > limit or fetch is None
        if n == 0:
            result = SyncResult("Skipped", 0, "full" if full else "incremental")
        elif full:
            if archive is None:
                raise ValueError("a full sync needs an archive")
            found = read_archive(catalogue.spark, archive).join(wanted, "filename", "left_semi")
            result = _store(catalogue, found, remote, "full", batch)
        else:
            try:
                result = _store(catalogue, files.fetch_files(wanted, fetch), remote, "incremental", batch)
            except Exception:
                if archive is None:
                    raise
                result = _store(catalogue, read_archive(catalogue.spark, archive).join(wanted, "filename", "left_semi"), remote, "full", batch)
    finally:
        wanted.unpersist()
    if commit is not None:
        catalogue.set_meta("commit", commit)
    if batch is not None:  # a batch without new rows is done too
        catalogue._update(lambda s: {**s, "batches": {**s["batches"], batch[0]: batch[1]}} if s["batches"].get(batch[0], -1) < batch[1] else None)
    return result


def _store(catalogue: Catalogue, found: DataFrame, remote: DataFrame, strategy: str, batch) -> SyncResult:
    rows = index.overlay(build_catalogue(found), remote).persist()
    try:
        n = rows.count()
        if n:
            catalogue.upsert(rows, batch)
        return SyncResult("Skipped" if not n and strategy == "full" else "Updated", n, strategy)
    finally:
        rows.unpersist()
