"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints are made in Arrow batches, whole texts in slices. Equal fingerprints are one node. The index
holds every node under several lead keys, and rows are dealt to tasks by lead key. A task sorts its rows by
the Gray ranks of lead key and fingerprint and builds a tree over all of them: a tree node keeps the bits of
both that its members share, less those its parent already holds. A search carries all queries down the tree
together, adds up their differences to the shared patterns, and drops a whole group once a lead bit differs,
once more fingerprint bits differ than the limit allows, or once the group lies in the query's component
already. Every link comes from this search.

``near_duplicates`` links fingerprints within a limit of L bits. Its lead keys are the L + 1 blocks of the
fingerprint: two fingerprints within the limit agree in at least one. Lead keys with over ``HOT`` nodes are
cut once more by the same argument over parts of the other bits, so no link is lost.

``near_copies`` finds texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which
differ in about ten of 64 bits, too many for blocks. There the lead keys are bands of minima of the shingle
hashes; two texts at 0.8 share a band with a probability of 0.99997. The sets of shingle hashes travel to the index
with the rows, once for each group of texts that share bands. The search goes through the tree at growing
distances, at last without a limit, and each pair that it finds is settled at once with the sets: only pairs that are alike
join their components, so what is rejected hides nothing. Lead keys that many texts share are dealt into parts of which every two meet.

Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load, materialise, shuffle_width, sieved, unused, without

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Nodes under a lead key beyond which it is cut into finer ones.
HOT = 20_000
#: Members of a leaf, children of a node, queries that descend together, and the most pairs of query and node held at a time.
LEAF, FAN, CHUNK, FRONTIER = 16, 8, 2048, 1 << 20
#: Times a crowded lead key is cut in near_edges.
CUTS = 4
#: Rows of a task that are indexed together; a lead key is never cut.
SEGMENT = 1 << 17
#: near_copies: words of a shingle, least similarity, bands and their rows, distances at which fingerprints are joined, at last any.
COPY_SHINGLE, SIMILARITY, BANDS, ROWS, RADII = 5, 0.8, 20, 4, (0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 64)
#: near_copies: shingles of a text up to which its set is whole, beyond it a part by hash, of this size at least half; shingles
#: under a lead key beyond which it is dealt out.
SET, KEY_SHINGLES = 1 << 14, 1 << 23
#: Sets of up to so many shingles are exact in 32 bits; the margins around the threshold in which texts decide about others, by
#: standard deviations of a part and for chance equality of hashes.
EXACT, SIGMAS, CHANCE = 4096, 4, 0.002
#: Pairs that are settled together, and elements of sets that are looked up together.
SETTLED, LOOKUP = 1 << 16, 1 << 22
#: Bytes of a text whose words are held at a time.
SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def word_slices(raw: bytes):
    """Lists of the words, in order, of about SLICE bytes each."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + SLICE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def shingle_hashes(text: str | None, shingle: int):
    """Arrays of the XXH64 of the lower-cased text's shingles; of fewer words the whole sequence, of none nothing."""
    digest, tail, some = xxhash.xxh64_intdigest, [], False
    for words in word_slices((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        n = len(words)
        if n >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
            starts = np.concatenate(([0], ends[:-1] + 1))
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
            yield np.array(hashes, "<u8")
            some = True
        tail = words[max(0, n - shingle + 1) :]
    if tail and not some:
        yield np.array([digest(b" ".join(tail), SEED)], "<u8")


def majority(hashes) -> int:
    """Bits that more than half of the hashes, given in arrays, have."""
    total, m = np.zeros(64, np.int64), 0
    for raw in hashes:
        m += len(raw)
        for at in range(0, len(raw), 1 << 16):
            part = np.ascontiguousarray(raw[at : at + (1 << 16)])
            total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprint_batches(shingle):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_fingerprint_batches(shingle), f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges a-b of a minimum spanning forest between components; ``label`` is updated.

    Every component takes its lightest edge, and those joined so are one, until no edge is left.
    """
    taken = []
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    live = np.arange(len(a))
    while True:
        la, lb = label[a[live]], label[b[live]]
        live, la, lb = live[la != lb], la[la != lb], lb[la != lb]
        if not len(live):
            return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
        names, at = np.unique(np.concatenate((la, lb)), return_inverse=True)
        la, lb = at[: len(live)], at[len(live) :]
        best = np.full(len(names), len(live))
        np.minimum.at(best, la, np.arange(len(live)))
        np.minimum.at(best, lb, np.arange(len(live)))
        taken.append(live[np.unique(best)])
        to = np.where(la[best] == np.arange(len(names)), lb[best], la[best])
        mutual = to[to] == np.arange(len(names))
        to = np.where(mutual & (np.arange(len(names)) < to), np.arange(len(names)), to)
        while (to[to] != to).any():
            to = to[to]
        root = np.arange(len(label))
        root[names] = names[to]
        label[:] = root[label]


class GrayIndex:
    """Hierarchy over (lead key, fingerprint) rows in Gray order."""

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.order = np.lexsort((gray_rank(fps), gray_rank(keys)))
        self.keys, self.fps = keys[self.order], fps[self.order]
        n = len(fps)
        self.label = np.arange(n)
        starts = np.arange(0, n, LEAF)
        levels = [(starts, *[f.reduceat(x, starts) for x in (self.keys, self.fps) for f in (np.bitwise_or, np.bitwise_and)])]
        while len(levels[-1][0]) > 1:
            up = np.arange(0, len(levels[-1][0]), FAN)
            s, ko, ka, fo, fa = levels[-1]
            levels.append((s[up], np.bitwise_or.reduceat(ko, up), np.bitwise_and.reduceat(ka, up), np.bitwise_or.reduceat(fo, up), np.bitwise_and.reduceat(fa, up)))
        self.levels, above = [], (np.uint64(0), np.uint64(0))
        for s, ko, ka, fo, fa in reversed(levels):  # from the root down
            shared = ~(ko ^ ka), ~(fo ^ fa)
            own = [m & ~(np.repeat(p, FAN)[: len(m)] if np.ndim(p) else p) for m, p in zip(shared, above, strict=True)]
            self.levels.append((s, np.append(s[1:], n), ka & own[0], own[0], fa & own[1], own[1]))
            above = shared

    def _settled(self) -> list[np.ndarray]:
        """For each level the component that holds all of a group, or -1."""
        out = []
        for starts, *_ in self.levels:
            low, high = np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def join(self, limit: int, above: int = -1, settle=None) -> tuple[np.ndarray, np.ndarray]:
        """Edges (positions in the input) that join the components of rows with equal keys within ``limit`` bits.

        ``settle`` takes arrays of positions and says of each pair whether it is one; only these join components.
        Pairs that differ in no more than ``above`` bits have been settled before and are passed over.
        """
        n, out, most = len(self.fps), [], FRONTIER if settle is None else SETTLED
        settled, found, held = self._settled(), [], 0

        def merge():
            nonlocal settled, found, held
            if held:
                a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
                if settle is not None:
                    open_ = self.label[a] != self.label[b]
                    a, b, d = a[open_], b[open_], d[open_]
                    sure = settle(self.order[a], self.order[b])
                    a, b, d = a[sure], b[sure], d[sure]
                pick = forest(self.label, a, b, d)
                out.append((a[pick], b[pick]))
                settled, found, held = self._settled(), [], 0

        for lo in range(0, n, CHUNK):
            q = np.arange(lo, min(n, lo + CHUNK))
            todo = [(0, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64))]
            while todo:
                depth, q, node, diff = todo.pop()
                if depth == len(self.levels):
                    near = (node > q) & (self.keys[q] == self.keys[node])
                    q, node = q[near], node[near]
                    diff = np.bitwise_count(self.fps[q] ^ self.fps[node])
                    near = (diff <= limit) & (diff > above) & (self.label[q] != self.label[node])
                    found.append((q[near], node[near], diff[near]))
                    held += int(near.sum())
                    if held > most:
                        merge()
                    continue
                _, ends, key, key_own, fp, fp_own = self.levels[depth]
                live = (ends[node] > q + 1) & (settled[depth][node] != self.label[q])  # a pair is found from its earlier row
                live &= (self.keys[q] ^ key[node]) & key_own[node] == 0
                q, node, diff = q[live], node[live], diff[live]
                diff = diff + np.bitwise_count((self.fps[q] ^ fp[node]) & fp_own[node])
                live = diff <= limit
                q, node, diff = q[live], node[live], diff[live]
                last = depth == len(self.levels) - 1
                width, below = (LEAF, n) if last else (FAN, len(self.levels[depth + 1][0]))
                step = max(1, most // width)
                for at in range(0, len(q), step):
                    child = (node[at : at + step, None] * width + np.arange(width)).ravel()
                    ok = child < below
                    todo.append((depth + 1, np.repeat(q[at : at + step], width)[ok], child[ok], np.repeat(diff[at : at + step], width)[ok]))
            merge()
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return self.order[a], self.order[b]


def segments(batches, *names, heavy: str | None = None):
    """Arrays of the columns of whole lead keys (``route``), which arrive sorted, of about SEGMENT rows together.

    Of the column ``heavy``, which holds sets, no more than about KEY_SHINGLES elements come together.
    """
    held, rows, weight = [], 0, 0
    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", *names)]
        if not batch.num_rows:
            continue
        if rows >= SEGMENT or weight >= KEY_SHINGLES:
            cut = int(np.searchsorted(part[0] != held[-1][0][-1], True))  # rows of the key that is still open
            held.append([c[:cut] for c in part])
            rows += cut
            if cut == batch.num_rows:
                continue
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows, weight, part = [], 0, 0, [c[cut:] for c in part]
        held.append(part)
        rows += len(part[0])
        weight += sum(map(len, part[1 + names.index(heavy)])) // 4 if heavy else 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _link_batches(limit):
    def run(batches):
        for keys, fps in segments(batches, "fp"):
            index = GrayIndex(keys.view(np.uint64), fps.view(np.uint64))
            for radius in sorted({min(1, limit), min(2, limit), limit}):  # dense groups join early and are passed over later
                a, b = index.join(radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["u", "v"])

    return run


def _cuts(limit: int, levels: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (level, cut, part, next cut, bits): a cut has some bits settled, its parts take turns over the others."""
    whole = (1 << 64) - 1
    rows, open_cuts, number = [], [(0, whole)], 1
    for level in range(levels):
        below = []
        for cut, free in open_cuts:
            bits = [b for b in range(64) if free >> b & 1]
            for part in range(limit + 1):
                own = sum(1 << b for b in (bits[len(bits) * part // (limit + 1) : len(bits) * (part + 1) // (limit + 1)] if level == 0 else bits[part :: limit + 1]))
                rows.append((level, cut, part, number, own - (1 << 64) if own >> 63 else own))
                below.append((number, free & ~own))
                number += 1
        open_cuts = below
    return rows


def near_edges(nodes: DataFrame, limit: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Edges ``u, v`` whose components are those of all fingerprint pairs within ``limit`` bits.

    Of the limit + 1 parts of the bits two such fingerprints agree in one, whatever bits they are known to
    share before, so a lead key that holds over ``hot`` nodes is cut again, up to CUTS times. What shares a
    key after that differs only in the bits never used (21 of 64 for a limit of 4).
    """
    if not 0 <= limit < 64:
        raise ValueError("a fingerprint has 64 bits")
    spark = nodes.sparkSession
    # Each cut multiplies the table by limit + 1, and each needs limit + 1 free bits.
    levels = max(n for n in range(1, CUTS + 1) if n == 1 or ((limit + 1) ** n <= 4096 and n * (limit + 1) <= 48))
    cuts = _cuts(limit, levels)
    first = F.array(*[F.struct(F.lit(0).cast("long").alias("route"), *[F.lit(x).cast(k).alias(c) for c, k, x in zip(("part", "next_cut", "bits"), ("int", "int", "long"), r[2:])]) for r in cuts if r[0] == 0])
    rows, done = nodes.select("fp", F.inline(first)), None
    for level in range(levels):
        if level:
            step = spark.createDataFrame([r[1:] for r in cuts if r[0] == level], "cut int, part int, next_cut int, bits long")
            rows = rows.join(F.broadcast(step), "cut")
        rows = rows.select("fp", F.col("next_cut").alias("cut"), F.xxhash64("route", "part", F.col("fp").bitwiseAND(F.col("bits"))).alias("route"))
        crowded = materialise(rows.groupBy("route").count().filter(F.col("count") > hot).select("route"), "crowded") if level + 1 < levels else None
        if crowded is None or crowded.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        rest = rows.join(crowded, "route", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = materialise(rows.join(crowded, "route", "left_semi"), "crowded-rows")
    return _by_route(done.select("fp", "route"), "fp").mapInArrow(_link_batches(limit), "u long, v long").distinct()


def _by_route(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "route").sortWithinPartitions("route", *columns).select("route", *columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of an edge; root is the smallest node of its component.

    Alternates large-star and small-star until the edges no longer change; each round is written to the
    shared folder. Rounds grow with the logarithm of a component; an error is raised if they don't suffice.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(pairs: DataFrame):
        r = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = mark(edges)
    for _ in range(rounds if seen[0] else 0):
        edges = materialise(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    A null text, or one without a word, has fingerprint zero and links like any other. Repeated rows and
    ties share a fingerprint, hence a component. component_id is the smallest doc_id of the component,
    null only if all its doc_ids are. Other columns are ignored; an empty table gives an empty result. A
    chain of links so long that ``components`` does not settle in 60 rounds raises an error.
    """
    fps = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_edges(nodes.select("fp"), limit, hot)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def minima(hashes: np.ndarray, count: int) -> np.ndarray:
    """The least value of each of ``count`` permutations of the hashes."""
    rng = np.random.default_rng(SEED)
    flip, times = rng.integers(0, 1 << 63, (2, count), np.uint64)
    times |= np.uint64(1)
    out = np.full(count, ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        x = (hashes[at : at + 4096, None] ^ flip) * times
        x ^= x >> np.uint64(32)
        out = np.minimum(out, (x * times).min(0))
    return out


def _sketch_batches(shingle, bands, rows):
    def run(batches):
        for b in batches:
            fps, sizes, keys = [], [], []
            for t in b.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                fps.append(majority([hashes]))
                sizes.append(len(hashes))
                low = minima(hashes, bands * rows).reshape(bands, rows)
                keys.append([xxhash.xxh3_64_intdigest(low[i].tobytes(), i) for i in range(bands)])
            fps = np.array(fps, np.uint64).view(np.int64)
            keys = np.array(keys, np.uint64).view(np.int64).reshape(len(fps), bands)
            at = np.repeat(np.arange(len(fps)), bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("node").take(pa.array(at)), pa.array(fps[at]), pa.array(np.array(sizes, np.int64)[at]), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(fps))), pa.array(keys.ravel())],
                names=["node", "fp", "size", "band", "route"],
            )

    return run


def level_of(size: int) -> int:
    """Low bits that are zero in the hashes that stand for a set of this size; 0 takes them all."""
    return max(0, -(-size // SET) - 1).bit_length()


def part_of(hashes: np.ndarray) -> np.ndarray:
    """What travels of a set: the low halves of its hashes, of a large set of those that the hash picks."""
    low = hashes.astype(np.uint32)
    return np.unique(low[low & ((1 << level_of(len(hashes))) - 1) == 0])


def _set_batches(shingle):
    def run(batches):
        for b in batches:
            parts = [part_of(shingle_set(t.as_py(), shingle)).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(parts, pa.binary())], names=["set_node", "part"])

    return run


class SetTest:
    """Settles pairs of sets, given by what travels of them and their sizes."""

    def __init__(self, parts, sizes: np.ndarray, least: float):
        self.least, self.sizes = least, sizes
        values = [np.frombuffer(p, np.uint32) for p in parts]
        self.lens = np.array([len(v) for v in values], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        flat = np.concatenate(values) if len(values) else np.zeros(0, np.uint32)
        names, at = np.unique(flat, return_inverse=True)
        self.flat = at.astype(np.int32)
        self.mark = np.zeros(len(names), bool)
        self.levels = np.array([level_of(n) for n in sizes.tolist()], np.int64)
        self.counts = {}  # members of each set that a higher level would leave
        for level in sorted(set(self.levels.tolist())):
            left = np.concatenate(([0], np.cumsum(flat & ((1 << level) - 1) == 0)))
            self.counts[level] = left[self.starts + self.lens] - left[self.starts]
        self.doubtful: list[tuple[np.ndarray, np.ndarray]] = []

    def shared(self, a: int, others: np.ndarray) -> np.ndarray:
        """Members that the set ``a`` shares with each of the others."""
        mine = self.flat[self.starts[a] : self.starts[a] + self.lens[a]]
        self.mark[mine] = True
        lens, out = self.lens[others], np.zeros(len(others), np.int64)
        ends = np.cumsum(lens)
        lo = 0
        while lo < len(others):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LOOKUP, "right")))
            n = lens[lo:hi]
            at = np.repeat(self.starts[others[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hits = np.concatenate(([0], np.cumsum(self.mark[self.flat[at]])))
            ends_here = np.cumsum(n)
            out[lo:hi] = hits[ends_here] - hits[ends_here - n]
            lo = hi
        self.mark[mine] = False
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are alike for sure; those that only the texts can settle are noted as doubtful."""
        sure = np.zeros(len(a), bool)
        small, large = np.minimum(self.sizes[a], self.sizes[b]), np.maximum(self.sizes[a], self.sizes[b])
        worth = np.flatnonzero(small >= self.least * large)
        worth = worth[np.argsort(a[worth], kind="stable")]
        if not len(worth):
            return sure
        firsts = np.flatnonzero(np.diff(a[worth], prepend=-1))
        doubt = []
        for lo, hi in zip(firsts, [*firsts[1:], len(worth)], strict=True):
            at = worth[lo:hi]
            x, others = int(a[at[0]]), b[at]
            both = self.shared(x, others)
            level = np.maximum(self.levels[x], self.levels[others])
            union = np.zeros(len(at), np.int64)
            for v in set(level.tolist()):
                mine = level == v
                union[mine] = self.counts[v][x] + self.counts[v][others[mine]]
            union -= both
            part = level > 0
            margin = np.where(part, SIGMAS * np.sqrt(0.25 / np.maximum(union, 1)), np.where(large[at] > EXACT, CHANCE, 0.0))
            sure[at] = both >= (self.least + margin) * union
            unsure = ~sure[at] & (both >= (self.least - margin) * union)
            doubt.append(at[unsure])
        doubt = np.concatenate(doubt) if doubt else np.zeros(0, np.int64)
        if len(doubt):
            self.doubtful.append((a[doubt], b[doubt]))
        return sure


def _copy_batches(radii, least):
    """Edges u, v of the forests of alike texts, and pairs about which the texts must decide (``sure`` is false)."""

    def run(batches):
        for keys, fps, nodes, sizes, parts in segments(batches, "fp", "node", "size", "part", heavy="part"):
            index, test, above = GrayIndex(keys.view(np.uint64), fps.view(np.uint64)), SetTest(parts, sizes, least), -1
            for radius in radii:
                found = [(*index.join(radius, above, test), True), *[(*x, False) for x in test.doubtful]]
                test.doubtful, above = [], radius
                for a, b, sure in found:
                    if len(a):
                        u, v = np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), sure))], names=["u", "v", "sure"])

    return run


def _confirmed_batches(shingle, least):
    """Edges arrive sorted by u, so the set of one text serves its whole run."""

    def run(batches):
        known, mine = None, None
        for b in batches:
            keep = []
            for u, a, c in zip(b.column("u").to_pylist(), b.column("a"), b.column("b"), strict=True):
                if u != known or mine is None:
                    known, mine = u, shingle_set(a.as_py(), shingle)
                other = shingle_set(c.as_py(), shingle)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(both >= least * (len(mine) + len(other) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _dealt(rows: DataFrame, hot: int) -> DataFrame:
    """``node, fp, size, route`` of the lead keys that several nodes have, one key for each group of nodes, dealt out where crowded.

    Keys with the same members would settle the same pairs, so one of them is enough. The members of a key with over
    ``hot`` nodes, or KEY_SHINGLES, are dealt into parts, and every two parts meet under a key of their own.
    """
    members = [F.count(F.lit(1)).alias("count"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.sum(F.least("size", F.lit(2 * SET))).alias("words")]
    sizes = rows.groupBy("route").agg(*members).filter("count > 1").groupBy("count", "x", "y", "words").agg(F.min("route").alias("route"))
    share = F.greatest(F.col("count") / hot, F.col("words") / KEY_SHINGLES)
    parts = F.when(share > 1, F.ceil(2 * share)).otherwise(1).cast("int")
    met = rows.join(materialise(sizes.select("route", parts.alias("parts")), "route-sizes"), "route")
    own = F.pmod(F.xxhash64("route", "node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own"))
    shared = met.filter("parts > 1").withColumn("own", own).withColumn("other", F.explode(others))
    shared = shared.select("node", "fp", "size", F.xxhash64("route", F.least("own", "other"), F.greatest("own", "other")).alias("route"))
    return met.filter("parts = 1").select("node", "fp", "size", "route").unionByName(shared)


def copy_edges(texts: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """Edges ``u, v`` between nodes of ``node, text`` rows (equal nodes have equal texts) whose similarity is ``least`` or more.

    They connect what all such pairs would connect, but for pairs that share no band: of those that do, whatever
    number of texts share it, none is passed over. Sets of over EXACT shingles that come close to the threshold are settled by the texts.
    """
    sketches = materialise(in_batches(texts.select("node", "text")).mapInArrow(_sketch_batches(shingle, bands, rows), "node long, fp long, size long, band int, route long"), "sketches")
    single = sketches.filter("band = 0").groupBy("node").count().filter("count > 1").isEmpty()
    sketches = sketches if single else materialise(sketches.dropDuplicates(["node", "band"]), "sketches")
    shared = materialise(_dealt(sketches.select("node", "fp", "size", "route"), hot), "lead-keys")
    wanted = materialise(shared.select("node").distinct(), "wanted")
    sets = in_batches(sieved(texts, "node", wanted).select("node", "text")).mapInArrow(_set_batches(shingle), "set_node long, part binary")
    sets = sets if single else sets.dropDuplicates(["set_node"])
    held = shared.join(sets, F.col("node") == F.col("set_node")).select("route", "fp", "node", "size", "part")
    dealt = held.repartition(shuffle_width(texts.sparkSession), "route").sortWithinPartitions("route", "fp", "node")
    found = materialise(in_batches(dealt).mapInArrow(_copy_batches(RADII, least), "u long, v long, sure boolean").distinct(), "edges-found")
    sure, open_ = found.filter("sure").select("u", "v"), found.filter("not sure").select("u", "v")
    if open_.isEmpty():
        return sure
    ends = open_.select(F.col("u").alias("node")).union(open_.select(F.col("v").alias("node"))).distinct()
    long = materialise(sieved(texts, "node", materialise(ends, "ends")).select("node", "text"), "doubtful-texts")
    pairs = open_.join(long.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").join(long.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    return sure.unionByName(in_batches(pairs.select("u", "v", "a", "b")).mapInArrow(_confirmed_batches(shingle, least), "u long, v long"))


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, hot: int = HOT) -> DataFrame:
    """``node, component_id`` of each text that has a near copy or several rows; node is Spark's xxhash64 of the text.

    Texts without a word, null ones included, are alike. component_id is the smallest doc_id of the rows of
    linked texts, null only if all are. Other columns are ignored; an empty table gives an empty result.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    owners = materialise(keyed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "owners")
    roots = materialise(components(copy_edges(keyed.select("node", "text"), shingle, least, bands, rows, hot)), "roots")
    linked = roots.join(owners, "node")
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = owners.filter("n > 1").join(roots, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    return linked.join(low, "root").select("node", "component_id").unionByName(alone)


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The input's rows, in its columns, but of each group of near copies only the document of the smallest doc_id.

    Copies of a text are near copies too. Null doc_ids rank last; if a group has no other, its rows stay. Rows
    that repeat a doc_id are one document.
    """
    node, lost_id = unused(docs, "node", "lost_id")
    hashed = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = materialise(near_copies(docs, shingle, least).withColumnRenamed("node", node), "near-copies")
    lost = sieved(hashed.select("doc_id", node), node, groups.select(node)).join(groups, node).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    lost = materialise(lost.select(node, F.col("doc_id").alias(lost_id)).distinct(), "lost-copies")
    return without(hashed, node, lost, lambda a, b: (a[node] == b[node]) & F.col("doc_id").eqNullSafe(F.col(lost_id))).drop(node)


def op3_simhash(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"))
