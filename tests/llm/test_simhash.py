import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from data import SCHEMA, rows, table

from strophe.llm import simhash
from strophe.llm.simhash import GrayIndex, components, copy_edges, fingerprint, gray_rank, keep_one, near_copies, near_duplicates, near_edges, shingle_set


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute_components(fps, limit=4):
    return joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= limit])


def brute_shingles(text, n=5):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def brute_copies(texts):
    """Component numbers of all pairs of texts with a Jaccard similarity of 0.8 or more over five-word shingles."""
    return joined(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j])])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def clustered(rng, n):
    """Distinct fingerprints: random ones, chains of near ones, and a dense group within few bits."""
    out = {0}
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(f)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    out |= {base ^ x for x in range(64)} | {base ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) for _ in range(200)}
    return sorted(out)


def test_fingerprints():
    for _, t, _ in rows():
        assert fingerprint(t) == brute_fingerprint(t)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_gray_rank():
    codes = np.arange(256, dtype=np.uint64)
    assert (gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


@pytest.mark.parametrize("n", [1, 2, 17, 100, 3000])
@pytest.mark.parametrize("radii", [(4,), (1, 2, 4), (0, 3, 9)])
def test_index_joins(n, radii):
    """The index's edges are a forest whose trees are the components of all pairs."""
    fps = clustered(random.Random(n), n)
    random.Random(0).shuffle(fps)
    index = GrayIndex(np.zeros(len(fps), np.uint64), np.array(fps, np.uint64))
    pairs = [p for r in radii for p in zip(*(x.tolist() for x in index.join(r)))]
    got = joined(len(fps), pairs)
    assert len(pairs) == len(fps) - len(set(got)) and same_partition(got, brute_components(fps, radii[-1]))


def test_lead_keys_part_the_index():
    """Fingerprints under different lead keys don't join, however near they are."""
    rng = random.Random(4)
    fps = clustered(rng, 300)
    keys = [rng.choice([3, 1 << 63, 5]) for _ in fps]
    index = GrayIndex(np.array(keys, np.uint64), np.array(fps, np.uint64))
    a, b = index.join(4)
    assert all(keys[x] == keys[y] for x, y in zip(a, b))
    got = joined(len(fps), zip(a.tolist(), b.tolist()))
    for k in set(keys):
        own = [i for i, x in enumerate(keys) if x == k]
        assert same_partition([got[i] for i in own], brute_components([fps[i] for i in own]))


DENSE = """
import random, resource
import numpy as np
from strophe.llm.simhash import GrayIndex
rng = random.Random(1)
base, fps = rng.getrandbits(64), set()
while len(fps) < 200_000:
    f = base
    for _ in range(rng.randint(1, 5)):
        f ^= 1 << rng.randrange(64)
    fps.add(f)
index = GrayIndex(np.zeros(len(fps), np.uint64), np.array(sorted(fps), np.uint64))
n = sum(len(index.join(r)[0]) for r in (1, 2, 4))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_dense_family_in_bounded_memory():
    """200,000 fingerprints around one become a single component in far less than an executor's memory."""
    n, mb = map(int, subprocess.run([sys.executable, "-c", DENSE], check=True, capture_output=True, text=True).stdout.split())
    assert n == 199_999 and mb < 1000


def test_every_link_comes_from_the_index(spark, monkeypatch):
    """Without the index's joins nothing is linked."""
    data = [(i, t, g) for i, (_, t, g) in enumerate(rows())]
    linked = lambda: {r["doc_id"] for r in near_duplicates(table(spark, data)).collect() if r["doc_id"] != r["component_id"]}
    assert linked()
    monkeypatch.setattr(GrayIndex, "join", lambda self, limit: (np.zeros(0, np.int64),) * 2)
    fps = {}
    same_fp = {i for i, t, _ in data if fps.setdefault(brute_fingerprint(t), i) != i}
    assert linked() == same_fp


@pytest.mark.parametrize(("limit", "hot"), [(4, 20_000), (4, 30), (4, 3), (7, 20_000), (0, 20_000), (1, 5)])
def test_edges_and_components(spark, limit, hot):
    fps = clustered(random.Random(5), 1200)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(near_edges(nodes, limit, hot)).collect()}
    assert same_partition([roots.get(f, f) for f in signed], brute_components(fps, limit))
    groups = defaultdict(list)
    for f in signed:
        groups[roots.get(f, f)].append(f)
    assert all(min(g) == r for r, g in groups.items())


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    got = components(edges).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 301


def test_hub(spark):
    """A node that thousands of others link to, with chains that hang on these."""
    edges = [(0, i) for i in range(1, 4000)] + [(i, i + 4000) for i in range(1, 4000, 2)] + [(20_000, 20_001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got.pop(20_000) == got.pop(20_001) == 20_000 and set(got.values()) == {0} and len(got) == 4000 + 2000


def test_operator(spark):
    data = rows()
    got = near_duplicates(table(spark)).collect()
    fps = [brute_fingerprint(t) for _, t, _ in data]
    comp = brute_components(fps)
    least = defaultdict(lambda: None)
    for c, (i, _, _) in zip(comp, data):
        if i is not None:
            least[c] = i if least[c] is None else min(i, least[c])
    want = sorted(repr((i, f"{f:016x}", least[c])) for f, c, (i, _, _) in zip(fps, comp, data))
    assert sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got) == want


def family(rng, n, words=120, edits=4):
    """Texts that each change a few words of an earlier one."""
    out = [[f"w{rng.randrange(500)}" for _ in range(words)]]
    while len(out) < n:
        t = list(rng.choice(out[-8:]))
        for _ in range(rng.randint(1, edits)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(5000)}"
        out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("hot", [20_000, 12])
def test_near_copies(spark, hot):
    """Families of texts that drift apart, and the awkward rows: groups equal those of all pairs."""
    rng = random.Random(6)
    texts = list(dict.fromkeys([t or "" for _, t, _ in rows()] + [t for k in range(12) for t in family(rng, 14, rng.choice([9, 40, 120, 300]), 1 + k % 5)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_copies(texts)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    ids = {r["node"]: r["doc_id"] for r in docs.selectExpr("xxhash64(text) as node", "doc_id").collect()}
    got = {ids[r["node"]]: r["component_id"] for r in near_copies(docs, hot=hot).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == [least[c] for c in want]


def test_confirmed_by_the_texts(spark):
    """Two texts with equal band keys stay apart if they are not alike."""
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"w{i}" for i in range(12, 72))  # similarity 44 / 68
    docs = spark.createDataFrame([(1, a), (2, b)], "node long, text string")
    assert copy_edges(docs, rows=1, bands=40).collect() == [] and len(copy_edges(docs, rows=1, bands=40, least=0.5).collect()) >= 1


def test_keep_one_and_empty(spark):
    kept = keep_one(table(spark))
    assert kept.columns == table(spark).columns
    data = [(i, t) for i, t, _ in rows()]
    comp = brute_copies([t for _, t in data])
    least = defaultdict(lambda: None)
    for c, (i, _) in zip(comp, data):
        if i is not None:
            least[c] = i if least[c] is None else min(i, least[c])
    want = sorted(repr((i, t)) for c, (i, t) in zip(comp, data) if i == least[c])
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept.collect()) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []
    with pytest.raises(ValueError):
        near_edges(empty.select("fp"), limit=64)
    assert simhash.SEED == 42


def test_long_text_in_slices(monkeypatch):
    text = " ".join(f"w{i % 977} A" for i in range(3000)) + "\n" + "y" * 500 + " \t end"
    want, sets = brute_fingerprint(text), shingle_set(text, 5)
    monkeypatch.setattr(simhash, "SLICE", 50)
    assert fingerprint(text) == want and (shingle_set(text, 5) == sets).all() and len(sets) == len(brute_shingles(text))


def template_family(rng, n, words=300, own=(36, 50)):
    """Texts around common words, near the threshold to each other; every second one is an edited copy of the one before."""
    common, out = [f"t{i}" for i in range(words)], []
    for i in range(n):
        text = list(out[-1]) if i % 2 else common + [f"o{rng.random()}" for _ in range(rng.randint(*own))]
        for _ in range(rng.randint(1, 3) if i % 2 else 0):
            text[rng.randrange(words, len(text))] = f"z{rng.random()}"
        out.append(text)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize(("own", "hot"), [((36, 50), 20_000), ((60, 200), 20_000), ((36, 50), 50)])
def test_recall_in_template_families(spark, own, hot):
    """Of all pairs at 0.8 or more at least 0.95 are linked, and nothing else is, also under crowded keys; the same in each run."""
    texts = template_family(random.Random(hot + own[1]), 240, own=own) + template_family(random.Random(1), 60, 40, (5, 12))
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    both = lambda a, b: len(sets[a] & sets[b])
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {r["node"]: r["doc_id"] for r in docs.selectExpr("xxhash64(text) as node", "doc_id").collect()}
    runs = [sorted((ids[r["node"]], r["component_id"]) for r in near_copies(docs.repartition(k), hot=hot).collect()) for k in (3, 5)]
    assert runs[0] == runs[1]
    got = dict(runs[0])
    assert len(pairs) >= 100 and sum(got.get(a, a) == got.get(b, b) for a, b in pairs) >= 0.95 * len(pairs)
    assert same_partition([got.get(i, i) for i in range(len(texts))], joined(len(texts), pairs))


def test_rejected_pairs_hide_nothing():
    """A pair that ``settle`` rejects joins nothing, and none is asked about twice."""
    rng = random.Random(8)
    fps = np.array(clustered(rng, 400), np.uint64)
    index, asked, good = GrayIndex(np.zeros(len(fps), np.uint64), fps), [], set()

    def settle(a, b):
        pairs = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
        asked.extend(pairs)
        return np.array([(x + y) % 3 == 0 for x, y in pairs], bool)

    above = -1
    for radius in (0, 2, 4, 8, 12):
        for a, b in zip(*index.join(radius, above, settle)):
            good.add((min(a, b), max(a, b)))
        above = radius
    near = [(a, b) for b in range(len(fps)) for a in range(b) if int(fps[a] ^ fps[b]).bit_count() <= 12]
    assert len(asked) == len(set(asked)) and set(asked) <= set(near)
    assert same_partition(joined(len(fps), good), joined(len(fps), [(a, b) for a, b in near if (a + b) % 3 == 0]))


@pytest.mark.parametrize("size", [1 << 14, 64])
def test_settling_by_sets(monkeypatch, size):
    """Whole sets decide exactly; parts of large ones are right or in doubt."""
    monkeypatch.setattr(simhash, "SET", size)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [base[:0], base[:1]]
    for k in range(120):
        n = int(rng.choice([5, 60, 130, 700]))
        sets.append(np.unique(np.concatenate((base[: n - int(n * 0.2 * rng.random())], rng.integers(0, 1 << 63, int(n * 0.15 * rng.random())).astype(np.uint64)))))
    test = simhash.SetTest([simhash.part_of(s).tobytes() for s in sets], np.array([len(s) for s in sets]), 0.8)
    a, b = np.triu_indices(len(sets), 1)
    sure = test(a, b)
    doubtful = set() if not test.doubtful else set(zip(*(x.tolist() for x in map(np.concatenate, zip(*test.doubtful)))))
    for x, y, s in zip(a.tolist(), b.tolist(), sure.tolist()):
        both = len(np.intersect1d(sets[x], sets[y]))
        union = len(sets[x]) + len(sets[y]) - both
        if (x, y) not in doubtful:
            assert s == (both >= 0.8 * union), (x, y, both, union)
    sizes = [len(x) for x in sets]
    assert not test(np.array([0]), np.array([sizes.index(max(sizes))])).any()  # sizes alone tell
    assert len(doubtful) == 0 if size > 100 else len(doubtful) < len(a) / 2


def test_copies_far_apart_in_bits(spark):
    """Short texts can be alike at 0.8 and differ in more than 20 bits."""
    rng = random.Random(11)
    far = []
    while len(far) < 3:
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        a, b = " ".join(words[:8]), " ".join(words)
        x, y = shingle_set(a, 5), shingle_set(b, 5)
        if (simhash.majority([x]) ^ simhash.majority([y])).bit_count() > 20:
            far.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, t) for i, pair in enumerate(far) for k, t in enumerate(pair)], "doc_id long, text string")
    assert sorted(r["component_id"] for r in near_copies(docs).collect()) == [0, 0, 2, 2, 4, 4]


def test_crowded_band_that_is_shared_alone(spark):
    """Of texts that share one band only, and that with many others, each pair is settled."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"end{i}"])) for i in range(12)], "doc_id long, text string")
    for hot in (2, 5, 100):
        assert [r["component_id"] for r in near_copies(docs, bands=1, rows=1, hot=hot).collect()] == [0] * 12
