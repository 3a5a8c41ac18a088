"""Column functions against plain Python models."""

import itertools

import pytest
from pyspark.sql import functions as F

from strophe.functions import ids, lyrics, similarity, text


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def model_same(a, b):
    if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) * 100 < 55:
        return 0.0
    return (1 - levenshtein(a, b) / max(len(a), len(b))) * 100


def model_compare(a, b):
    if a is None or b is None:
        return 0
    if a.strip() == b.strip():
        return 10

    def dash(d, p):
        if " - " not in d or "(" in d or "(" not in p or " - " in p:
            return False
        base, tail = (x.strip() for x in d.split(" - ", 1))
        rest = p[len(base) :].lstrip() if p.startswith(base) else ""
        return len(rest) >= 2 and rest[0] == "(" and rest[-1] == ")" and rest[1:-1].strip() == tail

    def plain(x, y, mark):
        return mark in x and mark not in y and y == x.split(mark)[0].strip()

    if dash(a, b) or dash(b, a):
        return 8
    if any(plain(a, b, m) or plain(b, a, m) for m in similarity.EDITION_MARKS):
        return 8
    if "(" in a and "(" in b and a.split("(")[0].strip() == b.split("(")[0].strip():
        return 6
    if plain(a, b, "(") or plain(b, a, "("):
        return 6
    if len(a) == len(b) and a:
        r = sum(x == y for x, y in zip(a, b)) / len(a)
        if (r >= 0.8 and len(a) >= 4) or (r >= 0.5 and 2 <= len(a) <= 3):
            return 6
    s = model_same(a, b)
    return 8 if s > 90 else 6 if s > 80 else 4 if s > 68 else 2 if s > 55 else 0


def model_artists(a, b):
    a, b = [x for x in a if x], [x for x in b if x]
    if not a or not b:
        return None
    va, vb = (any("various" in x or "群星" in x for x in y) for y in (a, b))
    if (va and (vb or len(b) > 4)) or (vb and len(a) > 4):
        return 6
    taken, met = set(), 0
    for x in a:
        for j, y in enumerate(b):
            if j not in taken and (x in y or y in x or model_same(x, y) > 88):
                taken.add(j)
                met += 1
                break
    j = met / (len(a) + len(b) - met)
    return next((p for t, p in ((0.99, 10), (0.8, 8), (0.6, 6), (0.4, 4), (0.15, 2)) if j >= t), 0)


NAMES = [
    "me!", "song - remix", "song (remix)", "song (remix", "completely different", "another song", "love", "love story", "love (deluxe)", "love (deluxe edition)",
    "love (feat. x)", "love (live)", "love (demo)", "夜曲", "夜行", "abc", "abd", "abcdefghij", "abcdefghix", "abcdefghijk", "a", "b", "", "x - y (z)", "x (y)", "x - y", "x(y)", "( )",
]


def test_compare_name_grid(spark):
    pairs = list(itertools.product(NAMES, NAMES))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", similarity.compare_name(F.col("a"), F.col("b")).alias("p"), similarity.text_same(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r["p"] == model_compare(r["a"], r["b"]), (r["a"], r["b"])
        assert r["s"] == pytest.approx(model_same(r["a"], r["b"]))
    assert one(spark, similarity.compare_name(F.lit(None).cast("string"), F.lit("x"))) == 0


def test_compare_artists(spark):
    lists = [[], [""], ["taylor swift"], ["taylor"], ["a1", "b2"], ["b2", "a1", "c3"], ["various artists"], ["u", "v", "w", "x", "y"], ["群星"], ["taylor swift", "x", "y", "z"], ["aa", "aa"]]
    pairs = list(itertools.product(lists, lists))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", similarity.compare_artists(F.col("a"), F.col("b")).alias("p")).collect():
        assert r["p"] == model_artists(r["a"], r["b"]), (r["a"], r["b"])
    single = spark.createDataFrame([(x[0], y) for x, y in pairs if len(x) == 1], "q string, b array<string>")
    for r in single.select("q", "b", similarity.artist_points(F.col("q"), F.col("b")).alias("p")).collect():
        assert r["p"] == (model_artists([r["q"]], r["b"]) or 0), (r["q"], r["b"])


def test_normalise(spark):
    cases = {
        "it’s": "it's", "A，B": "a,b", "Song [Deluxe]": "song (deluxe)", "  A  B  ": "a b", "X（Live）Y": "x (live) y", "My Acoustic Version": "my acoustic",
        "a　b c": "a b c", "": "", "acoustic  version": "acoustic version",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.normalize_name(F.col("s")).alias("v"))
    for r in df.collect():
        assert r["v"] == cases[r["s"]] == text.normalize_text(r["s"])
    assert one(spark, text.to_simplified(F.lit("愛 爱"))) == "爱 爱" == text.simplify_text("愛 爱")
    assert len(text.TRADITIONAL) == len(text.SIMPLIFIED)


def test_contains(spark):
    for hay, needle, want in (("Abc", "BC", True), ("abc", "", True), ("ÄB", "äb", False), ("", "x", False)):
        assert one(spark, text.contains_ascii_ci(F.lit(hay), F.lit(needle))) is want


def test_ids(spark):
    golden = {"test_song_one.ttml": 699269132670751, "test_song_two.ttml": 5440178231786117, "": ids.lyric_id_of(""), "歌.ttml": ids.lyric_id_of("歌.ttml")}
    df = spark.createDataFrame([(k,) for k in golden], "f string").select("f", ids.lyric_id(F.col("f")).alias("id"))
    assert {r["f"]: r["id"] for r in df.collect()} == golden
    assert ids.parse_id("+5") == 5 and ids.parse_id(str(ids.MAX_ID)) == ids.MAX_ID
    for bad in (" 5", "-1", "", "5 ", "1.0", str(ids.MAX_ID + 1), "٣"):
        with pytest.raises(ids.InvalidId):
            ids.parse_id(bad)
    stamps = {"123-a.ttml": 123, "-5.ttml": 0, "x-1.ttml": 0, "99": 99, "99999999999999999999-x": 0, " 7-x": 0, "+8-x": 8}
    df = spark.createDataFrame([(k,) for k in stamps], "f string").select("f", ids.filename_timestamp(F.col("f")).alias("t"))
    assert {r["f"]: r["t"] for r in df.collect()} == stamps


def test_lrc_and_highlight(spark):
    for ms, want in ((0, "[00:00.00]"), (1500, "[00:01.50]"), (65123, "[01:05.12]"), (6000000, "[100:00.00]")):
        assert one(spark, lyrics.lrc_timestamp(F.lit(ms).cast("long"))) == want
    h = lyrics.highlight_text
    assert h("Hello hello", "HELLO") == "<mark>Hello</mark> <mark>hello</mark>"
    assert h("aaaa", "aa") == "<mark>aa</mark><mark>aa</mark>" and h("aaa", "aa") == "<mark>aa</mark>a"
    assert h("肖邦的夜曲", "肖邦") == "<mark>肖邦</mark>的夜曲" and h("x", "") == "x" and h("", "x") == ""
    texts = ["one\ntwo KEY\nthree\nfour", "key first\nb", "a\nb\nlast key", "nothing", "", "  ", "a\r\nkey\r\nb\n", "k.y key"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lyrics.snippet(F.col("t"), "key").alias("j"), lyrics.exact_snippet("key")("t").alias("p"))
    for r in df.collect():
        assert r["j"] == r["p"] == lyrics.snippet_of(r["t"], "key"), r["t"]
    assert lyrics.snippet_of(texts[0], "key") == "one\ntwo <mark>KEY</mark>\nthree"
    assert one(spark, lyrics.snippet(F.lit("a(b\\E$1"), "(b\\E$")) == "a<mark>(b\\E$</mark>1"


def test_decode_names(spark):
    cases = {'["a","b"]': ["a", "b"], "[]": [], "broken": [], '{"a":1}': [], "[1,2]": [], '["a",1]': [], '["a",null]': [], '"a"': [], '["a","a"]': ["a", "a"], "": []}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string").select("s", text.decode_names(F.col("s")).alias("v"))
    assert {r["s"]: r["v"] for r in df.collect()} == {**cases, None: []}
