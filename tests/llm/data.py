"""Small tables with every awkward case, and brute-force forms."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, sha string, shard int, removed string, k long, unit int, fp long"
#: Names that operators give to columns of their own, now or before.
NAMES = (
    "__key __cut __k __units __doc_id __sha __hash node lost_id lost_sha units cut unit_doc bit bits block depth prefix low chain keep_id n_rows group_size kept "
    "route band count first last n least component_id root u v a b t seed size quality pos bucket rank base slot law loss_start words hi lo text_hash score fold at number"
).split()
SCHEMA += "".join(f", {c} string" for c in NAMES)
LANG_WORDS = {
    "en": "the of and to in is that with for was this from they have".split(), "de": "der die und das ist nicht ein für auf mit sich des dem über".split(),
    "fr": "le la les et des est une pour dans que pas sur avec être".split(), "es": "el los que una por con para está como más pero sus año ñu".split(),
}


def sentence(rng, lang, n=12):
    words = [rng.choice(LANG_WORDS[lang]) if rng.random() < 0.6 else "".join(rng.choice("abcdeéioußñtrnslm") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def prose(rng, lang, sentences=8):
    return "\n".join(" ".join(sentence(rng, lang) for _ in range(3)) for _ in range(max(1, sentences // 3)))


def rows(seed=1, n=60):
    """(doc_id, text, lang): prose, copies, near copies, nulls, empties, a long text, odd characters."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANG_WORDS))
        out.append((i, prose(rng, lang, rng.randint(3, 15)), lang))
    texts = [t for _, t, _ in out]
    extra = [
        texts[0], texts[0].upper(), texts[1], None, None, "", "   \n\t", "word", "one two three", "x" * 3000, " ".join(["again"] * 400), "ÄÖ äö", "äö ÄÖ", "日本語のテキスト。\n日本語", "a\x1cb c　d e",
        "🙂🙂 emoji 🙂", "#*$%&|<> ||| ***", "İstanbul Σίσυφος ΌΣΟΣ ﬁ é", "<|endoftext|> x", "tab\tand\r\nreturn\x0b\x0c", texts[2] + " " + prose(rng, "en"), texts[3][: len(texts[3]) // 2], prose(rng, "en", 600),
    ]
    out += [(100 + i, t, None if i % 3 else "en") for i, t in enumerate(extra)]
    out += [(None, texts[4], "en"), (None, None, None), (5, texts[5], "de"), (5, texts[5], "de"), (6, "other text under a known id", None)]
    return out


def table(spark, data=None):
    """The rows with columns whose names the operators use themselves."""
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, g, None, None, 1, "s", 2, "r", 3, 4, 5, *NAMES) for i, t, g in data], SCHEMA).repartition(3)


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
