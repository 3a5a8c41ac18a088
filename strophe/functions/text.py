"""Name normalisation, tokens and case-insensitive containment."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Traditional to Simplified characters, a small general set in natural order. Callers with a dictionary
#: pass their own: a pair of equally long strings, or phrases as :func:`load_phrases` reads them.
TRADITIONAL = "愛東車馬長門風飛魚鳥龍語說話時間過還來個們國開關聽見學樂夢淚歲雲電頭華萬與這裡對從會點現無聲傷傑倫輪戀離後歡"
SIMPLIFIED = "爱东车马长门风飞鱼鸟龙语说话时间过还来个们国开关听见学乐梦泪岁云电头华万与这里对从会点现无声伤杰伦轮恋离后欢"


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """Bind a column once inside an expression, so it is not evaluated for every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_simplified(c: Column, table: tuple[str, str] = (TRADITIONAL, SIMPLIFIED)) -> Column:
    """Map characters; queries are converted, stored names are kept as they came."""
    return F.translate(c, *table)


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_name(c: Column) -> Column:
    """Comparable form of a name: lower case, plain quotes and commas, brackets as spaced parentheses."""
    c = F.translate(F.lower(c), "’，", "',")
    c = F.regexp_replace(F.regexp_replace(c, r"[（【\[]", " ("), r"[）】\]]", ") ")
    return collapse(F.replace(c, F.lit("acoustic version"), F.lit("acoustic")))


def normalize_names(names: Column) -> Column:
    return F.transform(names, normalize_name)


def normalize_text(s: str) -> str:
    """:func:`normalize_name` for a query on the driver."""
    s = s.lower().replace("’", "'").replace("，", ",")
    s = re.sub(r"[（【\[]", " (", s)
    s = re.sub(r"[）】\]]", ") ", s)
    return " ".join(s.replace("acoustic version", "acoustic").split())


def load_phrases(path: str) -> dict[str, str]:
    """A conversion table from a file of ``phrase<TAB>replacement`` lines; of several replacements the first."""
    with open(path, encoding="utf-8") as f:
        pairs = [line.split("\t", 1) for line in f.read().splitlines() if "\t" in line and not line.startswith("#")]
    return {k: v.split()[0] for k, v in pairs if k and v.split()}


def simplify_text(s: str, table: tuple[str, str] | Mapping[str, str] = (TRADITIONAL, SIMPLIFIED)) -> str:
    """Replace characters, or phrases, of which the longest that begins at a place counts."""
    if not isinstance(table, Mapping):
        return s.translate(str.maketrans(*table))
    out, at, most = [], 0, max(map(len, table), default=0)
    while at < len(s):
        n = next((n for n in range(min(most, len(s) - at), 0, -1) if s[at : at + n] in table), 0)
        out.append(table[s[at : at + n]] if n else s[at])
        at += n or 1
    return "".join(out)


def tokens(normalized: Column) -> Column:
    """Words of a normalised query; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def ascii_fold(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def contains_ascii_ci(haystack: Column, needle: Column) -> Column:
    """Containment that ignores the case of A-Z only; the empty needle is in everything."""
    return F.contains(ascii_fold(haystack), ascii_fold(needle))


def any_contains(names: Column, needle: Column) -> Column:
    return F.exists(names, lambda n: contains_ascii_ci(n, needle))


def decode_names(json: Column) -> Column:
    """Strings of a JSON array; empty for null and for anything else, an array with other values included."""
    items = F.from_json(json, "array<string>")
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.coalesce(F.when((kind == "ARRAY<STRING>") & F.forall(items, lambda x: x.isNotNull()), items), F.array().cast("array<string>"))
