"""Similarity of names and of artist lists, in points from 0 to 10."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, lit

#: Additions after which a title still counts as the same; fixed values.
EDITION_MARKS = ("(deluxe", "(explicit", "(special edition", "(bonus track", "(feat", "(with")
VARIOUS = ("various", "群星")
ARTIST_SIMILARITY = 88.0


def text_same(a: Column, b: Column) -> Column:
    """Normalised edit similarity in percent; 0 where lengths alone rule out 55 percent."""
    la, lb = F.char_length(a), F.char_length(b)
    longest, shortest = F.greatest(la, lb), F.least(la, lb)
    worth = (la > 0) & (lb > 0) & (shortest / longest * 100.0 >= 55.0)
    return F.when(worth, (1.0 - F.levenshtein(a, b) / longest) * 100.0).otherwise(F.lit(0.0))


def _base(name: Column, mark: str | Column) -> Column:
    return F.trim(F.call_function("substring_index", name, lit(mark), F.lit(1)))


def dash_equals_paren(dashed: Column, bracketed: Column) -> Column:
    """True for "A - B" and "A (B)"."""
    base, suffix = _base(dashed, " - "), F.trim(F.substr(dashed, F.instr(dashed, " - ") + 3))
    rest = F.ltrim(F.substr(bracketed, F.char_length(base) + 1))
    inner = F.trim(F.substr(rest, F.lit(2), F.char_length(rest) - 2))
    return (
        F.contains(dashed, F.lit(" - ")) & ~F.contains(dashed, F.lit("("))
        & F.contains(bracketed, F.lit("(")) & ~F.contains(bracketed, F.lit(" - "))
        & F.startswith(bracketed, base) & F.startswith(rest, F.lit("(")) & F.endswith(rest, F.lit(")"))
        & (F.char_length(rest) >= 2) & (inner == suffix)
    )


def _plain_of(a: Column, b: Column, mark: str | Column) -> Column:
    """Exactly one of the names has the mark, and the other is what stands before it."""
    in_a, in_b = F.contains(a, lit(mark)), F.contains(b, lit(mark))
    return (in_a & ~in_b & (b == _base(a, mark))) | (in_b & ~in_a & (a == _base(b, mark)))


def _same_places(a: Column, b: Column) -> Column:
    """Share of equal characters at equal places, for names of equal length."""
    n = F.char_length(a)
    hits = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))).cast("int"))
    return hits / n


def compare_name(a: Column, b: Column) -> Column:
    """Points of two normalised names: 10, 8, 6, 4, 2 or 0; the first rule that holds decides."""
    n = F.char_length(a)
    both_bracketed = F.contains(a, F.lit("(")) & F.contains(b, F.lit("("))
    placed = F.when(
        (n == F.char_length(b)) & (n >= 2),
        let(_same_places(a, b), lambda r: ((r >= 0.8) & (n >= 4)) | ((r >= 0.5) & n.between(2, 3))),
    ).otherwise(F.lit(False))
    graded = let(text_same(a, b), lambda s: F.when(s > 90, 8).when(s > 80, 6).when(s > 68, 4).when(s > 55, 2).otherwise(0))
    return (
        F.when(a.isNull() | b.isNull(), 0)
        .when(F.trim(a) == F.trim(b), 10)
        .when(dash_equals_paren(a, b) | dash_equals_paren(b, a), 8)
        .when(F.exists(F.array(*map(F.lit, EDITION_MARKS)), lambda m: _plain_of(a, b, m)), 8)
        .when(both_bracketed & (_base(a, "(") == _base(b, "(")), 6)
        .when(_plain_of(a, b, "("), 6)
        .when(placed, 6)
        .otherwise(graded)
    )


def best_name(query: Column, names: Column) -> Column:
    """Points of the best of several names; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(names, lambda n: compare_name(query, n))), F.lit(0))


def _various(names: Column) -> Column:
    return F.exists(names, lambda n: F.regexp_like(n, F.lit("|".join(VARIOUS))))


def _same_artist(a: Column, b: Column) -> Column:
    return F.contains(b, a) | F.contains(a, b) | (text_same(a, b) > ARTIST_SIMILARITY)


def _tier(jaccard: Column) -> Column:
    return F.when(jaccard >= 0.99, 10).when(jaccard >= 0.8, 8).when(jaccard >= 0.6, 6).when(jaccard >= 0.4, 4).when(jaccard >= 0.15, 2).otherwise(0)


def compare_artists(wanted: Column, present: Column) -> Column:
    """Points of two artist lists; null if either has no name.

    Each wanted artist takes the first present one it matches that is not taken; places from the 65th on
    can be taken more than once. Points follow the Jaccard index of the lists.
    """
    named = lambda names: F.filter(names, lambda n: n != "")

    def score(a: Column, b: Column) -> Column:
        na, nb = F.size(a), F.size(b)

        def take(taken: Column, name: Column) -> Column:
            free = F.filter(
                F.sequence(F.lit(0), nb - 1),
                lambda j: ~((j < 64) & F.array_contains(taken, j)) & _same_artist(name, F.get(b, j)),
            )
            return F.when(F.size(free) > 0, F.concat(taken, F.slice(free, 1, 1))).otherwise(taken)

        met = let(F.size(F.aggregate(a, F.array().cast("array<int>"), take)), lambda k: _tier(k / (na + nb - k)))
        crowd = (_various(a) & (_various(b) | (nb > 4))) | (_various(b) & (na > 4))
        return F.when((na == 0) | (nb == 0), F.lit(None).cast("int")).when(crowd, 6).otherwise(met)

    return let(named(wanted), lambda a: let(named(present), lambda b: score(a, b)))


def artist_points(query: Column, present: Column) -> Column:
    """:func:`compare_artists` for one wanted artist, in closed form; 0 where that is null."""

    def score(b: Column) -> Column:
        n = F.size(b)
        crowd = _various(F.array(query)) & (_various(b) | (n > 4))
        by_count = F.when(n == 1, 10).when(n == 2, 4).when(n <= 6, 2).otherwise(0)
        return (
            F.when(query.isNull() | (query == "") | (n == 0), 0).when(crowd, 6)
            .when(F.exists(b, lambda x: _same_artist(query, x)), by_count).otherwise(0)
        )

    return let(F.filter(present, lambda n: n != ""), score)
