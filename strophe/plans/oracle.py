"""DuckDB forms of the column expressions, for comparison only. ASCII names are assumed.

Fixed values are stated here again, so that a wrong one in the engine shows.
"""

from __future__ import annotations

EDITION_MARKS = ("(deluxe", "(explicit", "(special edition", "(bonus track", "(feat", "(with")


def s(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def _before(a: str, mark: str) -> str:
    return f"trim(split_part({a}, '{mark}', 1))"


def _plain_of(a: str, b: str, mark: str) -> str:
    return f"((contains({a}, '{mark}') AND NOT contains({b}, '{mark}') AND {b} = {_before(a, mark)}) OR (contains({b}, '{mark}') AND NOT contains({a}, '{mark}') AND {a} = {_before(b, mark)}))"


def text_same(a: str, b: str) -> str:
    long, short = f"greatest(length({a}), length({b}))", f"least(length({a}), length({b}))"
    return f"(CASE WHEN length({a}) > 0 AND length({b}) > 0 AND {short}::DOUBLE / {long} * 100.0 >= 55.0 THEN (1.0 - levenshtein({a}, {b})::DOUBLE / {long}) * 100.0 ELSE 0.0 END)"


def _dash(d: str, p: str) -> str:
    rest = f"ltrim(substr({p}, length({_before(d, ' - ')}) + 1))"
    return (
        f"(contains({d}, ' - ') AND NOT contains({d}, '(') AND contains({p}, '(') AND NOT contains({p}, ' - ') AND starts_with({p}, {_before(d, ' - ')})"
        f" AND starts_with({rest}, '(') AND suffix({rest}, ')') AND length({rest}) >= 2"
        f" AND trim(substr({rest}, 2, length({rest}) - 2)) = trim(substr({d}, instr({d}, ' - ') + 3)))"
    )


def compare_name(a: str, b: str) -> str:
    places = f"(list_sum(list_transform(range(1, length({a}) + 1), lambda i: ({a}[i] = {b}[i])::INT))::DOUBLE / length({a}))"
    sim = text_same(a, b)
    marks = " OR ".join(_plain_of(a, b, m) for m in EDITION_MARKS)
    return f"""(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0
      WHEN trim({a}) = trim({b}) THEN 10
      WHEN {_dash(a, b)} OR {_dash(b, a)} OR {marks} THEN 8
      WHEN contains({a}, '(') AND contains({b}, '(') AND {_before(a, "(")} = {_before(b, "(")} THEN 6
      WHEN {_plain_of(a, b, "(")} THEN 6
      WHEN length({a}) = length({b}) AND ((length({a}) >= 4 AND {places} >= 0.8) OR (length({a}) BETWEEN 2 AND 3 AND {places} >= 0.5)) THEN 6
      WHEN {sim} > 90 THEN 8 WHEN {sim} > 80 THEN 6 WHEN {sim} > 68 THEN 4 WHEN {sim} > 55 THEN 2 ELSE 0 END)"""


def best_name(query: str, names: str) -> str:
    return f"coalesce(list_max(list_transform({names}, lambda n: {compare_name(query, 'n')})), 0)"


def artist_points(query: str, names: str) -> str:
    m = f"len(list_filter({names}, lambda n: n <> ''))"
    met = f"len(list_filter({names}, lambda n: n <> '' AND {same_artist(query, 'n')})) > 0"
    crowd = f"({various(f'[{query}]')} AND ({various(names)} OR {m} > 4))"
    return (
        f"(CASE WHEN {query} IS NULL OR {query} = '' OR {m} = 0 THEN 0 WHEN {crowd} THEN 6 WHEN NOT ({met}) THEN 0"
        f" WHEN {m} = 1 THEN 10 WHEN {m} = 2 THEN 4 WHEN {m} <= 6 THEN 2 ELSE 0 END)"
    )


def same_artist(a: str, b: str) -> str:
    return f"(contains({b}, {a}) OR contains({a}, {b}) OR {text_same(a, b)} > 88.0)"


def various(names: str) -> str:
    return f"(len(list_filter({names}, lambda v: contains(v, 'various') OR contains(v, '群星'))) > 0)"


def two_artists(first: str, second: str, names: str) -> str:
    """Points of a wanted pair: each takes the first name that it matches and that is free."""
    n = f"len({names})"
    near = lambda a: f"list_filter(range(1, {n} + 1), lambda j: {same_artist(a, f'{names}[j]')})"
    met = f"((len({near(first)}) > 0)::INT + (len(list_filter({near(second)}, lambda k: k IS DISTINCT FROM {near(first)}[1])) > 0)::INT)"
    share = f"{met}::DOUBLE / (2 + {n} - {met})"
    crowd = f"({various(f'[{first}, {second}]')} AND ({various(names)} OR {n} > 4))"
    return (
        f"(CASE WHEN {n} = 0 THEN NULL WHEN {crowd} THEN 6 WHEN {share} >= 0.99 THEN 10 WHEN {share} >= 0.8 THEN 8"
        f" WHEN {share} >= 0.6 THEN 6 WHEN {share} >= 0.4 THEN 4 WHEN {share} >= 0.15 THEN 2 ELSE 0 END)"
    )


def classify(x: str) -> str:
    return f"(CASE WHEN {x} >= 21 THEN 7 WHEN {x} >= 19 THEN 6 WHEN {x} >= 17 THEN 5 WHEN {x} >= 15 THEN 4 WHEN {x} >= 11 THEN 3 WHEN {x} >= 6.5 THEN 2 WHEN {x} >= 2.5 THEN 1 ELSE 0 END)"


def score_fields(title: str | None, artist: str | None, album: str | None) -> str:
    total = (
        f"({best_name(s(title), 'normalized_track_names')} * 1.0::DOUBLE + {artist_points(s(artist), 'normalized_artist_names')} * 1.0::DOUBLE"
        f" + {best_name(s(album), 'normalized_album_names')} * 0.4::DOUBLE)"
    )
    possible = 10.0 * (title is not None) + 10.0 * (artist is not None) + 4.0 * (album is not None)
    return classify(f"({total} * ({24.0}::DOUBLE / {possible}))" if 0 < possible < 24 else total)


def keyword_scores(q: str, source: str) -> str:
    """CTEs that end in ``scored`` with a column ``score``."""
    qs = s(q)
    rest = "CASE WHEN artist IS NULL THEN {0} ELSE trim(replace({0}, artist, '')) END".format(qs)
    return f"""
k1 AS (SELECT *, list_filter(normalized_artist_names, lambda n: n <> '' AND contains({qs}, n))[1] AS artist FROM {source}),
k2 AS (SELECT *, {rest} AS rest FROM k1),
k3 AS (SELECT *, list_filter(normalized_album_names, lambda n: n <> '' AND contains(rest, n))[1] AS album FROM k2),
k4 AS (SELECT *, CASE WHEN album IS NULL OR trim(replace(rest, album, '')) = '' THEN rest ELSE trim(replace(rest, album, '')) END AS title FROM k3),
k5 AS (SELECT *, {best_name("title", "normalized_track_names")} AS t,
         CASE WHEN artist IS NOT NULL THEN 10 ELSE {artist_points(qs, "normalized_artist_names")} END AS a,
         CASE WHEN album IS NOT NULL THEN 10 ELSE {best_name(qs, "normalized_album_names")} END AS b FROM k4),
k6 AS (SELECT *, b * 0.4::DOUBLE + a + t AS total,
         (CASE WHEN a > 0 THEN 10.0 ELSE 0 END + CASE WHEN b > 0 THEN 4.0 ELSE 0 END + CASE WHEN title <> '' OR t > 0 THEN 10.0 ELSE 0 END)::DOUBLE AS possible FROM k5),
scored AS (SELECT *, {classify("(total * (24.0::DOUBLE / CASE WHEN possible = 0 THEN 24.0 ELSE possible END))")} AS score FROM k6)"""


def contains_ci(hay: str, needle: str) -> str:
    return f"contains(lower({hay}), lower({needle}))"


def any_contains(names: str, needle: str) -> str:
    return f"len(list_filter({names}, lambda n: {contains_ci('n', needle)})) > 0"


def rough_keyword(q: str) -> str:
    wrapped = lambda names: f"len(list_filter({names}, lambda n: {contains_ci(s(q), 'n')})) > 0"

    def meets(w):
        return "(" + " OR ".join(f"len(list_filter({c}, lambda n: {contains_ci('n', s(w))} OR (length(n) > 1 AND {contains_ci(s(w), 'n')}))) > 0" for c in ("track_names", "artist_names", "album_names")) + ")"

    return f"(({wrapped('track_names')} AND {wrapped('artist_names')}) OR ({' AND '.join(map(meets, q.split()))}))"


def bm25(keyword: str, source: str = "songs") -> str:
    """CTEs that end in ``ranked`` with columns ``id, timestamp, rank, in_main``; the phrase must not overlap itself."""
    k = s(keyword.lower())
    occ = lambda c: f"((length(lower({c})) - length(replace(lower({c}), {k}, ''))) / {len(keyword)})"
    return f"""
lengths AS (
  SELECT *, greatest(length(lyric_text) - 2, 0) + greatest(length(bg_vocal_text) - 2, 0) AS d,
         {occ("lyric_text")} AS om, {occ("bg_vocal_text")} AS ob FROM {source}
),
stats AS (SELECT count(*)::DOUBLE AS n, sum(d)::DOUBLE / count(*) AS mean, count(*) FILTER (om + ob > 0)::DOUBLE AS hits FROM lengths),
ranked AS (
  SELECT id, timestamp, om > 0 AS in_main, lyric_text, bg_vocal_text,
         -(CASE WHEN ln((n - hits + 0.5) / (hits + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - hits + 0.5) / (hits + 0.5)) END)
          * ((om + 0.25 * ob) * 2.2) / ((om + 0.25 * ob) + 1.2 * (0.25 + 0.75 * d / mean)) AS rank
  FROM lengths, stats WHERE om + ob > 0
)"""


def highlighted(text: str, keyword: str) -> str:
    """Snippet of a text for a phrase without case variants beyond ASCII; null if no line has it."""
    k = s(keyword.lower())
    lines = f"string_split(regexp_replace({text}, '\\n$', ''), chr(10))"
    at = f"list_position(list_transform({lines}, lambda x: contains(lower(x), {k})), true)"
    context = f"array_to_string(list_slice({lines}, greatest({at} - 1, 1), {at} + 1), chr(10))"
    return f"CASE WHEN {at} > 0 THEN regexp_replace({context}, '(?i)({keyword})', '<mark>\\1</mark>', 'g') END"
