"""Pieces of SQL that several queries' SQL texts share."""

from __future__ import annotations

from ..functions.text import ASCII_PUNCTUATION, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PUNCT = ASCII_PUNCTUATION.replace("'", "''")


def terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({_STOP}))"


def normalized_title(t: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace({t}, '\s+', ' ', 'g'))), '^[{_PUNCT} ]+|[{_PUNCT} ]+$', '', 'g')"


def squashed(t: str) -> str:
    return rf"regexp_replace(lower({t}), '[\s\-‐-―]+', '', 'g')"


def initialism(t: str) -> str:
    words = rf"string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' ')"
    bare = rf"regexp_replace(lower(w), '^[{_PUNCT}]+|[{_PUNCT}]+$', '', 'g')"
    return f"upper(array_to_string(list_transform(list_filter({words}, lambda w: {bare} <> '' AND {bare} NOT IN ({_STOP})), lambda w: regexp_extract(w, '[A-Za-z]')), ''))"


def sequence_text(t: str) -> str:
    return rf"(' ' || trim(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def alias_key(t: str) -> str:
    return rf"upper(regexp_replace(coalesce({t}, ''), '[^\p{{L}}\p{{N}}]', '', 'g'))"


def bm25(queries: str, docs: str, group: str = "") -> str:
    """CTEs that end in `scored` (group, query, doc, score). queries: query, text; docs: doc, text; both with the group, if any."""
    g, on = (f"{group}, ", f"AND a.{group} = b.{group}") if group else ("", "")
    by = f"GROUP BY {group}" if group else ""
    return f"""
    q AS (SELECT DISTINCT {g}query, unnest({terms('text')}) AS term FROM ({queries})),
    d AS (SELECT {g}doc, {terms('text')} AS t FROM ({docs})),
    p AS (SELECT {g}doc, term, count(*) AS tf FROM (SELECT {g}doc, unnest(t) AS term FROM d) GROUP BY ALL),
    len AS (SELECT {g}doc, sum(len(t)) AS dl FROM d GROUP BY ALL),
    size AS (SELECT {g}count(*) AS n, avg(dl) AS avgdl FROM len {by}),
    freq AS (SELECT {g}term, count(*) AS df FROM p GROUP BY ALL),
    scored AS (
        SELECT {'q.' + g if group else ''}q.query, p.doc,
               round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM q JOIN p ON q.term = p.term {'AND q.' + group + ' = p.' + group if group else ''}
        JOIN freq ON freq.term = p.term {'AND freq.' + group + ' = p.' + group if group else ''}
        JOIN len ON len.doc = p.doc {'AND len.' + group + ' = p.' + group if group else ''}
        JOIN size ON {'size.' + group + ' = p.' + group if group else 'TRUE'}
        GROUP BY ALL)
"""
