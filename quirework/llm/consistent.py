"""One consistent form for texts that look alike but differ in characters.

DuckDB runs inside each Arrow partition and its SQL does the work: regular expressions find and delete, translate maps
characters with one replacement, replace those with several, nfc_normalize composes. Which characters are compatibility
forms is a rule (the full compatibility decomposition differs from the canonical one), not a list, so the result agrees
with Unicode NFKC. A text of frequent characters that are their own form is passed through; replacements are only spelled out in the SQL for
characters that occur in the batch.

The form: invisible characters removed; compatibility characters and accents as in NFKC; every space separator a plain
space (line ends and tabs stay); U+2010, U+2011 and U+2212 a plain hyphen; Greek and Cyrillic letters that look like
Latin ones made Latin where the same run of letters also has a Latin letter. The form of a form is itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

# Characters without a visible shape (soft hyphen, combining grapheme joiner, Arabic letter mark, Mongolian
# vowel separator, zero-width space, joiners and direction marks, direction embeddings and isolates, word joiner and
# invisible operators, byte-order mark).
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}"
# Hyphen, non-breaking hyphen and minus sign, which become the plain hyphen.
HYPHENS = "‐‑−"
# Letters and the Latin letters of the same shape, in the order of the alphabets.
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϳ", "ABEZHIKMNOPTYXaivopuj"
CYRILLIC, CYRILLIC_AS_LATIN = "ЁЅІЇЈАВЕКМНОРСТУХԚԜаеорсухёѕіїјһԁԛԝ", "ËSIÏJABEKMHOPCTYXQWaeopcyxësiïjhdqw"
LOOKALIKE, LATIN = GREEK + CYRILLIC, GREEK_AS_LATIN + CYRILLIC_AS_LATIN


@cache
def compatibility_class() -> str:
    """All characters with a compatibility decomposition, as the inside of a regular-expression class."""
    ranges: list[list[int]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:  # Hangul syllables decompose canonically
            continue
        char = chr(code)
        if unicodedata.normalize("NFKD", char) != unicodedata.normalize("NFD", char):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@cache
def _unchanged_class() -> str:
    """Frequent characters that are their own form and don't combine, as the inside of a regular-expression class."""
    invisible = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", INVISIBLE) + "]")
    codes = [
        code
        for code in [*range(0x80, 0x400), *range(0x2010, 0x2028)]
        if unicodedata.normalize("NFKC", char := chr(code)) == char
        and unicodedata.category(char)[0] not in "MZC"
        and char not in LOOKALIKE + HYPHENS
        and not invisible.match(char)
    ]
    return r"\x00-\x7F" + "".join(rf"\x{{{code:X}}}" for code in codes)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _expansions(chars: list[str], most: int = 200) -> list[str]:
    """SQL expressions, to be applied to t in turn, that replace each of these compatibility characters by its decomposition."""
    single, several = [], []
    for char in sorted(chars):
        plain = unicodedata.normalize("NFKD", char)
        (single if len(plain) == 1 else several).append((char, plain))
    steps = []
    if single:
        steps.append(f"translate(t, {_quoted(''.join(a for a, _ in single))}, {_quoted(''.join(b for _, b in single))})")
    for k in range(0, len(several), most):  # SQL may not be nested without end
        sql = "t"
        for char, plain in several[k : k + most]:
            sql = f"replace({sql}, {_quoted(char)}, {_quoted(plain)})"
        steps.append(sql)
    return steps


class ConsistentForm:
    """Maps Arrow string arrays to their consistent form with a DuckDB of its own; one for each task."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})

    def __call__(self, texts: pa.Array) -> pa.Array:
        odd = pc.match_substring_regex(texts, f"[^{_unchanged_class()}]")
        if not pc.any(odd).as_py():
            return texts
        where = pc.indices_nonzero(pc.fill_null(odd, False))
        batch = pa.table({"i": where.cast(pa.int64()), "t": texts.take(where)})
        self.con.register("batch", batch)
        found = self.con.execute(
            f"SELECT DISTINCT unnest(regexp_extract_all(t, '[{compatibility_class()}]')) FROM batch"
        ).fetchall()
        steps = [f"regexp_replace(t, '[{INVISIBLE}]', '', 'g')", *_expansions([x for x, in found])]
        steps.append(rf"nfc_normalize(translate(regexp_replace(t, '\p{{Z}}', ' ', 'g'), '{HYPHENS}', '---'))")
        source = "batch"
        for sql in steps:
            source = f"(SELECT i, {sql} AS t FROM {source})"
        run = (
            r"CASE WHEN regexp_matches(x, '\p{Latin}') "
            f"THEN translate(x, {_quoted(LOOKALIKE)}, {_quoted(LATIN)}) ELSE x END"
        )
        form = self.con.sql(
            f"""
            SELECT CASE WHEN regexp_matches(t, '[{LOOKALIKE}]')
                        THEN nfc_normalize(array_to_string(list_transform(
                             regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda x: {run}), ''))
                        ELSE t END AS t
            FROM {source} ORDER BY i"""
        ).to_arrow_table()
        self.con.unregister("batch")
        flat = form["t"].combine_chunks().cast(texts.type)
        return pc.replace_with_mask(texts, pc.fill_null(odd, False), flat)


def consistent_form(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """df with the consistent form of `column` in `out` (a new last column, or `column` itself when not given).

    Null stays null and empty text empty. Rows, their order within a partition and all other columns are kept, whatever
    their names; `out` must not name another column. Equal texts have equal forms; no row is dropped or joined.
    """
    out = out or column
    if out != column and out in df.columns:
        raise ValueError(f"there is a column {out} already")
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = ConsistentForm()
        for batch in batches:
            arrays, new = list(batch.columns), form(batch.column(at))
            if out == column:
                arrays[at] = new
            else:
                arrays.append(new)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    schema = df.schema if out == column else T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(run, schema)


def words_of(text: str) -> list[str]:
    """The words of a consistent text: runs of letters or digits, in lower case."""
    return _WORD(text.lower())


_WORD: Callable[[str], list[str]] = re.compile(r"[^\W_]+").findall
