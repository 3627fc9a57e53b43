"""Cuts oversized texts into pieces at natural boundaries, each piece repeating the end of the one before.

One regular expression with bounded quantifiers does the cutting inside Spark's own code. Its alternatives are ordered by
the strength of the boundary (end of text; paragraph end or sentence end in the second half of the piece; paragraph or
sentence end anywhere; between two words) and each takes as many words as the limit allows, so every match is one piece
and the matches together are the text. Array functions look back from each cut for the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: White space as Unicode has it; a word is a run of anything else.
_WORD, _GAP = r"\S++", r"\s*+"
_UNIT = rf"(?:{_WORD}{_GAP})"
#: A line end, then blank lines only.
_BLANK_LINE = r"(?:[^\S\n]*+\n){2,}+\s*+"
_PARAGRAPH = rf"{_WORD}{_BLANK_LINE}"
_SENTENCE = rf"{_WORD}(?<=[.!?])\s++"
#: Between two of these there is no natural boundary.
_STRETCH_END = r"(?U)(?<=[.!?])\s+|[^\S\n]*\n[^\S\n]*\n\s*"
#: The engine keeps a frame for each repetition.
MOST_WORDS = 1000


def _alternatives(most: int) -> str:
    half = most // 2
    return "|".join(
        [
            rf"{_UNIT}{{0,{most - 1}}}{_WORD}{_GAP}\z",
            rf"{_UNIT}{{{half},{most - 1}}}{_PARAGRAPH}",
            rf"{_UNIT}{{{half},{most - 1}}}{_SENTENCE}",
            rf"{_UNIT}{{0,{half}}}{_PARAGRAPH}",
            rf"{_UNIT}{{0,{half}}}{_SENTENCE}",
            rf"{_UNIT}{{1,{most}}}",
        ]
    )


def split_oversized(df: DataFrame, text: str, limit: int, overlap: int, keep: list[str]) -> DataFrame:
    """One row for each text of more than `limit` words: the columns in `keep`, n_words, cut_kind, pieces.

    pieces: array of struct(piece_no from 1, overlap, fresh, cut), in order. The piece is overlap and fresh together, at
    most `limit` words; overlap repeats the last `overlap` words before the cut (all, where there are fewer); the fresh
    parts of all pieces, white space included, are exactly the text. cut says what the piece ends with: `end`,
    `paragraph`, `sentence` or `word`. cut_kind is `forced` if some stretch between blank lines and sentence ends (`.`,
    `!` or `?` before white space) has more than `limit` words, else `natural`.

    Null, empty and blank texts, and texts within the limit, are no rows; repeated rows are each split. Other columns are
    ignored. A single word is never cut, however long. 0 <= overlap < limit <= MOST_WORDS.
    """
    if not 0 <= overlap < limit <= MOST_WORDS:
        raise ValueError("0 <= overlap < limit <= MOST_WORDS must hold")
    first, later = _alternatives(limit), _alternatives(limit - overlap)
    pattern = rf"(?U)\A\s*+(?:{first})|(?:{later})"
    words = r"(?U)\S+"
    # Bound as a lambda's argument, the matches are computed once a text.
    before = "''" if not overlap else (
        f"reverse(regexp_extract(reverse(if(k = 2 or regexp_count(m[k - 2], r'{words}') >= {overlap}, m[k - 2], "
        f"array_join(slice(m, greatest(1, k - {overlap}), k - greatest(1, k - {overlap})), ''))), "
        rf"r'(?U)^(?:\s*+\S++){{1,{overlap}}}', 0))"
    )
    pieces = rf"""
        transform(array(regexp_extract_all(__text, r'{pattern}', 0)), m -> transform(sequence(1, size(m)), k -> named_struct(
            'piece_no', k,
            'overlap', if(k = 1, '', {before}),
            'fresh', m[k - 1],
            'cut', case when k = size(m) then 'end'
                        when m[k - 1] rlike r'(?U)\n[^\S\n]*+\n\s*\z' then 'paragraph'
                        when m[k - 1] rlike r'(?U)[.!?]\s+\z' then 'sentence'
                        else 'word' end)))[0]"""
    least = 2 * limit + 1  # characters that more than `limit` words need
    forced = rf"exists(split(__text, r'{_STRETCH_END}'), x -> length(x) >= {least} and regexp_count(x, r'{words}') > {limit})"
    rows = df.select(*[df[c].alias(f"__{i}") for i, c in enumerate(keep)], df[text].alias("__text")).where(f"length(__text) >= {least}")
    rows = rows.withColumn("__n", F.expr(f"regexp_count(__text, r'{words}')")).where(f"__n > {limit}")
    return rows.select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)],
        F.col("__n").alias("n_words"),
        F.expr(f"if({forced}, 'forced', 'natural')").alias("cut_kind"),
        F.expr(pieces).alias("pieces"),
    )
