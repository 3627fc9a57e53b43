"""Text keys as column expressions: they run inside Spark's generated code, without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that are no terms.
STOP_WORDS = (
    "a an the of in on for to and or is are was were with by at as that this these those which what who how many does do did it its "
    "be been being from into than then we our their paper papers using used use based via not no can will have has had such each "
    "between among about over under across vs"
).split()
# Words of an expansion that an alias may skip.
SKIPPED_IN_EXPANSIONS = "of for and the a an to in on or with per at by from via over".split()
# Numbers of papers in words.
COUNT_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
# Words between a number and `papers` that make it the number of something else.
COUNT_BLOCKERS = (
    "of in on from by with using against versus per for value values result results score scores trial trials scene scenes sample samples "
    "task tasks keyframe keyframes text texts stage stages module modules part parts type types mask masks image images object objects "
    "iteration iterations matrice matrices equation equations hypotheses prompt prompts timestep timesteps"
).split()
#: Of these only the unhyphenated form counts (`in`, not `in-context`).
PREPOSITIONS = COUNT_BLOCKERS[:11]
ASCII_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space, as Unicode has it, around it."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def terms(text: Column | str) -> Column:
    """Array of terms, in order: runs of [a-z0-9] in lower case, of two characters or more, no stop words. Null: empty."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    return F.filter(runs, lambda t: ~t.isin(STOP_WORDS))


def normalized_title(title: Column | str) -> Column:
    """Lower case, white space collapsed, without ASCII punctuation around it."""
    flat = F.trim(F.regexp_replace(_c(title), r"\s+", " "))
    return F.regexp_replace(F.lower(flat), rf"^[{ASCII_PUNCTUATION} ]+|[{ASCII_PUNCTUATION} ]+$", "")


def squashed(text: Column | str) -> Column:
    """Lower case without white space, hyphens and dashes."""
    return F.regexp_replace(F.lower(_c(text)), r"[\s\-‐-―]+", "")


def squash_keys(title: Column | str) -> Column:
    """The squashed title and, if there is a colon, the part before it; without empty keys."""
    t = _c(title)
    head = F.when(t.contains(":"), squashed(F.substring_index(t, ":", 1)))
    return F.filter(F.array_distinct(F.array_compact(F.array(squashed(t), head))), lambda k: k != "")


def initialism(title: Column | str) -> Column:
    """Upper-case first letters of the words that are no stop words."""
    words = F.split(F.trim(F.regexp_replace(_c(title), r"\s+", " ")), " ")
    bare = lambda w: F.regexp_replace(F.lower(w), rf"^[{ASCII_PUNCTUATION}]+|[{ASCII_PUNCTUATION}]+$", "")
    kept = F.filter(words, lambda w: (bare(w) != "") & ~bare(w).isin(STOP_WORDS))
    return F.upper(F.array_join(F.transform(kept, lambda w: F.regexp_extract(w, r"([A-Za-z])", 1)), ""))


def alias_key(text: Column | str) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\p{L}\p{N}]", ""))


def identity_text(text: Column | str) -> Column:
    """All runs of [a-z0-9] in lower case, put together."""
    return F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]", "")


def sequence_text(text: Column | str) -> Column:
    """All runs of [a-z0-9] in lower case, between single spaces, with a space at each end: containment is on whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def contains_words(text: Column, words: Column) -> Column:
    """Whether the sequence text holds the other, which has words, as whole words."""
    return (F.length(words) > 2) & text.contains(words)


def venue_of(paper_id: Column | str) -> Column:
    """The letters before the year at the begin of an id; null where there are none."""
    return F.nullif(F.regexp_extract(_c(paper_id), r"^([a-z]+)\d{4}", 1), F.lit(""))


def year_of(paper_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(paper_id), r"^[a-z]+(\d{4})", 1), F.lit(""))


def number_or_null(text: Column | str) -> Column:
    """A finite number; anything else, truth values and NaN too, is null."""
    t = F.trim(_c(text))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.try_cast(t, "double") if hasattr(F, "try_cast") else t.try_cast("double"))


def flat_text(text: Column | str) -> Column:
    """For equality of answers: lower case, without quotes around it, white space collapsed."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"\s+", " "))
    return F.trim(F.regexp_replace(flat, r"^[\"']+|[\"']+$", ""))


def visible_id(value: Column | str, prefix: str) -> Column:
    """`Table 4`, `Tab. 4` and `4` become `table 4`; ids with letters or dots in them are kept, in lower case."""
    v = F.lower(F.trim(_c(value)))
    short = prefix[:3]
    n = F.regexp_extract(v, rf"^(?:{prefix}|{short}\.?)?\s*(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit(prefix + " "), n)).otherwise(F.regexp_replace(v, r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def clamped(confidence: Column | str) -> Column:
    """Between 0 and 1; what is no number is 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number_or_null(_c(confidence).cast("string")), F.lit(0.5))))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0
