import random
import sys
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import regex

from quirework.llm.consistent import HYPHENS, INVISIBLE, LATIN, LOOKALIKE, ConsistentForm, consistent_form

_GONE = regex.compile("[" + regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE) + "]")
_SAME = str.maketrans(LOOKALIKE, LATIN)


def plain(text):
    """The definition, by the standard library."""
    text = unicodedata.normalize("NFKC", _GONE.sub("", text))
    text = regex.sub(r"\p{Z}", " ", text)
    text = unicodedata.normalize("NFC", regex.sub(f"[{HYPHENS}]", "-", text))
    run = lambda m: m[0].translate(_SAME) if regex.search(r"\p{Latin}", m[0]) else m[0]
    return unicodedata.normalize("NFC", regex.sub(r"[\p{L}\p{M}]+", run, text))


CASES = {
    "Ｆｉｇｕｒе １": "Figure 1",
    "ﬁne\u00a0ﬂow": "fine flow",
    "cafe\u0301": "café",
    "cаf\u0435\u0301": "café",
    "so\u00adft\u200b ze\u2060ro\ufeff": "soft zero",
    "a\u2010b\u2011c\u2212d – e": "a-b-c-d – e",
    "проект α and β-net": "проект α and β-net",
    "Таblе": "Table",
    "": "",
    "plain": "plain",
    "\u212a\u212b": "KÅ",
}


def test_cases():
    form = ConsistentForm()
    got = form(pa.array([*CASES, None])).to_pylist()
    assert got == [*CASES.values(), None]
    assert form(pa.array([*CASES.values()])).to_pylist() == [*CASES.values()]


def test_against_the_standard_library():
    rng, pool = random.Random(5), [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    pool += list("abcdeXYZ .-") * 300 + list(LOOKALIKE) * 20 + ["\u200b", "\u0301", "ﬁ", "Ａ"] * 30
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(3000)]
    form = ConsistentForm()
    got = form(pa.array(texts)).to_pylist()
    wrong = [(a, b, plain(a)) for a, b in zip(texts, got) if b != plain(a)]
    assert not wrong, wrong[:3]
    assert form(pa.array(got)).to_pylist() == got


def test_every_compatibility_character():
    form = ConsistentForm()
    chars = [c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)]) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)]
    got = form(pa.array(chars)).to_pylist()
    assert [c for c, g in zip(chars, got) if g != plain(c)] == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "Ａ", "x"), (2, None, None), (3, "", "y"), (3, "", "y"), (4, "ｘ" * 100_000, "z")], "id int, text string, form string")
    got = {(r["id"], r["new"]) for r in consistent_form(df, "text", "new").collect()}
    assert got == {(1, "A"), (2, None), (3, ""), (4, "x" * 100_000)}
    assert consistent_form(df, "text").count() == 5
    assert consistent_form(df.limit(0), "text").columns == df.columns
    assert consistent_form(df.select("id", "text", F.lit(1).alias("i"), F.lit("t").alias("t")), "text").where("i = 1 and t = 't'").count() == 5
    with pytest.raises(ValueError):
        consistent_form(df, "text", "form")
