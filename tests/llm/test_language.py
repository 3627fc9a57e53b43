import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from quirework.llm.language import TABLE, _features, LANGUAGES, Labeller, fit, fit_on, label_documents, label_paragraphs, marginals, named_language, paragraphs

SENTENCES = {
    "en": ["the results show that our model is better than the others", "we train it with more data and without labels", "this is what they found in the tables", "there are many open questions about these methods"],
    "de": ["die ergebnisse zeigen dass unser modell besser ist als die anderen", "wir trainieren es mit mehr daten und ohne etiketten", "das ist was sie in den tabellen fanden", "es gibt viele offene fragen zu diesen verfahren"],
    "fr": ["les résultats montrent que notre modèle est meilleur que les autres", "nous l'entraînons avec plus de données et sans étiquettes", "voilà ce qu'ils ont trouvé dans les tableaux", "il y a beaucoup de questions ouvertes sur ces méthodes"],
    "es": ["los resultados muestran que nuestro modelo es mejor que los otros", "lo entrenamos con más datos y sin etiquetas", "esto es lo que encontraron en las tablas", "hay muchas preguntas abiertas sobre estos métodos"],
    "it": ["i risultati mostrano che il nostro modello è migliore degli altri", "lo addestriamo con più dati e senza etichette", "questo è ciò che hanno trovato nelle tabelle", "ci sono molte domande aperte su questi metodi"],
    "pt": ["os resultados mostram que o nosso modelo é melhor do que os outros", "nós o treinamos com mais dados e sem rótulos", "isto é o que eles encontraram nas tabelas", "há muitas perguntas abertas sobre estes métodos"],
}


@pytest.fixture(scope="module")
def model():
    return fit([(lang, s) for lang, ss in SENTENCES.items() for s in ss], [(lang, ". ".join(ss)) for lang, ss in SENTENCES.items()])


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    k, sizes = 3, np.array([4, 1, 5, 4])
    e, t = rng.normal(size=(sizes.sum(), k)), rng.normal(size=(k, k))
    p, pairs, log = marginals(e, sizes, t)
    due, due_pairs, due_log, at = np.zeros_like(e), np.zeros((k, k)), 0.0, 0
    for n in sizes:
        paths = list(product(range(k), repeat=int(n)))
        w = np.array([np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        due_log += np.log(w.sum())
        for path, x in zip(paths, w / w.sum()):
            for i, y in enumerate(path):
                due[at + i, y] += x
            for a, b in zip(path, path[1:]):
                due_pairs[a, b] += x
        at += n
    assert np.allclose(p, due) and np.allclose(pairs, due_pairs) and np.isclose(log, due_log)


def test_held_out_sentences():
    samples = Path("/root/testdata/sf0.001/lang_samples.parquet")
    if not samples.exists():
        pytest.skip("no sample sentences here")
    rows = pq.read_table(samples).sort_by("sample_id").to_pylist()
    model = fit([(r["lang"], r["sample_text"]) for r in rows[::2]], [])
    got = Labeller(model)([r["sample_text"] for r in rows[1::2]])
    assert sum(LANGUAGES[k] == r["lang"] for r, (k, _, _) in zip(rows[1::2], got)) >= 0.95 * len(got)


def test_names():
    assert [named_language(x) for x in ("EN", "en_GB", "pt-BR", "German", "français", " it ", "eng", None, "", "und", "unknown", "nl")] == ["en", "en", "pt", "de", "fr", "it", "en"] + [None] * 5


def test_paragraphs():
    assert paragraphs("\n a b\nc\n \t\n\nd\n \ne ") == ["a b\nc", "d", "e"]
    assert paragraphs(" \n ") == paragraphs("") == []


def test_labels(spark, model):
    s = SENTENCES
    mixed = f"{s['en'][0]}. {s['en'][1]}.\n\n12 ± 4 | Korvast\n\n{s['de'][0].upper()}.\n\n{s['fr'][2]}. {s['fr'][3]}. {s['de'][3]}"
    rows = [(1, mixed, "en"), (2, s["es"][0], "Spanish"), (2, s["es"][0], "Spanish"), (3, None, "en"), (4, "", "en"), (5, " \n\n 1 2 3 Xaver-4 ", "it"), (6, "it is what it is. " * 20_000, None)]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "doc_id int, text string, lang string, named string")
    got = label_paragraphs(df, model, "doc_id", "text", "lang")
    assert {(r["doc_id"], r["para_no"], r["lang"], r["named"]) for r in got.collect()} == {(1, 1, "en", "en"), (1, 3, "de", "en"), (1, 4, "fr", "en"), (2, 1, "es", "es"), (6, 1, "en", None)}
    assert got.count() == 6 and all(0 < r["confidence"] <= 1 for r in got.collect())
    docs = {r["doc_id"]: r for r in label_documents(got).collect()}
    assert docs[1]["n_languages"] == 3 and docs[2]["lang"] == "es" and docs[6]["confidence"] > 0.9
    assert label_paragraphs(df.limit(0), model, "doc_id", "text", "lang").count() == 0


def test_more_words_than_are_remembered(model):
    """A text with more different words than are remembered is labelled as a whole, as any other, and so are the texts around it."""
    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("abdeilmnorstu"), 7)) for _ in range(60)) + " " + SENTENCES["de"][0]
    texts = [SENTENCES["en"][0], long, SENTENCES["fr"][1], long, SENTENCES["es"][2]]
    small = Labeller(model)
    small.remembered = 20
    assert [x[0] for x in small(texts)] == [x[0] for x in Labeller(model)(texts)]
    assert all(abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] for a, b in zip(small(texts), Labeller(model)(texts)))


def test_features_of_long_words():
    """The endings of long words count: words of 40 letters that differ in the last letters differ in 4-grams of them."""
    word = "datenschutzgrundverordnungsumsetzungsgesetz"
    last = [zlib.crc32(x.encode()) % TABLE for x in ("4etz$", "3tz$", "4setz")]
    assert set(last) <= set(_features(word)) and len(_features(word)) > 60


def test_no_samples(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en")], "d long, t string, l string")
    samples = spark.createDataFrame([(1, "xx", "no known language"), (2, None, None)], "sample_id long, lang string, sample_text string")
    for s in (samples, samples.limit(0)):
        model = fit_on(s, docs, "t", "l", "d")
        assert model is None and label_documents(label_paragraphs(docs, model, "d", "t", "l")).count() == 0
