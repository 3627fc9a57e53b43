"""Languages of documents and paragraphs by a linear-chain conditional random field over their words.

A word's features are the word itself (the lexicon), its affixes and its character n-grams, hashed to a table of fixed
size; transitions between languages are learned from sequences of sentences that change language. Forward-backward gives
each word the probability of each language in its context, so words that several languages share follow their neighbours
and a text may change language anywhere. Only ordinary words count: words of the lexicon, or written in small letters.
Coined names, numbers and symbols belong to no language.

The model is fitted on the driver in two steps: on sample sentences of known language, then also on paragraphs of a
bounded number of labelled documents (`LABELLED` a language, chosen by hash) for which the first model confirms the label.
All documents are labelled by it, in Arrow batches, whole.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Labelled documents for each language that the model may be fitted on, and the words of them that it uses.
LABELLED, TRAINING_WORDS = 150, 120_000
TABLE = 1 << 15
# How each language is named (two- and three-letter codes, English and own names).
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
}
LANGUAGES = sorted(NAMES)
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}
_LETTERS = re.compile(r"[^\W\d_]+").findall


def named_language(label: str | None) -> str | None:
    """The two-letter code of the language that a label names, in any spelling, with or without a region; else null."""
    parts = re.split(r"[\W_]+", (label or "").strip().lower(), maxsplit=1)
    return _CODE.get(parts[0])


def paragraphs(text: str) -> list[str]:
    """The parts of a text between blank lines; a line of blanks only is blank."""
    text = text.strip()
    return re.split(r"\n\s*\n", text) if text else []


def _features(word: str) -> list[int]:
    w = f"^{word}$"
    names = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3, 4))]
    names += [f"{n}{w[i : i + n]}" for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode()) % TABLE for x in set(names)]


@dataclass
class LanguageModel:
    weights: np.ndarray  # table x languages
    transitions: np.ndarray  # from x to, logarithms
    lexicon: frozenset[str]

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LANGUAGES)))
        for k, word in enumerate(words):
            out[k] = self.weights[_features(word)].sum(axis=0)
        return out


def marginals(emissions: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over sequences that lie one after another: each word's probabilities, the expected numbers of
    transitions, and the sum of the logarithms of the sequences' normalisers. No sequence may be empty."""
    n, k = emissions.shape
    top = emissions.max(axis=1, keepdims=True)
    e, t = np.exp(emissions - top), np.exp(transitions)
    order = np.argsort(-sizes, kind="stable")
    first = np.r_[0, np.cumsum(sizes)[:-1]][order]
    longest = int(sizes.max()) if len(sizes) else 0
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    ahead = np.empty_like(e)
    log = float(top.sum())
    a = None
    for step in range(longest):
        m = active[step]
        at = first[:m] + step
        a = e[at] if a is None else (a[:m] @ t) * e[at]
        norm = a.sum(axis=1, keepdims=True)
        log += float(np.log(norm).sum())
        a = a / norm
        ahead[at] = a
    out, pairs = np.empty_like(e), np.zeros((k, k))
    b = np.empty((0, k))
    for step in range(longest - 1, -1, -1):
        m, later = active[step], len(b)
        at = first[:m] + step
        back = np.ones((m, k))
        if later:
            z = e[at[:later] + 1] * b
            back[:later] = z @ t.T
            x = ahead[at[:later]]
            total = ((x @ t) * z).sum(axis=1, keepdims=True)
            pairs += (x / total).T @ z * t
        b = back / back.sum(axis=1, keepdims=True)
        p = ahead[at] * b
        out[at] = p / p.sum(axis=1, keepdims=True)
    return out, pairs, log


def _ordinary(text: str, lexicon: frozenset[str] | set[str]) -> list[str]:
    return [low for w in _LETTERS(text) if (low := w.lower()) == w or low in lexicon]


def _fit(sentences: list[tuple[int, list[str]]], lexicon: frozenset[str], rounds: int, seed: int) -> LanguageModel:
    """Maximum conditional likelihood by AdaGrad, on sequences of sentences that now and then change language."""
    rng = random.Random(seed)
    by: dict[int, list[list[str]]] = {}
    for label, words in sentences:
        by.setdefault(label, []).append(words)
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    gold: list[int] = []
    sizes: list[int] = []
    waiting = {label: [] for label in by}
    budget = 2 * sum(len(w) for _, w in sentences)
    while len(ids) < budget:
        label, size = rng.choice(list(by)), 0
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.3:
                label = rng.choice(list(by))
            if not waiting[label]:  # each sentence in turn
                waiting[label] = rng.sample(by[label], len(by[label]))
            words = waiting[label].pop()
            ids += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            gold += [label] * len(words)
            size += len(words)
        sizes.append(size)
    words, k = list(vocabulary), len(LANGUAGES)
    features = [_features(w) for w in words]
    flat, ends = np.concatenate([np.array(f) for f in features]), np.cumsum([len(f) for f in features])
    starts, owner = np.r_[0, ends[:-1]], np.repeat(np.arange(len(words)), [len(f) for f in features])
    ids_, gold_, sizes_ = np.array(ids), np.array(gold), np.array(sizes)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(sizes_)[:-1]] = False
    inside[0] = False
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (gold_[:-1][inside[1:]], gold_[1:][inside[1:]]), 1)
    true_words = np.zeros((len(words), k))
    np.add.at(true_words, (ids_, gold_), 1)
    weights, trans = np.zeros((TABLE, k)), np.zeros((k, k))
    seen_w, seen_t = np.full_like(weights, 1e-6), np.full_like(trans, 1e-6)
    for _ in range(rounds):
        emission = np.add.reduceat(weights[flat], starts, axis=0)
        p, pairs, _ = marginals(emission[ids_], sizes_, trans)
        expected = np.stack([np.bincount(ids_, p[:, j], len(words)) for j in range(k)], axis=1)
        miss = (true_words - expected) / len(ids_)
        g = np.stack([np.bincount(flat, miss[owner, j], TABLE) for j in range(k)], axis=1) - 1e-6 * weights
        gt = (true_pairs - pairs) / len(ids_) - 1e-6 * trans
        seen_w += g * g
        seen_t += gt * gt
        weights += 0.05 * g / np.sqrt(seen_w)
        trans += 0.05 * gt / np.sqrt(seen_t)
    return LanguageModel(weights, trans, lexicon)


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], rounds: int = 40, seed: int = 3) -> LanguageModel | None:
    """A model from (language, sentence) pairs and from (language, document) pairs whose labels may be wrong; without a sentence none."""
    first = frozenset(w for _, t in samples for w in _LETTERS(t) if w.islower())
    clean = [(LANGUAGES.index(lang), words) for lang, t in samples if lang in LANGUAGES and (words := _ordinary(t, first))]
    if not clean:
        return None
    model = _fit(clean, first, rounds, seed)
    parts = [(LANGUAGES.index(lang), p) for lang, t in labelled for p in paragraphs(t)]
    if not parts:
        return model
    labeller = Labeller(model)
    confirmed = [p for p, (k, share, n) in zip(parts, labeller([t for _, t in parts])) if n >= 5 and k == p[0] and share > 0.8]
    counts = Counter(w for _, t in confirmed for w in _LETTERS(t) if w.islower())
    lexicon = first | {w for w, n in counts.items() if n > 1}
    used, total = list(clean), 0
    random.Random(seed).shuffle(confirmed)
    for label, t in confirmed:
        for sentence in re.split(r"(?<=[.!?])\s+", t):
            if words := _ordinary(sentence, lexicon):
                used.append((label, words))
                total += len(words)
        if total > TRAINING_WORDS:
            break
    return _fit(used, lexicon, rounds, seed)


class Labeller:
    """Labels texts: number of the language, its share of the ordinary words, and their number; -1, 0.0, 0 without any."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.remembered = 300_000

    def _id(self, word: str) -> int:
        """The row of a word's emissions, or -1 for one that isn't ordinary."""
        low = word.lower()
        if low != word and low not in self.model.lexicon:
            return -1
        at = self.known.get(low)
        if at is None:
            if len(self.rows) > self.remembered:
                return -2
            at = self.known[low] = len(self.rows)
            self.rows.append(self.model.emissions([low])[0])
        self.known[word] = at
        return at

    def __call__(self, texts: list[str]) -> list[tuple[int, float, int]]:
        get, lists = self.known.get, []
        for text in texts:
            ids = []
            for word in _LETTERS(text):
                at = get(word)
                if at is None:
                    at = self._id(word)
                    if at == -2:  # too many different words to remember: start again, with this text
                        return self._apart(texts, lists)
                if at >= 0:
                    ids.append(at)
            lists.append(ids)
        return self._labels(lists)

    def _apart(self, texts: list[str], done: list[list[int]]) -> list[tuple[int, float, int]]:
        labels = self._labels(done)
        self.known, self.rows = {}, []
        rest = texts[len(done) :]
        if not done and len(rest) == 1:  # a single text with more different words: as long as it takes, they are remembered
            most, self.remembered = self.remembered, len(rest[0])
            whole = self(rest)
            self.known, self.rows, self.remembered = {}, [], most
            return labels + whole
        half = max(1, len(rest) // 2)
        return labels + self(rest[:half]) + (self(rest[half:]) if rest[half:] else [])

    def _labels(self, lists: list[list[int]]) -> list[tuple[int, float, int]]:
        sizes = np.array([len(x) for x in lists], np.int64)
        full = np.flatnonzero(sizes)
        out: list[tuple[int, float, int]] = [(-1, 0.0, 0)] * len(lists)
        if len(full):
            ids = np.concatenate([np.array(lists[i], np.int64) for i in full])
            p, _, _ = marginals(np.array(self.rows)[ids], sizes[full], self.model.transitions)
            mass = np.add.reduceat(p, np.r_[0, np.cumsum(sizes[full])[:-1]], axis=0)
            best = mass.argmax(axis=1)
            share = mass.max(axis=1) / sizes[full]
            for i, k, s in zip(full.tolist(), best.tolist(), share.tolist()):
                out[i] = (k, s, int(sizes[i]))
        return out


def fit_on(samples: DataFrame, docs: DataFrame, text: str, label: str, key: str, labelled: int = LABELLED) -> LanguageModel | None:
    """The model of these sample sentences (lang, sample_text) and of at most `labelled` documents a language."""
    known = [(r[0], r[1]) for r in samples.where("sample_text is not null").select("lang", "sample_text").orderBy("sample_id").collect()]
    known = [(code, t) for lang, t in known if (code := named_language(lang))]
    first = F.element_at(F.split(F.lower(F.trim(docs[label])), r"[^\p{L}\p{N}]"), 1)
    spelled = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    rows = docs.select(spelled[first].alias("code"), docs[text].alias("text"), F.xxhash64(docs[key].cast("string"), docs[text]).alias("h")).where("code is not null and text is not null")
    # A window over each language keeps only its first rows in every partition before anything moves.
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("h", "text"))).where(F.col("n") <= labelled)
    return fit(known, [(r["code"], r["text"]) for r in rows.orderBy("code", "n").collect()])


def label_paragraphs(docs: DataFrame, model: LanguageModel | None, key: str, text: str, label: str) -> DataFrame:
    """One row for each paragraph with an ordinary word: doc_id, para_no, lang, confidence, n_words, named.

    lang is the language of most of the paragraph's ordinary words, of equal ones the first by code; confidence its share of
    them, weighted by their probabilities; named the language that the document's label names, or null. Paragraphs are
    counted from 1, those without an ordinary word too. Null, empty and blank texts have none. Rows are labelled each,
    repeated ones too; other columns are ignored. Without a model (there was no sample) no paragraph has a language, and the
    result is empty.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, para_no int, lang string, confidence double, n_words int, named string"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            named = [named_language(x) for x in batch.column(2).to_pylist()]
            parts = [paragraphs(t) for t in batch.column(1).to_pylist()]
            sizes = [len(p) for p in parts]
            owner, number = np.repeat(np.arange(len(parts)), sizes), np.concatenate([np.arange(1, n + 1) for n in sizes] or [np.empty(0, int)])
            labels = labeller([p for ps in parts for p in ps])
            kept = [i for i, x in enumerate(labels) if x[2]]
            who = owner[kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who)), pa.array(number[kept].astype(np.int32)), pa.array([LANGUAGES[labels[i][0]] for i in kept], pa.string()), pa.array([labels[i][1] for i in kept], pa.float64()), pa.array([labels[i][2] for i in kept], pa.int32()), pa.array([named[i] for i in who], pa.string())],
                names=["doc_id", "para_no", "lang", "confidence", "n_words", "named"],
            )

    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), docs[label].alias("label")).where("text is not null")
    return rows.mapInArrow(run, schema)


def label_documents(labelled: DataFrame) -> DataFrame:
    """doc_id, lang, confidence, n_words, n_languages: of each document, from its paragraphs; the first code of equal ones."""
    each = labelled.groupBy("doc_id", "lang").agg(F.sum(F.col("confidence") * F.col("n_words")).alias("mass"), F.sum("n_words").alias("n"))
    first = F.max_by("lang", F.struct("mass", (-F.ascii("lang")).alias("a"), (-F.ascii(F.substr("lang", F.lit(2)))).alias("b")))
    return each.groupBy("doc_id").agg(first.alias("lang"), (F.max("mass") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_words"), F.count("*").alias("n_languages"))
