"""Finds passages of held-out evaluation items in a corpus.

The passages are the windows of `window` consecutive words of each item, the candidates all windows of that length of
each document, and of up to `edits` words fewer or more, as words may be left out or put in. A random walk over the words of a window (the embedding of Chakraborty, Goldenberg and Koucky) turns edit
distance between windows into Hamming distance between walks. Keys of a few sampled positions of the walk find candidate
pairs, repeated often enough for the recall wanted; the exact edit distance decides. Equal windows have equal walks, so
passages without an edit are found always, those with `edits` edits with probability (see tests) over 0.9.

Items are the query set: they are taken in blocks of bounded size, each block a broadcast index against which all
documents stream once. Nothing is shuffled and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .consistent import ConsistentForm, words_of

#: Characters of items in one broadcast index; more items are taken in further blocks.
CHARS_PER_BLOCK = 8_000_000
WALKS, SAMPLES, BITS = 4, 3, 12


@dataclass
class _Index:
    window: int
    edits: int
    words: dict[str, int]
    passages: np.ndarray  # distinct windows, a row each
    owner_of: np.ndarray  # items of the passages, flat
    owner_at: np.ndarray  # offsets into owner_of
    steps: list[np.ndarray]  # for each walk: does it advance at this step on this word
    sampled: list[list[np.ndarray]]  # for each walk: the positions of each key
    keys: list[list[np.ndarray]]
    rows: list[list[np.ndarray]]


def _walk(windows: np.ndarray, steps: np.ndarray, end: int) -> np.ndarray:
    """The words that the walk stands on at each step; past the end it stands on the symbol `end`."""
    n, w = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), end, windows.dtype)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    seen = np.empty((steps.shape[0], n), windows.dtype)
    for j, step in enumerate(steps):
        seen[j] = padded[rows, np.minimum(at, w)]
        at += step[seen[j]]
    return seen


_MIX = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _key(seen: np.ndarray, positions: np.ndarray) -> np.ndarray:
    key = np.zeros(seen.shape[1], np.uint64)
    for k, p in enumerate(positions):
        key = (key ^ seen[p].astype(np.uint64)) * _MIX[k]
        key ^= key >> np.uint64(29)
    return key


def _steps(words: list[str], walk: int, length: int, ends: int = 0) -> np.ndarray:
    """If the walk goes on from each word at each step: it depends on the word alone, whatever else is in a block."""
    h = np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words] + list(range(ends)), np.uint64)
    x = h[None, :] + (np.arange(length, dtype=np.uint64)[:, None] + np.uint64(1 + walk * length)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(63)).astype(np.int64)


def build_index(items: list[tuple[int, str]], window: int, edits: int, seed: int = 7) -> _Index:
    words: dict[str, int] = {}
    forms = ConsistentForm()(pa.array([t for _, t in items], pa.string())).to_pylist()
    owners: dict[bytes, set[int]] = {}
    for (item, _), text in zip(items, forms):
        ids = np.array([words.setdefault(w, len(words)) for w in words_of(text)], np.int32)
        for i in range(len(ids) - window + 1):
            owners.setdefault(ids[i : i + window].tobytes(), set()).add(item)
    passages = np.frombuffer(b"".join(owners), np.int32).reshape(-1, window) if owners else np.empty((0, window), np.int32)
    lists = [sorted(x) for x in owners.values()]
    rng = np.random.default_rng(seed)
    length = 3 * window
    # The alphabet: the items' words, one symbol for others, one for the end.
    steps = [_steps(list(words), k, length, 2) for k in range(WALKS)]
    sampled = [[np.sort(rng.choice(length, BITS, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
    keys, rows = [], []
    for walk, positions in zip(steps, sampled):
        seen = _walk(passages, walk, len(words) + 1)
        made = [_key(seen, p) for p in positions]
        order = [np.argsort(k, kind="stable") for k in made]
        keys.append([k[o] for k, o in zip(made, order)])
        rows.append(order)
    return _Index(window, edits, words, passages, np.array([i for x in lists for i in x], np.int64), np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64), steps, sampled, keys, rows)


def _edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Word edit distances of the rows of a and b, exact up to `most`, else above it."""
    (n, w), v = a.shape, b.shape[1]
    big = most + 1
    row = np.full((v + 1, n), big, np.int16)
    row[: most + 1] = np.arange(min(most, v) + 1, dtype=np.int16)[:, None]
    for i in range(1, w + 1):
        new = np.full((v + 1, n), big, np.int16)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(v, i + most) + 1):
            new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = np.minimum(new, big)
    return row[v]


def _near(index: _Index, steps: list[np.ndarray], ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, item and edit distance of the windows of `size` words that are within the index's edits of a passage."""
    none = (np.empty(0, np.int64),) * 3
    if not len(starts):
        return none
    windows = ids[starts[:, None] + np.arange(size)]
    distinct, place = np.unique(windows, axis=0, return_inverse=True)
    pairs = []
    for walk, positions, keys, rows in zip(steps, index.sampled, index.keys, index.rows):
        seen = _walk(distinct, walk, len(index.words) + 1)
        for p, k, r in zip(positions, keys, rows):
            mine = _key(seen, p)
            lo = np.searchsorted(k, mine, "left")
            n = np.searchsorted(k, mine, "right") - lo
            if n.any():
                left = np.repeat(np.arange(len(mine)), n)
                right = r[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                pairs.append(left * len(index.passages) + right)
    if not pairs:
        return none
    pair = np.sort(np.concatenate(pairs))
    pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
    left, right = np.divmod(pair, len(index.passages))
    far = _edit_distances(distinct[left], index.passages[right], index.edits)
    near = far <= index.edits
    left, right, far = left[near], right[near], far[near].astype(np.int64)
    if not len(left):
        return none
    # From pairs of distinct windows to pairs of a place and an item.
    n = index.owner_at[right + 1] - index.owner_at[right]
    left, far = np.repeat(left, n), np.repeat(far, n)
    item = index.owner_of[np.repeat(index.owner_at[right] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(len(distinct) + 1))
    n = first[left + 1] - first[left]
    start = starts[order[np.repeat(first[left] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]]
    return start, np.repeat(item, n), np.repeat(far, n)


def _match(index: _Index, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, item, least edit distance of a window, number of windows' starts; one row a text and item."""
    get, other, w = index.words.get, len(index.words), index.window
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    total = int(sizes.sum())
    none = (np.empty(0, np.int64),) * 4
    if not len(index.passages):
        return none
    ids = np.fromiter((get(x, other) for words in lists for x in words), np.int32, total)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    known = np.r_[0, np.cumsum(ids != other)]
    found, begun = [], []
    for size in range(max(1, w - index.edits), min(total, w + index.edits) + 1):
        # A window within `edits` edits of a passage has at most so many words that are in no item; each word short is an edit.
        unknown = index.edits - max(0, w - size)
        starts = np.flatnonzero((known[size:] - known[:-size] >= size - unknown) & (text_of[: total - size + 1] == text_of[size - 1 :]))
        begun.append((size, starts))
    # Words of these windows that are in no item are symbols of their own.
    strange = np.unique(np.concatenate([(starts[:, None] + np.arange(size)).ravel() for size, starts in begun] or [np.empty(0, np.int64)]))
    strange = strange[~(np.diff(known)[strange].astype(bool))]
    steps = index.steps
    if len(strange):
        begins = np.r_[0, np.cumsum(sizes)]
        extra: dict[str, int] = {}
        for at in strange.tolist():
            t = int(text_of[at])
            ids[at] = other + 2 + extra.setdefault(lists[t][at - begins[t]], len(extra))
        steps = [np.concatenate([s, _steps(list(extra), k, len(s))], axis=1) for k, s in enumerate(steps)]
    for size, starts in begun:
        found.append(_near(index, steps, ids, starts, size))
    if not found:
        return none
    start, item, far = (np.concatenate(x) for x in zip(*found))
    text = text_of[start]
    order = np.lexsort((far, start, item, text))
    text, item, far, start = text[order], item[order], far[order], start[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])] if len(text) else np.empty(0, bool)
    edge = np.flatnonzero(new)
    if not len(edge):
        return none
    other_start = np.r_[True, (start[1:] != start[:-1])] | new
    return text[edge], item[edge], np.minimum.reduceat(far, edge), np.add.reduceat(other_start.astype(np.int64), edge)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int = 13, edits: int = 1, chars_per_block: int = CHARS_PER_BLOCK
) -> DataFrame:
    """One row for each document row and item that share a passage: doc_id, item_id, edits, n_windows.

    A passage is shared if some consecutive words of the document are within `edits` word edits (a word replaced, put in or
    left out) of `window` consecutive words of the item; edits is the least number of them (0: the words are the same),
    n_windows the number of places in the document where such words begin. Words are runs of letters or digits in the
    lower-cased consistent form. Items of fewer than `window` words share nothing, nor do documents of fewer than `window` -
    `edits`; null and empty texts likewise. Repeated documents are reported
    each, repeated items once; an item_id with several texts counts as one item. item_id must be an integer.
    """
    spark = docs.sparkSession
    rows = items.select(items[item_id].cast("long").alias("item_id"), items[item_text].alias("item_text")).where("item_text is not null and item_id is not null")
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("n_windows", T.LongType())])
    left = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).where("text is not null")
    result = spark.createDataFrame([], schema)
    block: list[tuple[int, str]] = []
    size = 0

    def against(block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_index(block, window, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            form, index = ConsistentForm(), shared.value
            for batch in batches:
                t, item, far, n = _match(index, form(batch.column(1)).to_pylist())
                if len(t):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(item), pa.array(far), pa.array(n)], names=schema.names)

        return left.mapInArrow(run, schema)

    parts = []
    for row in rows.orderBy("item_id").toLocalIterator():  # a block of bounded size at a time; all texts of an item are in one block
        if size >= chars_per_block and block[-1][0] != row["item_id"]:
            parts.append(against(block))
            block, size = [], 0
        block.append((row["item_id"], row["item_text"]))
        size += len(row["item_text"])
    if block:
        parts.append(against(block))
    for part in parts:
        result = part if part is parts[0] else result.unionByName(part)
    return result
