"""Toxicity by a classifier chain over hashed words.

The labels tell toxic from clean; the categories of the chain are derived from them with the
document's language, in the order of ``CATEGORIES``: toxic in English, toxic in another
language, toxic at all. A linear (logistic) model predicts each; besides the words of a document
it gets the probabilities of the categories before it. In training these are out-of-fold
predictions, so a later model learns how far an earlier one can be trusted on unseen rows.

Features are the distinct words of the whole text. A model keeps those that are more frequent
among its category's documents than chance explains, at most ``FEATURES``; the choice is made
anew within each fold. The models are fitted on at most ``SAMPLE`` labelled texts, distinct by
doc_id and text and chosen by a hash of doc_id; everything else covers all rows.

Cases: a null or empty text gives the probability without any word; a null label is no label;
of several labels of one document the toxic one holds, and each distinct text of a repeated
doc_id is trained on once; without any toxic label nothing is toxic; empty tables give no rows; columns
other than doc_id, text, lang and toxic are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from habitus.llm.store import empty_text
from habitus.llm.vocab import filled
from habitus.llm.words import mixed, words_of

CATEGORIES = ("toxic_english", "toxic_other", "toxic")
#: Most labelled rows used for fitting.
SAMPLE = 16_384
#: Most words of a model.
FEATURES = 512
FOLDS = 3
THRESHOLD = 0.5
#: Least excess of a word among a category's documents, in standard deviations.
EXCESS = 4.0
_RIDGE, _STEPS = 0.02, 150


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """A fitted category: words, their weights, weights of earlier categories, bias."""

    words: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def of(self, row: np.ndarray, word: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of documents given their distinct (row, word) entries."""
        total = self.bias + earlier @ self.chained
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            total = total + np.bincount(row[hit], self.weights[at[hit]], len(earlier))
        return _sigmoid(total)


def _fit(row: np.ndarray, code: np.ndarray, names: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """A ridge logistic model over the words that stand out among the positive rows.

    ``row``, ``code``: distinct words of each row, as places in ``names``.
    """
    n, chained = len(y), earlier.shape[1]
    if not y.any():
        return Linear(np.empty(0, np.uint64), np.empty(0), np.zeros(chained), -30.0)
    among = np.bincount(code, y[row], len(names))
    seen = np.bincount(code, minlength=len(names))
    rate = y.mean()
    excess = (among - rate * seen) / np.sqrt(rate * (1 - rate) * seen + 1e-9)
    chosen = np.flatnonzero((excess >= EXCESS) & (among >= 2))
    chosen = np.sort(chosen[np.lexsort((names[chosen], -excess[chosen]))][:FEATURES])
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    columns = place[code]
    use = columns >= 0
    rows, columns = row[use], columns[use]
    weights, links, bias = np.zeros(len(chosen)), np.zeros(chained), float(np.log(rate / (1.000001 - rate)))
    for _ in range(_STEPS):  # damped Newton steps on the diagonal
        p = _sigmoid(bias + earlier @ links + np.bincount(rows, weights[columns], n))
        error, slope = p - y, p * (1 - p)
        step = (np.bincount(columns, error[rows], len(chosen)) + _RIDGE * weights) / (
            np.bincount(columns, slope[rows], len(chosen)) + _RIDGE + 0.1
        )
        weights = weights - 0.5 * np.clip(step, -2, 2)
        links = links - 0.3 * np.clip(
            (earlier.T @ error + _RIDGE * links) / ((earlier**2).T @ slope + _RIDGE + 0.1), -2, 2
        )
        bias -= 0.3 * float(np.clip(error.sum() / (slope.sum() + 0.1), -2, 2))
    return Linear(names[chosen], weights, links, bias)


def fit_chain(
    row: np.ndarray, word: np.ndarray, targets: np.ndarray, fold: np.ndarray
) -> tuple[list[Linear], np.ndarray]:
    """The models of all categories, and the out-of-fold probabilities (rows x categories).

    ``row``, ``word``: distinct words of each row; ``targets``: 0 or 1 by row and category;
    ``fold``: fold of each row.
    """
    names, code, count = np.unique(word, return_inverse=True, return_counts=True)
    often = count[code] >= 2  # no model uses a word of a single row
    row, code = row[often].astype(np.int32), code[often].astype(np.int32)
    apart = np.zeros(targets.shape)
    chain = []
    for k in range(targets.shape[1]):
        earlier, y = apart[:, :k], targets[:, k].astype(float)
        for f in range(FOLDS):
            inside, held = fold != f, np.flatnonzero(fold == f)
            if not inside.any() or not len(held):
                continue
            use = inside[row]
            index = (np.cumsum(inside) - 1).astype(np.int32)
            model = _fit(index[row[use]], code[use], names, earlier[inside], y[inside])
            place = np.cumsum(~inside) - 1
            apart[held, k] = model.of(place[row[~use]], names[code[~use]], earlier[held])
        chain.append(_fit(row, code, names, earlier, y))
    return chain, apart


def _entries(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, row, word): distinct words of each text, of ``wanted`` only if given."""
    low = np.zeros(1 << 16, bool)
    if wanted is not None:
        low[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    for first, part, words in words_of(pc.utf8_lower(filled(texts)), plain=True):
        row = np.repeat(np.arange(len(part)), np.diff(words.first))
        word = words.hash
        if wanted is not None:
            use = low[(word & np.uint64(0xFFFF)).astype(np.int64)]
            row, word = row[use], word[use]
            use = np.isin(word, wanted)
            row, word = row[use], word[use]
        pairs = np.unique(np.stack([row.astype(np.uint64), word]), axis=1) if wanted is not None else None
        if pairs is not None:
            row, word = pairs[0].astype(np.int64), pairs[1]
        else:
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
            row, word = row[fresh], word[fresh]
        yield first, len(part), row, word


def labelled_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, english, toxic, words) of at most ``sample`` distinct (doc_id, text) with a label.

    Rows that repeat both are one, English if one of them is.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("english"), empty_text()
    ).join(F.broadcast(known), "doc_id").withColumn("hash", F.xxhash64("text"))
    # At most ``sample`` pairs, however many rows have one of the ids or one text.
    chosen = rows.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample)
    rows = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(
        F.max("english").alias("english"), F.max("toxic").alias("toxic"), F.max("text").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, row, word in _entries(batch.column(3)):
                ends = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, count) for i in range(3)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(word.view(np.int64))),
                    ],
                    names=["doc_id", "english", "toxic", "words"],
                )

    return rows.select(F.col("doc_id").cast("long"), "english", "toxic", "text").mapInArrow(
        run, "doc_id long, english boolean, toxic int, words array<long>"
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Linear]:
    """Fit the chain. The driver gets the distinct words of at most ``sample`` rows."""
    table = labelled_words(docs, labels, sample).toArrow().combine_chunks()
    order = np.lexsort((np.arange(len(table)), table["doc_id"].to_numpy()))
    english = table["english"].to_numpy()[order]
    toxic = table["toxic"].to_numpy()[order] > 0
    lists = table["words"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int64()))
    lists = lists.take(pa.array(order))
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    word = lists.flatten().to_numpy().view(np.uint64)
    fold = mixed(table["doc_id"].to_numpy()[order].view(np.uint64)) % np.uint64(FOLDS)
    del table, lists
    targets = np.stack([toxic & english, toxic & ~english, toxic], 1)
    return fit_chain(row, word, targets, fold.astype(int))[0]


def _chances(texts: pa.Array, chain: list[Linear]) -> np.ndarray:
    """Probabilities (texts x categories)."""
    out = np.zeros((len(texts), len(chain)))
    wanted = np.unique(np.concatenate([m.words for m in chain]))
    for first, count, row, word in _entries(texts, wanted):
        own = out[first : first + count]
        for k, model in enumerate(chain):
            own[:, k] = model.of(row, word, own[:, :k])
    return out


def score(docs: DataFrame, chain: list[Linear], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category> ..., toxic) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chances(batch.column(1), chain)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)],
                names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"],
            )

    columns = ", ".join(f"p_{c} double" for c in CATEGORIES)
    return docs.select(F.col("doc_id").cast("long"), empty_text()).mapInArrow(
        run, f"doc_id long, {columns}, toxic boolean"
    )


def accepted(docs: DataFrame, chain: list[Linear], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns as they are."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _chances(batch.column(place), chain)
            yield batch.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
