"""Language identification with a byte convolutional network.

Filters of several widths run over byte embeddings of a fixed-length window; the maximum of each filter
over the window feeds a softmax. The network is trained in numpy on a bounded sample of labelled texts
(``TRAIN_ROWS``). A text of any length is cut into windows that cover all of it; these go through the
network in batches, and a text's languages are weighed by the mean log-probability of its windows, each by
the bytes that it holds.

Defined cases: a null text, and one without a letter, is ``und`` with score 0. Repeated rows get equal
results, as a result depends on the text alone. Columns other than the text are never read; those named
like a result are replaced. Without any
labelled text everything is ``und``. Of equally likely languages the first in the alphabet wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_table, fold, sample_rows, table

#: Labelled rows that a network is trained on, at most.
TRAIN_ROWS = 3000
#: Windows taken of each training text, at most, spread over its whole length.
TRAIN_WINDOWS = 4
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
EPOCHS = 6
UNKNOWN = "und"
#: Word characters but for ASCII digits and the underscore: letters, and numerals such as superscripts.
LETTER = re.compile(r"[^\W0-9_]")
#: Windows that run through the network at once, so that the activations stay in cache.
AT_ONCE = 64


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; numerals such as a half or a Roman eight are none."""
    return any(found[0].isalpha() for found in LETTER.finditer(text))


def windows_of(data: bytes, length: int = WINDOW) -> np.ndarray:
    """The whole text as rows of ``length`` bytes; the last is filled up with zeros."""
    rows = max(1, -(-len(data) // length))
    out = np.zeros(rows * length, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, length)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # for each width: width x EMBEDDING x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    lookups: tuple | None = None

    def tables(self) -> list[np.ndarray]:
        """What each byte adds at each place of each filter: the convolution becomes a sum of lookups."""
        return [np.einsum("be,wef->wbf", self.embedding, f).astype(np.float32) for f in self.filters]

    def pooled(self, rows: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maximum of each filter over each row, and where it is."""
        best, where = [], []
        for places, bias in zip(tables, self.bias):
            width, span = len(places), rows.shape[1] - len(places) + 1
            sums = places[0][rows[:, :span]]
            for k in range(1, width):
                sums += places[k][rows[:, k : k + span]]
            best.append(sums.max(axis=1) + bias)
            where.append(sums)
        return np.maximum(np.concatenate(best, axis=1), 0), where

    def pair_table(self) -> np.ndarray:
        """What each pair of neighbouring bytes adds at the even places of each width: one row for a filter."""
        first, second = np.arange(65536) >> 8, np.arange(65536) & 255
        pairs = [t[k][first] + t[k + 1][second] for t in self.tables() for k in range(0, len(t) - 1, 2)]
        return np.ascontiguousarray(np.concatenate(pairs, axis=1).T)

    def log_probabilities(self, rows: np.ndarray, pairs: np.ndarray, lasts: list[np.ndarray]) -> np.ndarray:
        """One row of log-probabilities for each window. Pairs of bytes halve the number of lookups."""
        out = np.empty((len(rows), len(self.languages)))
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE].astype(np.intp)
            looked = np.take(pairs, some[:, :-1] * 256 + some[:, 1:], axis=1)  # filters x windows x places
            best, block = [], 0
            for width, last, bias in zip(WIDTHS, lasts, self.bias):
                span = some.shape[1] - width + 1
                sums = looked[block : block + FILTERS, :, :span]
                block += FILTERS
                for k in range(2, width - 1, 2):
                    sums = sums + looked[block : block + FILTERS, :, k : k + span]
                    block += FILTERS
                if width % 2:
                    sums = sums + np.take(last, some[:, width - 1 :], axis=1)
                best.append(sums.max(axis=2).T + bias)
            hidden = np.maximum(np.concatenate(best, axis=1), 0).astype(float)
            logits = hidden @ self.dense + self.dense_bias
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + AT_ONCE] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if self.lookups is None:
            self.lookups = self.pair_table(), [np.ascontiguousarray(t[-1].T) for t in self.tables()]
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        for i in known:
            data = texts[i].encode("utf-8", "replace")
            rows = windows_of(data)
            weight = np.full(len(rows), float(WINDOW))
            weight[-1] = len(data) - WINDOW * (len(rows) - 1)
            mean = np.round(weight @ self.log_probabilities(rows, *self.lookups) / weight.sum(), 6)
            p = np.exp(mean - mean.max())
            p /= p.sum()
            best = int(p.argmax())
            out[i] = (self.languages[best], round(float(p[best]), 4))
        return out


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit a network by Adam on the windows of labelled texts."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    network = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))),
        np.zeros(max(1, len(languages))),
    )
    rows, labels = [], []
    for text, lang in zip(texts, langs):
        if not has_letter(text):
            continue
        found = windows_of(text.encode("utf-8", "replace"))
        take = np.unique(np.linspace(0, len(found) - 1, TRAIN_WINDOWS).astype(int))
        rows.append(found[take])
        labels += [languages.index(lang)] * len(take)
    if not rows or len(languages) < 2:
        return network if languages else replace(network, languages=[])
    x, y = np.concatenate(rows), np.array(labels)
    network.embedding[0] = 0
    weights = [network.embedding, *network.filters, *network.bias, network.dense, network.dense_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            batch = order[at : at + 64]
            step += 1
            for w, g, m, v in zip(weights, _gradients(network, x[batch], y[batch]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            network.embedding[0] = 0
    return network


def _gradients(network: Network, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Of the cross-entropy, by every weight; through the pooling only the winning places learn."""
    hidden, sums = network.pooled(rows, network.tables())
    logits = hidden @ network.dense + network.dense_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(rows)), labels] -= 1
    p /= len(rows)
    back = (p @ network.dense.T) * (hidden > 0)
    embedding = np.zeros_like(network.embedding)
    filters, bias = [], []
    n = np.arange(len(rows))[:, None]
    for i, (f, s) in enumerate(zip(network.filters, sums)):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        at = s.argmax(axis=1)  # rows x FILTERS
        grad = np.zeros_like(f)
        for k in range(len(f)):
            taken = rows[n, at + k]  # the bytes under the winning places
            grad[k] = np.einsum("nfe,nf->ef", network.embedding[taken], g)
            np.add.at(embedding, taken, g[:, :, None] * f[k].T[None])
        filters.append(grad)
        bias.append(g.sum(axis=0))
    return [embedding, *filters, *bias, hidden.T @ p, p.sum(axis=0)]


def fit(docs: DataFrame, folds: int | None = 3, held_out: int = 1, rows: int = TRAIN_ROWS) -> Network:
    """Train on at most ``rows`` labelled documents outside the held-out fold, in a fixed pseudo-random order."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if folds:
        known = known.filter(fold("doc_id", folds) != held_out)
    chosen = cut(sample_rows(known.select("doc_id").dropDuplicates(), "doc_id", rows), "lang-sample")
    # at most ``rows`` narrow rows are broadcast, and as many windows as the parameters say reach the driver
    picked = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for text in batch.text:
                found = windows_of(text.encode("utf-8", "replace"))
                take = np.unique(np.linspace(0, len(found) - 1, TRAIN_WINDOWS).astype(int))
                kept.append(found[take].tobytes().rstrip(b"\0").decode("utf-8", "ignore"))
            yield pd.DataFrame({"doc_id": batch.doc_id, "lang": batch.lang, "text": kept})

    sample = picked.mapInPandas(ends, "doc_id long, lang string, text string").toPandas()
    drop_table(chosen)
    sample = sample.sort_values(["doc_id", "lang", "text"]).head(rows)
    return train(sample.text.tolist(), sample.lang.tolist())


def predict(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. One pass over the whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.pandas_udf("lang_pred string, score double")
    def predictor(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(shared.value.predict(batch.tolist()), columns=["lang_pred", "score"])

    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(F.struct(*docs.columns).alias("_row"), predictor(F.col(text)).alias("_found"))
    return found.select(*own, "_found.lang_pred", "_found.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = fit(docs)
    return predict(docs.select("doc_id", "text"), network).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )
