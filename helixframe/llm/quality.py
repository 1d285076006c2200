"""Quality classifier: supervised subword embeddings.

Every word between ASCII white space gives hashed features: the word itself, its character
n-grams with word boundaries and, of the word pairs, whether it repeats the word before it. A document is the average of its features' learned
vectors, followed by a softmax over two classes. Vectors and output weights are
trained by plain stochastic gradient descent in numpy.

The fit takes at most ``fit_rows`` labelled rows and ``fit_chars`` characters, in expectation, chosen by a hash of
doc_id; the model has ``buckets`` times ``width`` numbers and is broadcast as one score
per bucket, which is what averaging and a linear output come to. Scores use nothing
but the whole text. Null and empty texts get the share of label 1 among the rows
learned from; without any labelled row every score is 0.5. Rows whose label is null
are not learned from; repeated labels of a document are all learned from. Extra
columns are ignored. Very long texts are scored whole, a bounded size of texts at a time; equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def features(words: pa.Array, buckets: int, shortest: int = 3, longest: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of all their n-grams, and which of the words each is of."""
    spelled = common.Spelling(words)
    found = [(spelled.words(), np.arange(len(words))), *(spelled.grams(n) for n in range(shortest, longest + 1))]
    return (np.concatenate([h for h, _ in found]) >> np.uint64(24)).astype(np.int64) % buckets, np.concatenate([of for _, of in found])


def repeat_bucket(buckets: int) -> int:
    """The feature of a word that repeats the one before it."""
    return zlib.crc32(b"\0again") % buckets


def repeats(codes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many words of each text repeat the one before them."""
    again = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][again], minlength=texts)


def counted(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of a text and their shares."""
    words, codes, owner = common.worded(pa.array([text], pa.string()))
    found, of = features(words, buckets)
    times = np.bincount(codes, minlength=len(words))[of]
    ids, at = np.unique(np.append(found, repeat_bucket(buckets)), return_inverse=True)
    n = np.bincount(at, np.append(times, repeats(codes, owner, 1)), len(ids))
    return ids[n > 0], n[n > 0] / max(1.0, n.sum())


class Model:
    """A score for each bucket, the output's bias and the share of label 1."""

    def __init__(self, weights: np.ndarray, bias: float, prior: float) -> None:
        self.weights, self.bias, self.prior = weights, bias, prior

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The distinct words of all texts are looked at once."""
        words, codes, owner = common.worded(texts)
        found, of = features(words, len(self.weights))
        sums = np.bincount(of, self.weights[found], len(words))[codes]
        sizes = np.bincount(of, minlength=len(words))[codes]
        again = repeats(codes, owner, len(texts))
        total = np.bincount(owner, sums, len(texts)) + again * self.weights[repeat_bucket(len(self.weights))]
        many = np.bincount(owner, sizes, len(texts)) + again
        x = np.clip(total / np.maximum(many, 1) + self.bias, -40, 40)
        return np.where(many > 0, 1 / (1 + np.exp(-x)), self.prior)


def fit(labelled: DataFrame, fit_rows: int = 4000, fit_chars: int = 40_000_000, buckets: int = 1 << 17, width: int = 8, epochs: int = 6, rate: float = 2.0, seed: int = 7) -> Model:
    """labelled has doc_id, text, label (0 or 1)."""
    usable = common.plain(labelled, "doc_id", "text", "label").filter("label is not null and text is not null")
    usable = common.thinned(usable, fit_rows, fit_chars)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counted(t, buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "ids": [i.astype("<i4").tobytes() for i, _ in found], "shares": [s.astype("<f4").tobytes() for _, s in found]})

    rows = usable.mapInPandas(extract, "doc_id long, label int, ids binary, shares binary").collect()  # bounded by fit_rows
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["ids"]))
    if not rows:
        return Model(np.zeros(1), 0.0, 0.5)
    data = [(np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["shares"], "<f4"), r["label"]) for r in rows]
    prior = sum(y for *_, y in data) / len(data)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((2, width), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for at in draw.permutation(len(data)):
            ids, shares, y = data[at]
            lr = rate * (1 - done / steps)
            done += 1
            own = vectors[ids]
            mean = shares @ own
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y)] -= 1
            down = out.T @ p
            out -= lr * np.outer(p, mean)
            bias -= np.float32(0.02 * lr) * p
            vectors[ids] = own - lr * shares[:, None] * down * np.float32(len(ids) ** 0.5)
    apart = out[1] - out[0]
    return Model((vectors @ apart).astype(float), float(bias[1] - bias[0]), float(prior))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1, as a further column."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.forget()
        for texts in batches:
            yield pa.array(np.concatenate([np.empty(0), *[held.value.scores(texts.slice(*cut)) for cut in common.cuts(texts)]]))
        common.give_back()

    return docs.withColumn("score", rate(text))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """Whether a row's id falls into the fold that is not learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
