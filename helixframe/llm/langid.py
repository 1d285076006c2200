"""Language identification: known words first, character n-grams for the rest.

A known word scores its smoothed log frequency in each language. An unseen word is
scored by its longest character n-grams that were seen (with word boundaries),
falling back to shorter ones. Scores of all words of the whole text are summed; the
posterior over the languages gives the prediction and its score.

The model is fitted on at most ``fit_rows`` labelled rows and ``fit_chars`` characters, in
expectation, chosen by a hash of doc_id (all of them where there are fewer). It keeps every word, n-gram and
language of these rows, as sorted 64-bit hashes beside a table of log frequencies, and is broadcast, so its size is
bounded by these two parameters. Spark counts; predictions use nothing but the text.

Texts that are null or hold no letter are ``und`` with score 0, as is every text when no labelled
row has a word. Ties go to the language first in alphabetical order. Repeated rows are
predicted alike. Very long texts are read whole, a bounded size of texts at a time. Other columns of the input
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
LONGEST = 5
_words = re.compile(r"[^\W\d_]+").findall
_letters = bytes(b if chr(b).isalpha() else 32 for b in range(256))


def letters(text: str | None) -> str:
    """The words of a text in lower case between spaces."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_letters).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join([w for w in _words(low) if any(map(str.isalpha, w))])


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return common.worded(pa.array([letters(t) for t in texts.to_pylist()], pa.string()))


class Model:
    """For words (size 0) and n-grams: sorted hashes and, beside each, log probabilities by language."""

    def __init__(self, langs: list[str], codes: list[np.ndarray], tables: list[np.ndarray]) -> None:
        self.langs, self.codes, self.tables = langs, codes, tables
        self.floor = min((t.min() for t in tables if t.size), default=0.0)

    def known(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their rows."""
        own = self.codes[size]
        if not len(own):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return own[at] == hashes, at

    def rows(self, words: pa.Array) -> np.ndarray:
        """Log probabilities of words: their own, or the mean of their longest known n-grams."""
        spelled = common.Spelling(words)
        out = np.full((len(words), len(self.langs)), self.floor)
        hit, at = self.known(0, spelled.words())
        out[hit] = self.tables[0][at[hit]]
        rest = ~hit
        for size in range(LONGEST, 0, -1):
            hashes, of = spelled.grams(size, rest)
            hit, at = self.known(size, hashes)
            at, of = at[hit], of[hit]
            many = np.bincount(of, minlength=len(words))
            done = many > 0
            for k in range(len(self.langs)):
                out[done, k] = np.bincount(of, self.tables[size][at, k], len(words))[done] / many[done]
            rest &= ~done
        return out

    def predicted(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words, codes, owner = worded(texts)
        none = np.bincount(owner, minlength=len(texts)) == 0
        if not self.langs or not len(codes):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = self.rows(words)
        total = np.stack([np.bincount(owner, rows[:, k][codes], len(texts)) for k in range(len(self.langs))], axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        return [UNKNOWN if n else self.langs[b] for n, b in zip(none, best, strict=True)], np.where(none, 0.0, score)

    def predict(self, text: str | None) -> tuple[str, float]:
        names, scores = self.predicted(pa.array([text], pa.string()))
        return names[0], float(scores[0])


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs in each language, of lang and text."""
    for batch in common.portions(batches, 1):
        words, codes, owner = worded(batch.column(1))
        langs = batch.column(0).dictionary_encode()
        pairs, n = np.unique(codes.astype(np.int64) * len(langs.dictionary) + langs.indices.to_numpy()[owner], return_counts=True)
        word, lang = np.divmod(pairs, len(langs.dictionary))
        yield pa.RecordBatch.from_arrays([words.take(pa.array(word)).cast(pa.string()), langs.dictionary.take(pa.array(lang)).cast(pa.string()), pa.array(n)], ["word", "lang", "n"])


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of counted words the hashes of words (size 0, by occurrence) and of their n-grams (by word)."""
    for batch in common.portions(batches, 0):
        langs = batch.column(1).dictionary_encode()
        of_word, k = langs.indices.to_numpy(), len(langs.dictionary)
        spelled = common.Spelling(batch.column(0))
        for size in range(LONGEST + 1):
            hashes, of = (spelled.words(), np.arange(batch.num_rows)) if size == 0 else spelled.grams(size)
            n = batch.column(2).to_numpy() if size == 0 else np.ones(len(of), np.int64)
            codes, at = np.unique(hashes, return_inverse=True)
            pairs, back = np.unique(at.astype(np.int64) * k + of_word[of], return_inverse=True)
            sums = np.bincount(back, n, len(pairs)).astype(np.int64)
            code, lang = np.divmod(pairs, k)
            yield pa.RecordBatch.from_arrays([pa.array(codes[code].view(np.int64)), pa.array(np.full(len(code), size, np.int32)), langs.dictionary.take(pa.array(lang)).cast(pa.string()), pa.array(sums)], ["code", "size", "lang", "n"])


def fit(docs: DataFrame, labelled: Column, fit_rows: int = 40_000, fit_chars: int = 200_000_000) -> Model:
    """docs has doc_id, text, lang; labelled says which rows may be learned from."""
    usable = common.plain(docs, "doc_id", "text", "lang").filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = common.thinned(usable, fit_rows, fit_chars).select("lang", "text")
    words = usable.mapInArrow(common.trimmed(tally), "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(common.trimmed(spread), "code long, size int, lang string, n long").groupBy("code", "size", "lang").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # bounded by fit_rows and fit_chars
    names = found.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    lang = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    code, size, n = (found.column(c).to_numpy() for c in ("code", "size", "n"))
    all_codes, tables = [], []
    for k in range(LONGEST + 1):
        of = np.flatnonzero(size == k)
        codes, at = np.unique(code[of].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(codes), len(langs)), np.float32)
        counts[at, lang[of]] = n[of]
        all_codes.append(codes)
        tables.append(np.log((counts + np.float32(0.5)) / (counts.sum(axis=0) + np.float32(0.5) * len(codes))))
    del found, names, lang, code, size, n
    common.give_back()
    return Model(langs, all_codes, tables)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score as further columns, in place of any of these names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common.forget()
        model = held.value
        for series in batches:
            texts = pa.array(series, pa.string(), from_pandas=True)
            parts = [model.predicted(texts.slice(*cut)) for cut in common.cuts(texts)]
            yield pd.DataFrame({"lang_pred": [x for names, _ in parts for x in names], "score": np.concatenate([np.empty(0), *[s for _, s in parts]])})
        common.give_back()

    docs = docs.drop("lang_pred", "score", "_found")
    return docs.withColumn("_found", predict(text)).select(*docs.columns, "_found.lang_pred", "_found.score")
