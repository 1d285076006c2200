"""Best-fit packing: documents into training sequences of a fixed length.

Vector best-fit decreasing over three resources of a sequence: tokens, document
count and attention cost (the sum of squared lengths). A piece goes to the open
sequence whose weighted residual norm after placing is smallest and where it fits
under every constraint.

Pieces of one length are interchangeable, so the plan is made over the histogram
of lengths (at most ``capacity`` counters) with sequences in equal state kept as
intervals: its size depends on the capacity only, never on the corpus. Spark ranks
the pieces within a length (in salted groups of about ``group`` rows, so that a hot length has no
task of its own at any size) and looks each rank up in the plan.

Nulls and empty texts are documents of no token but the end id. Tables without
rows give no rows. Repeated rows are packed as often as they occur; which of them goes where is
no matter, as they are equal. Very long texts are cut into pieces whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class FastIds:
    """Token ids of texts, equal to ``Tokenizer.encode``, for many texts at once.

    The tokenizer drops white space and splits into letters, single digits and runs of
    signs before it merges. Here the splitting is done on the bytes of all texts, and each distinct
    part is merged once, by a byte-pair encoder built from the same merges, in which a zero byte
    stands for the end of a word. Texts beyond Latin-1, with special tokens or with
    separators that only some libraries call white space take the tokenizer itself, as
    do all texts when the file is of another kind.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ODD = ("<|", "\0", "\x1c", "\x1d", "\x1e", "\x1f")
    SPACE, LETTER, DIGIT, SIGN = range(4)

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.merger = None
        splits = [x.get("pattern", {}).get("Regex") for x in (held["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if held["model"]["type"] == "BPE" and held["model"].get("end_of_word_suffix") == "</w>" and splits[:1] == [self.PATTERN]:
            self.build(held["model"]["vocab"], held["model"]["merges"])

    @functools.cached_property
    def tokenizer(self):
        """The library's own, for texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def build(self, vocab: dict[str, int], merges: list) -> None:
        import tiktoken

        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = dict(zip([*kept, *sorted(set(range(256)) - set(kept))], [*map(chr, kept), *map(chr, range(256, 512))], strict=False))
        byte = {c: b for b, c in letters.items()}

        def raw(token: str) -> bytes:
            return bytes([byte[c] for c in token.removesuffix("</w>")]) + b"\0" * token.endswith("</w>")

        # single bytes first, then those that end a word, then the merges in their order
        order = [letters[b] for b in range(256)] + [letters[b] + "</w>" for b in range(256)]
        order += ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ranks: dict[bytes, int] = {}
        numbers: list[int] = []
        for token in order:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(numbers)
                numbers.append(vocab[token])
        self.numbers = np.array(numbers, "<u4")
        self.last = np.array([t.endswith(b"\0") and len(t) > 1 for t in ranks], bool)
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        kinds = {"L": self.LETTER, "N": self.DIGIT}
        self.kind = np.array([self.SPACE if chr(b).isspace() else kinds.get(unicodedata.category(chr(b))[0], self.SIGN) for b in range(256)], np.uint8)

    def plain(self, text: str) -> bytes | None:
        """The text in lower case and one byte a letter, if that says all."""
        if self.merger is None or any(x in text for x in self.ODD):
            return None
        try:
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def starts(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the parts begin: a change of kind, each digit, and what follows an ending such as 's."""
        begins = np.empty(len(data), bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == self.DIGIT
        begins &= kind != self.SPACE
        quotes = np.flatnonzero((data == ord("'")) & begins)
        quotes = quotes[quotes + 3 < len(data)]
        one, two = data[quotes + 1], data[quotes + 2]
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for own, n in ((quotes[short], 2), (quotes[long], 3)):
            begins[own + 1] = False
            begins[own + n] |= kind[own + n] == self.LETTER
        return np.flatnonzero(begins)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit."""
        plain = [self.plain(t) for t in texts]
        raw = [p or b"" for p in plain]
        data = np.frombuffer(b"\n".join(raw) + b"\n\n\n\n", np.uint8)
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
        if not any(raw):
            return [self.whole(t) for t in texts]
        kind = self.kind[data]
        starts = self.starts(data, kind)
        kept = kind != self.SPACE
        offsets = np.empty(len(starts) + 1, np.int32)
        before = np.cumsum(kept, dtype=np.int32)
        offsets[:-1], offsets[-1] = before[starts] - 1, before[-1]
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]).dictionary_encode()
        ids, first, many = self.merged(parts.dictionary)
        codes = parts.indices.to_numpy()
        count = many[codes]
        upto = np.concatenate([[0], np.cumsum(count)])
        out = ids[np.arange(upto[-1]) + np.repeat(first[codes] - upto[:-1], count)]
        at = upto[np.searchsorted(starts, bounds)].tolist()
        return [self.whole(texts[k]) if p is None else out[at[k] : at[k + 1]] for k, p in enumerate(plain)]

    def merged(self, parts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, where each begins, and how many it has."""
        if not len(parts):
            return np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), b"\0 ")[0].as_py() + b"\0"
        own = self.merger.encode_to_numpy(joined.decode("latin-1"), disallowed_special=())
        ends = np.flatnonzero(self.last[own]) + 1
        first = np.concatenate([[0], ends[:-1]])
        return self.numbers[own], first, ends - first

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0].tobytes()


_encoders: dict[str, FastIds] = {}
common.CACHES["packing"] = _encoders.clear


def encoder(path: str) -> FastIds:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = FastIds(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece; documents over the capacity are cut, others stay whole."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in common.portions(batches, 1, 2 << 20):
            out: list[tuple[int, int, int, int, int]] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(texts), strict=True):
                n = len(ids) + 1
                for k, s in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - s)
                    crc = zlib.crc32(ids[s : s + length])
                    out.append((doc_id, k, s, length, zlib.crc32(end, crc) if s + length == n else crc))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.plain(docs, "doc_id", "text").mapInArrow(common.trimmed(work, own="packing"), PIECES)


def plan(counts: dict[int, int], capacity: int, most_docs: int, most_cost: int, weights: tuple[float, float, float]) -> dict[str, np.ndarray]:
    """Vector best-fit decreasing over the counts of each length.

    A run places the pieces ranked ``rank`` and on within their length, ``each`` to
    a sequence, into consecutive sequences from ``first`` on at token ``base``.
    """
    full = (capacity, most_docs, most_cost)
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def norm(state: tuple[int, int, int]) -> float:
        return sum(w * (r / f) ** 2 for w, r, f in zip(weights, state, full, strict=True))

    def after(state: tuple[int, int, int], n: int, length: int) -> tuple[int, int, int]:
        return state[0] - n * length, state[1] - n, state[2] - n * length * length

    def fits(state: tuple[int, int, int], length: int) -> int:
        return min(state[0] // length, state[1], state[2] // (length * length))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if fits(full, length) < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence under these constraints")
        fresh: list[tuple[tuple[int, int, int], list[int]]] = []
        usable = sorted((norm(after(s, 1, length)), s) for s in states if s[0] >= length and fits(s, length))
        for state in [s for _, s in usable] + [full]:
            if not left:
                break
            n = fits(state, length)
            if state == full:
                spans = states.pop(full, []) + [[opened, -(-left // n)]]
                opened += spans[-1][1]
            else:
                spans = states.pop(state)
            while spans and left:
                first, size = spans.pop()
                take = min(size, left // n)
                if take:
                    runs.append((length, rank, first, n, capacity - state[0]))
                    fresh.append((after(state, n, length), [first, take]))
                    left, rank = left - take * n, rank + take * n
                if take < size and left:  # fewer than n are left, all for one sequence
                    runs.append((length, rank, first + take, left, capacity - state[0]))
                    fresh.append((after(state, left, length), [first + take, 1]))
                    rank, left, take = rank + left, 0, take + 1
                if take < size:
                    spans.append([first + take, size - take])
            if spans:
                states.setdefault(state, []).extend(spans)
        for state, span in fresh:
            states.setdefault(state, []).append(span)
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    order = np.lexsort((cols[1], cols[0]))
    return dict(zip(("length", "rank", "first", "each", "base"), cols[:, order], strict=True))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    most_docs: int | None = None,
    most_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3),
    end_id: int = 0,
    group: int = 20_000,
) -> DataFrame:
    """Pieces with the sequence they go to and their place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. most_docs
    and most_cost default to what a sequence of single tokens or of one piece takes,
    where they exclude nothing.
    """
    spark = docs.sparkSession
    most_docs = capacity if most_docs is None else most_docs
    most_cost = capacity * capacity if most_cost is None else most_cost
    cut = common.materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    totals = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # bounded by capacity
        totals[length] = n
    salts = 16 + totals // group  # a hot length is ranked in several tasks, whatever its size
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(salts.tolist()), F.col("length").cast("int") + 1)).cast("int"))
    first = np.cumsum(salts) - salts
    tally = np.zeros(salts.sum(), np.int64)  # a number for each group of rows and each length
    for length, salt, n in cut.groupBy("length", "salt").count().toLocalIterator():
        tally[first[length] + salt] = n
    made = plan({int(x): int(totals[x]) for x in np.flatnonzero(totals)}, capacity, most_docs, most_cost, weights)
    before = np.cumsum(tally) - tally
    held = spark.sparkContext.broadcast((before - before[np.repeat(first, salts)], first, made))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, nth: pd.Series) -> pd.DataFrame:
        before, first, p = held.value
        n = length.to_numpy(np.int64)
        rank = before[first[n] + salt.to_numpy()] + nth.to_numpy(np.int64) - 1
        at = np.searchsorted((p["length"] << 44) + p["rank"], (n << 44) + rank, "right") - 1
        within = rank - p["rank"][at]
        return pd.DataFrame({"sequence_id": p["first"][at] + within // p["each"][at], "offset": p["base"][at] + within % p["each"][at] * n})

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    placed = cut.withColumn("at", place("length", "salt", nth))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
