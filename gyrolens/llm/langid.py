"""Language identification by word-first backoff (operator 4).

A word known from training scores its log frequency in each language. An unseen word falls back to its character
n-grams: the longest length of which any n-gram is known, of 5 down to 1 (word ends are marked), scores the mean log
frequency of those. A text's language has the largest sum over all its words; the score is that language's share of
the posterior by the mean log frequency of a word (equal priors), so it tells near languages from far ones at any length.

Training counts words and n-grams by aggregation over a bounded sample of labelled texts: all of them up to
``max_train_rows``, beyond it those of each language with the smallest hash of id and text, in expectation as many in all, so a group of copies is thinned like the rest.
Languages have equal shares of the sample, a small one all its rows, and each at least one, so every labelled language is learned. All
words and n-grams of the sample are the model, which is broadcast; the number of rows bounds it. Prediction reads nothing but the text, whole.

Defined results: words are runs of letters (Unicode's category L), in lower case. ``und`` with score 0 for null texts, texts without a letter,
and all texts if nothing was learned. Ties go to the language that comes first in code point order. Repeated rows count as
often as they occur. Extra columns are not read by training and pass through prediction, but for one of the name ``out``, which is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 5_000
MAX_N = 5
#: Added to counts, for words and n-grams that a language has not shown.
SMOOTHING = 0.5
CACHE_WORDS = 200_000
#: Letters, and the few numerals (such as ½ and Ⅷ) that are neither letters nor decimal digits.
RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    runs = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and n-grams for each batch: n (0: a word), gram, lang, c."""
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_lang.items():
            for n in range(MAX_N + 1):
                counts = words if n == 0 else defaultdict(int)
                if n:
                    for word, c in words.items():
                        for gram in grams_of(word, n):
                            counts[gram] += c
                size = len(counts)
                yield pa.record_batch({"n": pa.array([n] * size, pa.int32()), "gram": pa.array(counts.keys(), pa.string()), "lang": pa.array([lang] * size, pa.string()), "c": pa.array(counts.values(), pa.int64())})


class Model:
    """Log frequencies by language: row ``tables[n][gram]`` of ``logs``; n = 0 holds words."""

    def __init__(self, counts: pa.Table):
        """counts: n, gram, lang, c, each n, gram and lang once."""
        self.langs = sorted(set(counts["lang"].unique().to_pylist()))
        self.tables: list[dict[str, int]] = []
        parts, start = [np.zeros((1, max(1, len(self.langs))))], 1  # row 0: nothing known
        for n in range(MAX_N + 1):
            part = counts.filter(pc.equal(counts["n"], n))
            grams = part["gram"].combine_chunks().dictionary_encode()
            langs = pc.index_in(part["lang"], pa.array(self.langs, pa.string())).to_numpy()
            if len(grams):
                m = np.full((len(grams.dictionary), len(self.langs)), SMOOTHING)
                m[grams.indices.to_numpy(), langs] += part["c"].to_numpy()
                parts.append(np.log(m / m.sum(axis=0)))
            self.tables.append(dict(zip(grams.dictionary.to_pylist(), range(start, start + len(grams.dictionary)))))
            start += len(grams.dictionary)
        self.logs = np.concatenate(parts)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.vectors = np.zeros((0, self.logs.shape[1]))

    def rows_of(self, word: str) -> list[int]:
        """Rows whose mean is the word's score: the word's own, or those of its longest known n-grams."""
        if (row := self.tables[0].get(word)) is not None:
            return [row]
        for n in range(MAX_N, 0, -1):
            table = self.tables[n]
            if known := [table[g] for g in grams_of(word, n) if g in table]:
                return known
        return [0]

    def learn_words(self, words: set[str]) -> None:
        """Gives new words their ids and vectors."""
        new = [w for w in words if w not in self.ids]
        if not new:
            return
        rows = [self.rows_of(w) for w in new]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = self.logs[np.fromiter(chain.from_iterable(rows), np.int64, sizes.sum())]
        means = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.vectors = np.concatenate([self.vectors, means])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = []
        for first in range(0, len(texts), 256):
            block = [words_of(t) for t in texts[first : first + 256]]
            if len(self.ids) > CACHE_WORDS:
                self._reset()
            self.learn_words(set(chain.from_iterable(block)))
            for words in block:
                if not words or not self.langs:
                    found.append(("und", 0.0))
                    continue
                sums = self.vectors[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(np.argmax(sums))
                found.append((self.langs[best], float(1 / np.exp((sums - sums[best]) / len(words)).sum())))
        return found


def sample_limits(groups: dict[str, tuple[int, int]], max_train_rows: int) -> dict[str, int]:
    """Where each language's sample ends, of places below 2**32, from its number of rows and its first place. Equal shares; what small languages leave goes to the others."""
    left, limits = max_train_rows, {}
    for i, (lang, (n, first)) in enumerate(sorted(groups.items(), key=lambda g: (g[1][0], g[0]))):
        share = min(n, left / (len(groups) - i))
        left -= share
        limits[lang] = max(int((1 << 32) * share / n), first + 1)  # one row at least
    return limits


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    n = labelled.count()
    if n > max_train_rows:
        place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32))
        groups = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).collect()
        limits = sample_limits({r["lang"]: (r["n"], r["first"]) for r in groups}, max_train_rows)
        labelled = labelled.where(place < F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang")))
    counts = labelled.select("text", "lang").mapInArrow(_partial_counts, "n int, gram string, lang string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    return Model(counts.toArrow())


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "prediction") -> DataFrame:
    """docs with a struct column ``out``: lang, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        pairs = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], ["lang", "score"])

    return docs.withColumn(out, predicted(F.col(text_col)))
