"""Quality rules as a short-circuit cascade (operator 5).

Base counts are taken of every document. Those that pass the base rules go through further rules, each of which sees
only what the earlier ones let pass. The order is found on a sample of the whole table, chosen by a hash of the text: executors measure each
rule's cost (seconds a document, the base counts being there already) and what it rejects; the next rule is always the one with the largest rejection
per cost among the sampled documents that the rules before it let pass. A document is kept if no rule rejects it, so the order changes the time
and never the verdict.

Defined results: null text has no words, as an empty one, and fails the base rules. Lines are split at \\n only, words
are runs of characters other than ASCII white space, and texts are read whole. Rows are independent: repeated
rows and ties need no rule. Extra columns pass through, but for one of the name ``out``, which is replaced.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolens.llm.common import WORD_PATTERN, release

#: Fixed values.
WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SAMPLE_ROWS = 400
WORDS = re.compile(WORD_PATTERN)


def repeated_words(words: list[str], size: int = WINDOW_WORDS) -> int:
    """Words in windows of ``size`` words that occur twice or more in the text, the first occurrence included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(size):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal keys
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.flatnonzero(np.isin(keys, twice)).tolist()
    windows = Counter(tuple(words[i : i + size]) for i in at)  # the words themselves decide
    edges = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if windows[tuple(words[i : i + size])] > 1:
            edges[i] += 1
            edges[i + size] -= 1
    return int((np.cumsum(edges) > 0).sum())


@dataclass
class Page:
    """A text and what rules ask of it, computed when first asked."""

    text: str
    words: list[str] = field(init=False)

    def __post_init__(self):
        self.words = WORDS.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORDS.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def base_failed(self) -> bool:
        return len(self.words) < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * len(self.words)


#: Rules of the cascade: true rejects. Each sees a Page with at least MIN_WORDS words.
RULES: dict[str, Callable[[Page], bool]] = {
    "mean_word_length": lambda p: not 2 <= p.word_chars / len(p.words) <= 15,
    "symbols_to_words": lambda p: 10 * p.n_symbols > len(p.words),
    "duplicate_lines": lambda p: 2 * p.n_dup_lines > len(p.lines),
    "words_without_letters": lambda p: 5 * sum(1 for w in p.words if not (w.isalpha() or any(map(str.isalpha, w)))) > len(p.words),
    "bullet_lines": lambda p: 10 * sum(1 for x in p.lines if WORDS.search(x)[0][0] in "-*•‣") > 9 * len(p.lines),
    "ellipsis_lines": lambda p: 10 * sum(1 for x in p.lines if x.rstrip().endswith(("...", "…"))) > 3 * len(p.lines),
    "stuttered_words": lambda p: 10 * sum(map(str.__eq__, p.words, p.words[1:])) > 3 * len(p.words),
    "one_word": lambda p: 5 * max(Counter(p.words).values()) > 2 * len(p.words),
}


@dataclass(frozen=True)
class Cost:
    rule: str
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def probe(text: str | None, rules: dict[str, Callable[[Page], bool]] = RULES) -> list[tuple[float, bool]] | None:
    """Seconds and verdict of each rule on a text that passes the base rules; null for others."""
    page = Page(text or "")
    if page.base_failed:
        return None
    _ = page.word_chars, page.n_symbols, page.n_dup_lines  # taken of every document, so no rule's cost
    found = []
    for rule in rules.values():
        began = time.perf_counter()
        rejected = rule(page)
        found.append((time.perf_counter() - began, bool(rejected)))
    return found


def cascade(probes: list[list[tuple[float, bool]]], rules: Iterable[str] = RULES) -> list[Cost]:
    """The rules in the order to run, each with its mean cost and the share that it rejects of what is left before it."""
    names, left, order = list(rules), list(probes), []
    at = {name: i for i, name in enumerate(names)}
    seconds = {name: sum(p[at[name]][0] for p in probes) / max(1, len(probes)) for name in names}
    while names:
        costs = [Cost(name, seconds[name], sum(p[at[name]][1] for p in left) / max(1, len(left))) for name in names]
        best = min(costs, key=lambda c: (-c.worth, c.seconds, c.rule))
        order.append(best)
        names.remove(best.rule)
        left = [p for p in left if not p[at[best.rule]][1]]
    return order


def plan(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order to run. The sample serves the order alone; only times and verdicts of it leave executors. Copies of a text are one text of the sample, so a large group of them can't fill it."""
    places = 1 << 32
    share = sample_rows / max(sample_rows, docs.count())

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [p for t in batch.column(0) if (p := probe(t.as_py()))]
            yield pa.record_batch({"seconds": pa.array([[x for x, _ in p] for p in rows], pa.list_(pa.float64())), "rejected": pa.array([[x for _, x in p] for p in rows], pa.list_(pa.bool_()))})

    text = F.col(f"`{text_col}`")
    chosen = docs.select(text.alias("text")).where(F.pmod(F.xxhash64(text), F.lit(places)) < int(places * share)).distinct()
    rows = chosen.mapInArrow(probed, "seconds array<double>, rejected array<boolean>").collect()
    return [c.rule for c in cascade([list(zip(r["seconds"], r["rejected"])) for r in rows])]


SCHEMA = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,kept:boolean,rejected_by:string>"


def judge(text: str | None, order: list[str]) -> tuple:
    p = Page(text or "")
    base = p.base_failed
    by = "base" if base else next((name for name in order if RULES[name](p)), None)
    return len(p.words), p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, base, by is None, by


def apply_rules(docs: DataFrame, order: list[str] | None = None, text_col: str = "text", out: str = "quality") -> DataFrame:
    """docs with a struct column ``out`` (see SCHEMA). rejected_by is the rule met first, so it depends on the order."""
    order = plan(docs, text_col) if order is None else order
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
    names = [x.split(":")[0] for x in SCHEMA[7:-1].split(",")]

    @F.arrow_udf(SCHEMA)
    def judged(texts: pa.Array) -> pa.Array:
        rows = [judge(t.as_py(), order) for t in texts]
        columns = zip(*rows) if rows else [()] * len(kinds)
        release()
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.withColumn(out, judged(F.col(text_col)))
