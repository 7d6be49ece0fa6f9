"""Word-piece counts by a linear longest-match automaton (operator 8).

Greedy longest match takes, from each place, the longest vocabulary entry. The automaton is the vocabulary's trie of
bytes; where a node has no way on for a byte, its failure link leads to the node of what remains after its
leading pieces have been popped, and only the number of those pieces is stored. So a word's count takes
time linear in its length, and no piece is built.

Texts are split by a pattern, and each match is counted separately. Counts of short matches are kept in a bounded table.

Defined results: null and empty texts have no matches and no pieces. A match with a byte that no entry begins with counts
as one unknown piece, as a whole. Rows are independent: repeated rows and ties need no rule. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CACHE_WORDS = 500_000
NONE = -1


class LongestMatch:
    """The automaton. Node 0 is the root."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = {0: False}
        for entry in vocabulary:
            node = 0
            for byte in entry:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                node = child
            ends[node] = bool(entry)
        self.fail = [NONE] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:  # links lead to shallower nodes, so by depth
            for parent in level:
                for byte, node in self.next[parent].items():
                    if ends.get(node):
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    z, count = self.fail[parent], self.popped[parent]
                    while z != NONE and byte not in self.next[z]:
                        z, count = self.fail[z], count + self.popped[z]
                    if z != NONE:
                        self.fail[node], self.popped[node] = self.next[z][byte], count
            level = [node for parent in level for node in self.next[parent].values()]

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces; 1 if a part can't be matched."""
        node, total = 0, 0
        for byte in word:
            while (child := self.next[node].get(byte)) is None:
                if self.fail[node] == NONE:
                    return 1
                total += self.popped[node]
                node = self.fail[node]
            node = child
        while node:
            if self.fail[node] == NONE:
                return 1
            total += self.popped[node]
            node = self.fail[node]
        return total


class TokenCounter:
    def __init__(self, vocabulary: Iterable[bytes], pattern: str):
        self.automaton, self.pattern = LongestMatch(vocabulary), regex.compile(pattern)
        self.cache: dict[str, int] = {}

    def _count(self, word: str) -> int:
        n = self.automaton.count(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self.cache[word] = n
        return n

    def count(self, text: str | None) -> tuple[int, int]:
        """Matches of the pattern, and their pieces."""
        words = self.pattern.findall(text) if text else []
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cached = self.cache.get
        return len(words), sum([n if (n := cached(w)) is not None else self._count(w) for w in words])


_COUNTERS: dict[tuple[int, str], TokenCounter] = {}


def token_counter(spark: SparkSession, vocabulary: Iterable[bytes], pattern: str):
    """A function from a text column to a struct column: n_words, n_tokens. The vocabulary is broadcast; it has a fixed size."""
    shared = spark.sparkContext.broadcast(sorted(vocabulary))
    key = (shared._jbroadcast.id(), pattern)

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def counted(texts: pa.Array) -> pa.Array:
        if key not in _COUNTERS:
            _COUNTERS[key] = TokenCounter(shared.value, pattern)
        pairs = [_COUNTERS[key].count(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["n_words", "n_tokens"])

    def of(text: Column) -> Column:
        return counted(text)

    return of
