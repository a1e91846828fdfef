"""Operator 10: greedy word-piece counts by a linear longest-match automaton.

A trie of the vocabulary's pieces with failure links finds the longest-match-first split of a word in one pass: when a
node has no child for the next byte, the pieces that the greedy split would pop from it are known beforehand, so only
their number is added and the search goes on at the failure link. Pieces are never built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level vocabulary as base64 pieces and ranks. Pieces that begin with a space begin a word, the others go on in one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_WORDS = 300_000


def load(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Two tries in one: node 0 is where a word begins (with a space), node 1 where a piece goes on within it."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        for piece in pieces:
            first = piece[:1] == b" "
            body = piece[1:] if first else piece
            if piece == b" ":  # the space alone: a word may begin with any piece
                ends[0] = True
            if not body or b" " in body:
                continue
            v = 0 if first else 1
            for c in body:
                v = self._down(v, c, ends)
            ends[v] = True
        self._fail(ends)

    def _down(self, v: int, c: int, ends: list[bool]) -> int:
        if c not in self.child[v]:
            self.child[v][c] = len(self.child)
            self.child.append({})
            ends.append(False)
        return self.child[v][c]

    def _fail(self, ends: list[bool]) -> None:
        """Breadth first: the failure link of each node and the number of pieces popped on the way to it; -1 where there is none.

        A node that ends a piece pops it and goes on at node 1. Another pops what its parent pops, then steps down by its
        byte from the parent's link, popping again where that can't step.
        """
        self.link, self.pops = [-1] * len(self.child), [0] * len(self.child)
        if ends[0]:
            self.link[0], self.pops[0] = 1, 1
        queue = deque((c, x, v) for v in (0, 1) for c, x in self.child[v].items())
        while queue:
            c, v, parent = queue.popleft()
            if ends[v]:
                self.link[v], self.pops[v] = 1, 1
            else:
                at, popped = self.link[parent], self.pops[parent]
                while at >= 0 and c not in self.child[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[v], self.pops[v] = self.child[at][c], popped
            queue.extend((d, x, v) for d, x in self.child[v].items())

    def count(self, word: bytes) -> int:
        """The number of pieces of a word; 1 (the unknown piece) if no greedy split covers it."""
        child, link, pops = self.child, self.link, self.pops
        v = n = 0
        for c in word:
            while (x := child[v].get(c)) is None:
                if (w := link[v]) < 0:
                    return 1
                n += pops[v]
                v = w
            v = x
        while v != 1:
            if (w := link[v]) < 0:
                return 1
            n += pops[v]
            v = w
        return n


def _count(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(pieces.value), {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                own = (text or "").split()
                n = 0
                for w in own:
                    k = known.get(w)
                    if k is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        k = known[w] = automaton.count(w.encode("utf-8", "replace"))
                    n += k
                words.append(len(own))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "words", "tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, words, tokens) for every row of docs.

    A text is split at white space; each word is taken with a space before it and split greedily into the longest pieces of
    the vocabulary, of which the space alone may be the first. A word that can't be split is one unknown token. Null and empty texts have no tokens; null ids and repeated rows are counted like others;
    an empty table gives no rows. The vocabulary is read on the driver and sent once to each executor (0.5 MB, fixed).
    """
    told = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(told), "doc_id long, words long, tokens long")
