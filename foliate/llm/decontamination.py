"""Operator 5: benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number n of shingles: partition p holds 2^p <= n < 2^(p+1). An item's sketch is its bottom-k
MinHash, the k least of its shingle hashes, with k = n - ceil(c n) + 1 for containment c: a document that holds c n of the
shingles can't miss all k, so none is lost. A document looks its shingles up in the partitions whose items it is
long enough to contain. Candidates are verified by the exact share of the item's shingles that the document contains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix64, once, slices, words

SHINGLE = 5
#: A document leaks an item if it contains at least this share of the item's shingles.
CONTAINMENT = 0.5
#: Characters of items that one broadcast index holds; a larger benchmark takes several passes over the documents.
INDEX_CHARS = 20_000_000
#: Bits of a hash that choose a place in the first, coarse filter.
COARSE = 22


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word, in order."""
    every = [words(t) for t in texts]
    counts = np.array([len(w) for w in every], dtype=np.int64)
    return np.repeat(np.arange(len(texts)), counts), np.fromiter((x for w in every for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(counts.sum()))


def shingles(doc: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of so many words, in order."""
    n = len(h) - size + 1
    if n < 1:
        return doc[:0], h[:0]
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    whole = doc[:n] == doc[size - 1 :]
    return doc[:n][whole], mix64(total[whole])


class Partition:
    """Items of one shingle length and similar numbers of shingles, by the hashes of their sketches."""

    def __init__(self, items: list[tuple[int, np.ndarray]], containment: float):
        self.least = min(math.ceil(containment * len(own)) for _, own in items)  # shingles that a document needs
        sketches = [own[: len(own) - max(1, math.ceil(containment * len(own))) + 1] for _, own in items]  # sorted: the least ones
        keys, owner = np.concatenate(sketches), np.repeat([i for i, _ in items], [len(s) for s in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]


class Index:
    """Items by shingle length and size partition."""

    def __init__(self, ids: list, texts: list[str], containment: float):
        self.ids, self.containment = ids, containment
        self.own: dict[int, np.ndarray] = {}
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        doc, h = hashed(texts)
        begin = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            w = h[begin[i] : begin[i + 1]]
            if size := min(SHINGLE, len(w)):
                own = np.unique(shingles(np.zeros(len(w), dtype=np.int64), w, size)[1])
                self.own[i] = own
                groups.setdefault((size, len(own).bit_length()), []).append((i, own))
        self.partitions: dict[int, list[Partition]] = {}
        self.coarse: dict[int, np.ndarray] = {}
        for (size, _), items in sorted(groups.items(), key=lambda x: x[0]):
            part = Partition(items, containment)
            self.partitions.setdefault(size, []).append(part)
            self.coarse.setdefault(size, np.zeros(2**COARSE, dtype=bool))[part.keys >> np.uint64(64 - COARSE)] = True

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text number, item number, share contained) of every leak."""
        doc, h = hashed(texts)
        out = []
        for size, parts in self.partitions.items():
            of, s = shingles(doc, h, size)
            maybe = np.flatnonzero(self.coarse[size][s >> np.uint64(64 - COARSE)])
            if not len(maybe):
                continue
            begin = np.searchsorted(of, np.arange(len(texts) + 1))
            length = np.diff(begin)
            pairs: set[tuple[int, int]] = set()
            for p in parts:
                at = maybe[length[of[maybe]] >= p.least]
                a, b = np.searchsorted(p.keys, s[at]), np.searchsorted(p.keys, s[at], side="right")
                for k in np.flatnonzero(b > a):
                    d = int(of[at[k]])
                    pairs.update((d, int(i)) for i in p.owner[a[k] : b[k]])
            last, have = None, s
            for d, i in sorted(pairs):
                if d != last:
                    last, have = d, np.unique(s[begin[d] : begin[d + 1]])
                want = self.own[i]
                at = np.searchsorted(have, want)
                share = float((have[np.minimum(at, len(have) - 1)] == want).mean())
                if share >= self.containment:
                    out.append((d, i, share))
        return out


def _indexes(docs: DataFrame, benchmark: DataFrame, containment: float):
    """Broadcast items that together are all, each of bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    n = -(-chars // INDEX_CHARS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows], containment))


def leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, containment) for every document and item it contains at least that share of.

    Shingles are runs of 5 lower-case words; an item of fewer words is one shingle of its own length. An item or document
    without words matches nothing, null or empty texts among them, nor does an item of null id; a document of null id is
    reported with it. Repeated documents are reported each, repeated items once; several texts of one item_id are items of
    their own. If either table is empty there is no row. Very long texts are read whole. Further columns don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for told in _indexes(docs, benchmark, containment):
        found = rows.mapInArrow(_finder(told), "doc_id long, item_id long, containment double")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, containment double")


def _finder(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once(told, lambda items: Index(*items))
        for whole in batches:
            for batch in slices(whole, 1):
                found = index.find(batch.column(1).to_pylist())
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in found], pa.int64()), pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())], names=["doc_id", "item_id", "containment"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the rows that leak an item, as in leaks(); all columns stay as they are, whatever their names.

    Rows of null or empty texts or null ids stay unless they leak; repeated rows share their fate. An empty benchmark drops nothing.
    """
    for told in _indexes(docs, benchmark, containment):
        docs = docs.mapInArrow(_dropper(told), docs.schema)
    return docs


def _dropper(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = once(told, lambda items: Index(*items))
        for whole in batches:
            for batch in slices(whole, "text"):
                bad = {d for d, _, _ in index.find(batch.column("text").to_pylist())}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_()))

    return run


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_CUT = "unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' ')))"
ORACLE = f"""
with i0 as (select row_number() over () as item, item_id, w, least({SHINGLE}, len(w)) as size from (select distinct item_id, text, {_WORDS} as w from benchmark where item_id is not null and text is not null) where len(w) > 0),
i as (select distinct item, item_id, size, {_CUT} as s from i0),
n as (select item, item_id, count(*) as n from i group by item, item_id),
d0 as (select row_number() over () as k, doc_id, {_WORDS} as w from documents where text is not null),
d as (select distinct k, doc_id, size, {_CUT} as s from d0, (select distinct size from i0))
select doc_id, item_id, count(*) / any_value(n)::double as containment
from d join i using (size, s) join n using (item, item_id)
group by k, doc_id, item, item_id having count(*) / any_value(n)::double >= {CONTAINMENT}
"""
