"""Operator 8: SimHash near-duplicates by a hierarchical index in Gray order.

Distinct fingerprints are put in tables, each keyed by some of their bits; in a table those of one key are sorted by Gray rank, and
a tree over them factors the bit patterns that its nodes share. Key bits follow the number of fingerprints, so that keys stay
small groups, and tables the key bits, so that at every size a pair at the very radius is missed with probability MISS only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut, merge, mix64, slices, unused, words

BITS = 256
#: Two fingerprints of at most this many differing bits are near-duplicates (a cosine of 0.92 of the word sets).
MAX_DISTANCE = 32
FAN = 8
#: The probability that a pair of exactly MAX_DISTANCE differing bits meets in no table; it falls steeply below.
MISS = 1e-3
#: Fingerprints of a key that there are on average, as a power of two; rows of whole keys that are searched at once.
CROWD, CHUNK = 5, 200_000
_LANES = np.array([int.from_bytes(bytes((b >> j) & 1 for j in range(8)), "little") for b in range(256)], dtype=np.uint64)


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each document as four uint64; hashes: 64-bit hashes of its distinct words, one document after the other.

    Bit j is set if more than half of the words have it set. Bits are counted eight at a time in the bytes of a uint64,
    at most 255 words at once.
    """
    out = np.zeros((len(counts), BITS), dtype=np.int64)
    per = -(-counts // 255)
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(counts) - counts, per) + 255 * nth
    step = 256  # sub-segments a round, to bound memory
    for k in range(0, len(start), step):
        s = start[k : k + step]
        end = start[k + step] if k + step < len(start) else len(hashes)
        h = hashes[s[0] : end]
        four = np.stack([h, *(mix64(h ^ np.uint64(0xA5A5A5A5 * i)) for i in (1, 2, 3))], axis=1)
        lanes = np.add.reduceat(_LANES[four.view(np.uint8).reshape(len(h), 32)], s - s[0], axis=0)
        np.add.at(out, doc[k : k + step], lanes.view(np.uint8).reshape(len(s), BITS))
    return np.packbits(2 * out > counts[:, None], axis=1, bitorder="little").view(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            ids, found, counts, text_hash = [], [], [], []
            for i, text, same in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("text_hash").to_pylist()):
                own = set(words(text))
                if i is None or not own:
                    continue
                ids.append(i)
                counts.append(len(own))
                found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                text_hash.append(same)
            if ids:
                f = fingerprints(np.concatenate(found), np.array(counts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text_hash, pa.int64()), *(pa.array(f[:, k]) for k in range(4))], names=["doc_id", "text_hash", "f0", "f1", "f2", "f3"])


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(_sign, "doc_id long, text_hash long, f0 long, f1 long, f2 long, f3 long")


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in Gray order, as words of falling weight: the number whose Gray code it is."""
    out, odd = np.empty_like(f), np.zeros(len(f), dtype=np.uint64)
    for k in range(f.shape[1]):
        x = f[:, k].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        out[:, k] = x ^ (np.uint64(0) - odd)
        odd = out[:, k] & np.uint64(1)
    return out


def link(f: np.ndarray, key: np.ndarray, node: np.ndarray, most: int, parent: np.ndarray) -> None:
    """Join rows of one key whose fingerprints differ in at most `most` bits: merges their nodes in parent.

    Rows are put in Gray order within their key. A tree of fan-out FAN stands over each key's rows; an inner node holds
    the pattern its members share (a mask and the values under it). Pairs of nodes descend from common parents with the
    differences found so far, adding at each level those in bits that only the children share; a pair beyond `most` is
    pruned with all below it. So is a pair of nodes whose members all are in one component already: it can't
    change the components.
    """
    order = np.lexsort((*gray_rank(f).T[::-1], key))
    f, key, node = f[order], key[order], node[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    keep = np.repeat(size > 1, size)
    f, key, node = f[keep], key[keep], node[keep]
    if not len(f):
        return
    group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    value, mask = [f], [np.full_like(f, 2**64 - 1)]
    begin, leaf = [], [np.arange(len(f))]  # of each level's nodes: its first child, its first leaf
    while True:
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
        head = np.flatnonzero(place % FAN == 0)
        if len(head) == len(group):
            break
        v, m = value[-1], mask[-1]
        width = np.diff(np.r_[head, len(group)])
        up = np.repeat(np.arange(len(head)), width)
        base = v[head]
        shared = np.bitwise_and.reduceat(m & ~(v ^ base[up]), head, axis=0)
        value.append(base & shared)
        mask.append(shared)
        begin.append(np.r_[head, len(group)])
        leaf.append(leaf[-1][head])
        group = group[head]

    def alike(level: int) -> np.ndarray:
        """The component of all of a node's leaves, or -1 - node."""
        own = parent[node]
        low, high = np.minimum.reduceat(own, leaf[level]), np.maximum.reduceat(own, leaf[level])
        return np.where(low == high, low, -1 - np.arange(len(low)))

    def descend(level: int, a: np.ndarray, b: np.ndarray, known: np.ndarray | None, so_far: np.ndarray) -> None:
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            same = alike(level)
            go = same[x] != same[y]
            x, y, d = x[go], y[go], so_far[k : k + 65536][go]
            both = mask[level][x] & mask[level][y]
            new = both if known is None else both & ~known[k : k + 65536][go]
            d = d + np.bitwise_count((value[level][x] ^ value[level][y]) & new).sum(axis=1, dtype=np.int64)
            near = d <= most
            x, y, d, both = x[near], y[near], d[near], both[near]
            if not len(x):
                continue
            if level == 0:
                merge(parent, node[x], node[y])
                continue
            c = begin[level - 1]
            nx, ny = c[x + 1] - c[x], c[y + 1] - c[y]
            pair = np.repeat(np.arange(len(x)), nx * ny)
            j = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
            descend(level - 1, c[x][pair] + j // ny[pair], c[y][pair] + j % ny[pair], both[pair], d[pair])

    for level in range(len(begin)):  # pairs of the children of one node, from the leaves up
        c = begin[level]
        width = np.diff(c)
        for i in range(FAN):
            for j in range(i + 1, FAN):
                a = c[:-1][width > j] + i
                descend(level, a, a + (j - i), None, np.zeros(len(a), dtype=np.int64))


def tables(n: int, most: int) -> np.ndarray:
    """The bits that key each table, a row a table, for n fingerprints and radius most.

    Keys have so many bits that 2^CROWD fingerprints share one on average; a pair of most differing bits agrees in all of them
    with probability p, so that log MISS / log(1 - p) tables of independent bits lose it with probability MISS.
    """
    width = min(max(4, (max(n, 1) - 1).bit_length() - CROWD), BITS - most)
    p = math.exp(math.lgamma(BITS - most + 1) - math.lgamma(BITS - most - width + 1) + math.lgamma(BITS - width + 1) - math.lgamma(BITS + 1))
    many = math.ceil(math.log(MISS) / math.log1p(-p)) if p < 1 else 1
    draw = np.random.default_rng(8)
    return np.stack([np.sort(draw.permutation(BITS)[:width]) for _ in range(many)])


def _keyed(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                f = np.stack([batch.column(f"f{k}").to_numpy() for k in range(4)], axis=1)
                on = np.unpackbits(f.view(np.uint8), axis=1, bitorder="little")
                for t in range(0, len(bits), 64):  # a fingerprint's rows side by side, which compresses them
                    some = bits[t : t + 64]
                    key = on[:, some].astype(np.int64) @ weight + (np.arange(t, t + len(some), dtype=np.int64) << np.int64(bits.shape[1]))
                    again = np.repeat(np.arange(len(f)), len(some))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("rep").take(pa.array(again)), *(pa.array(f[again, j]) for j in range(4))], names=["key", "rep", "f0", "f1", "f2", "f3"])

    return run


def _search(most: int):
    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        ids, node = np.unique(t.column("rep").to_numpy(), return_inverse=True)
        f = np.stack([t.column(f"f{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
        parent = np.arange(len(ids))
        link(f, t.column("key").to_numpy(), node, most, parent)
        moved = np.flatnonzero(parent != np.arange(len(ids)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[parent[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:  # in order of the keys; the last key of a chunk waits for the rest of its rows
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK:
                key = b.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                if last or len(held) > 1 and held[-2].column("key")[-1].as_py() != key[0]:
                    yield from found([*held[:-1], b.slice(0, last)])
                    held, rows = [b.slice(last)], b.num_rows - last
        if rows:
            yield from found(held)

    return run


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(signatures, (node, root) of the fingerprints that have neighbours); a node is the least doc_id of a fingerprint.

    Each distinct fingerprint is a query in every table. No group, neighbour list or candidate list is capped. A task holds the
    fingerprints of one key, or CHUNK of several keys.
    """
    sig = cut(signatures(docs), "simhash")
    fs = ["f0", "f1", "f2", "f3"]
    unique = cut(sig.groupBy(*fs).agg(F.min("doc_id").alias("rep")), "fingerprints")
    keyed = unique.mapInArrow(_keyed(tables(unique.count(), max_distance)), "key long, rep long, f0 long, f1 long, f2 long, f3 long").repartition("key").sortWithinPartitions("key")
    return sig, components(keyed.mapInArrow(_search(max_distance), "a long, b long"))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id) for every document that has a near or exact copy; group_id is the least doc_id of its group.

    Groups are the connected components of pairs within max_distance bits. A row of null doc_id or without any word has no
    fingerprint and is in no group. Rows that repeat a doc_id are members of their group once for each. Very long texts are
    signed whole. Tables without rows give no rows; further columns don't matter, whatever their names.
    """
    sig, root = groups(docs, max_distance)
    fs = ["f0", "f1", "f2", "f3"]
    unique = sig.groupBy(*fs).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    found = unique.join(root, "node", "left").where("n > 1 or root is not null").select(*fs, F.coalesce("root", "node").alias("group_id"))
    return sig.join(found, fs).select("doc_id", "group_id")


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs without all but one document of each group: the one of the least doc_id.

    Of rows that repeat that doc_id the text of least hash stays, and of rows that repeat both the one of the least hash over
    all columns (but maps). Null ids and texts without words stay. All columns stay as they are, whatever their names; an
    empty table stays empty.
    """
    sig, root = groups(docs, max_distance)
    fs = ["f0", "f1", "f2", "f3"]
    member = sig.join(sig.groupBy(*fs).agg(F.min("doc_id").alias("node")), fs).join(root, "node", "left")
    rows = member.groupBy(F.coalesce("root", "node").alias("g"), "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("g").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    own_id, own_hash, told_id, told_hash, stays, again, whole = unused(docs, "id0", "hash0", "id", "hash", "stays", "again", "whole")
    verdict = rows.join(least, "g").select(F.col("doc_id").alias(told_id), F.col("text_hash").alias(told_hash), (F.struct("doc_id", "text_hash") == F.col("first")).alias(stays), (F.col("n") > 1).alias(again))
    verdict = cut(verdict.where(~F.col(stays) | F.col(again)), "verdict")
    names = docs.columns
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64(F.col("text").cast("string"))})
    hit = (F.col(own_id) == F.col(told_id)) & (F.col(own_hash) == F.col(told_hash))
    # whole rows are exchanged once, by hash, at every size: the rows to drop are too many to broadcast when there are many documents
    out = keyed.join(verdict.where(~F.col(stays)).hint("shuffle_hash"), hit, "left_anti")
    repeated = verdict.where(stays)
    if repeated.isEmpty():
        return out.select(*names)
    sortable = [c for c, kind in docs.dtypes if "map<" not in kind]
    first = F.min_by(F.struct(*names), F.xxhash64(*sortable)).alias(whole)
    kept = out.join(repeated, hit, "left_semi").groupBy(own_id, own_hash).agg(first).select(f"{whole}.*")
    return out.join(repeated, hit, "left_anti").select(*names).unionByName(kept)
