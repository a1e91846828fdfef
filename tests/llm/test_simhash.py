import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliate.llm import simhash
from foliate.llm.shared import components, merge, mix64, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, most=simhash.MAX_DISTANCE):
    """{doc_id: least doc_id of its group} from all pairs."""
    marked = [(i, set(words(t))) for i, t in rows if i is not None and words(t)]
    prints = []
    for _, own in marked:
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in own], dtype=np.uint64)
        four = np.stack([h, *(mix64(h ^ np.uint64(0xA5A5A5A5 * i)) for i in (1, 2, 3))], axis=1)
        prints.append(2 * np.unpackbits(four.view(np.uint8), axis=1).sum(axis=0) > len(h))
    up = {i: i for i, _ in marked}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    grouped = set()
    for a in range(len(marked)):
        for b in range(a + 1, len(marked)):
            if (prints[a] != prints[b]).sum() <= most:
                x, y = top(marked[a][0]), top(marked[b][0])
                up[max(x, y)] = min(x, y)
                grouped |= {marked[a][0], marked[b][0]}
    return {i: top(i) for i in grouped}


def corpus():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for _ in range(60):
        own = [r.choice(vocab) for _ in range(r.choice([12, 150, 400]))]
        rows.append((len(rows), " ".join(own)))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            near = [r.choice(vocab) if r.random() < r.choice([0, 0.01, 0.03]) else w for w in own]
            rows.append((len(rows), " ".join(near)))
    return rows + [(900, None), (901, ""), (902, "?!"), (None, rows[0][1]), (903, "x " * 200000 + "y"), (904, "X y")]


def test_groups_match_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert got == want and len(want) > 100
    assert got[903] == got[904] == 903


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus()
    rows += [rows[0], rows[0], (5000, "alone here with nobody else"), (5000, "alone here with nobody else")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(f"mine {c}") for c in ("a", "root", "key", "f0", "id", "_id", "__id", "id0", "__id0", "hash", "__hash", "__hash0", "stays", "__stays", "again", "whole", "Hash0")})
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[5:] for r in out.collect()} == {tuple(f"mine {c}" for c in docs.columns[5:])}
    got = [r.doc_id for r in out.collect()]
    group = brute([r for r in rows])
    want = {i for i, _ in rows if i not in group or group[i] == i}
    assert set(got) == want
    assert got.count(0) == 1 and got.count(5000) == 1 and None in got and {900, 901, 902} <= set(got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_link_finds_what_all_pairs_find():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, (40, 4)).astype(np.uint64)
    f = np.repeat(base, 30, axis=0)
    for _ in range(12):
        f[np.arange(len(f)), r.integers(0, 4, len(f))] ^= np.uint64(1) << r.integers(0, 64, len(f)).astype(np.uint64)
    f[:, 0] = (f[:, 0] & ~np.uint64(0xFFFF)) | np.uint64(7)
    got, want = np.arange(len(f)), np.arange(len(f))
    simhash.link(f, np.zeros(len(f), dtype=np.int64), np.arange(len(f)), 18, got)
    near = np.argwhere(np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 18)
    merge(want, near[:, 0], near[:, 1])
    assert (got == want).all()


def test_tables_meet_pairs_at_the_radius():
    r = np.random.default_rng(2)
    for n in (50, 5000, 10**7):
        bits = simhash.tables(n, 32)
        differ = np.stack([np.isin(np.arange(256), r.permutation(256)[:32]) for _ in range(20_000)])
        met = np.zeros(len(differ), dtype=bool)
        for t in bits:
            met |= ~differ[:, t].any(axis=1)
        assert met.mean() >= 0.998


def test_gray_rank_orders_neighbours():
    f = np.array([[a, b] for a in range(4) for b in range(4)], dtype=np.uint64) << np.uint64(62)
    at = np.lexsort(simhash.gray_rank(f >> np.uint64(0)).T[::-1])
    steps = np.bitwise_count(f[at][1:] ^ f[at][:-1]).sum(axis=1)
    assert (steps <= 2).all() and sorted(at.tolist()) == list(range(16))


def test_rows_that_repeat_id_and_text_leave_one_at_any_order(spark):
    rows = [(1, "same text of a few words", "en", "s", k) for k in range(5)] + [(2, "same text of a few words", "en", "s", 9)]
    got = {tuple(map(tuple, simhash.deduplicate(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, rows[::-1])}
    assert len(got) == 1 and len(next(iter(got))) == 1


def test_keys_of_several_batches_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = corpus()
        got = {r.doc_id: r.group_id for r in simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == brute(rows)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
