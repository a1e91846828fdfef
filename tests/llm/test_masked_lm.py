import math
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliate.llm import masked_lm as M

NEXT = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in (1, 2)] for i in range(60)}


def chain(r, n):
    out = [f"w{r.randrange(60)}"]
    while len(out) < n:
        out.append(r.choice(NEXT[out[-1]]) if r.random() > 0.02 else "rare" + str(r.randrange(10**6)))
        if out[-1].startswith("rare"):
            out.append(f"w{r.randrange(60)}")
    return " ".join(out)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    rows = [(i, chain(r, r.randint(1, 300))) for i in range(500)]
    rows += [(1000, None), (1001, ""), (None, "W1 w2\tw3"), (1002, "w1 " * 100000), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("n"), "net": F.lit(0)})


def test_scores_are_sums_of_conditionals_and_tell_order(spark, tables):
    rows, docs = tables
    model = M.fit(docs, rounds=5)
    vocabulary, values = model.vocabulary, model.net
    counts = Counter(w for _, t in rows for w in (t or "").lower().split())
    assert vocabulary == sorted(counts, key=lambda w: (-counts[w], w))[: M.VOCABULARY - M.SHAPES]
    net = {k: v.astype(float) for k, v in M.unflat(values).items()}
    number = {w: k for k, w in enumerate(vocabulary)}

    shapes = Counter()
    for w, n in counts.items():
        shapes[M.shape(w)] += n * (w not in number)

    def softmax(x):
        e = [math.exp(v) for v in x]
        return [v / sum(e) for v in e]

    def brute(text):
        own = (text or "").lower().split()
        ids = [number.get(w, M.VOCABULARY - M.SHAPES + M.shape(w)) for w in own]
        total = sum(math.log(counts[w] / shapes[M.shape(w)]) for w in own if w not in number)
        for k, t in enumerate(ids):
            x = sum(net["embed"][ids[k + s] if 0 <= k + s < len(ids) else M.EDGE] * net["place"][j] for j, s in enumerate((-2, -1, 1, 2)))
            h = np.tanh(x @ net["w"] + net["b"])
            total += math.log(softmax(h @ net["c"] + net["cb"])[t // M.WIDTH]) + math.log(softmax(h @ net["o"][t // M.WIDTH] + net["ob"][t // M.WIDTH])[t % M.WIDTH])
        return len(ids), total

    got = M.score(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    text = dict(rows)
    for r in got:
        if r.doc_id is None or r.doc_id < 30 or r.doc_id in (1000, 1001):
            n, total = brute(text[r.doc_id])
            assert r.tokens == n and abs(r.log_likelihood - total) < 1e-3 * max(1, abs(total))
            assert r.per_token is None if not n else abs(r.per_token - r.log_likelihood / n) < 1e-9
    # held-out texts: better than the frequencies of words, and worse once shuffled
    r = random.Random(60)
    held = [chain(r, 200) for _ in range(20)]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in held]
    each = lambda texts: np.array([x.per_token for x in sorted(M.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect())])
    total = sum(counts.values())
    unigram = np.mean([math.log(max(counts[w], 1) / total) for t in held for w in t.split() if w in number])
    assert each(held).mean() > unigram + 1 and (each(held) > each(mixed) + 0.3).all()


def test_gradients():
    r = np.random.default_rng(3)
    net = {k: v + r.normal(0, 0.1, v.shape) for k, v in M.fresh().items()}
    around, target = r.integers(0, 40, (50, 4)), r.integers(0, 200, 50)
    around[0, 0] = M.EDGE
    _, g = M.gradients(net, around, target)
    assert abs(-M.log_probabilities(net, around, target).mean() - M.gradients(net, around, target)[0]) < 1e-6
    for k, v in net.items():
        for at in np.argsort(-np.abs(g[k]).ravel())[:3]:
            keep, eps = v.flat[at], 1e-5
            v.flat[at] = keep + eps
            up = M.gradients(net, around, target)[0]
            v.flat[at] = keep - eps
            down = M.gradients(net, around, target)[0]
            v.flat[at] = keep
            assert abs((up - down) / 2 / eps - g[k].flat[at]) < 1e-5


def test_probabilities_and_gradients_with_large_logits():
    r = np.random.default_rng(4)
    net = {k: v + r.normal(0, 0.1, v.shape) for k, v in M.fresh().items()}
    net["cb"] += 900 * r.random(M.CLASSES)
    net["ob"] -= 900 * r.random(net["ob"].shape)
    around, target = r.integers(0, M.VOCABULARY + 1, (3 * M.BATCH, 4)), np.r_[np.zeros(2 * M.BATCH, dtype=int), r.integers(0, M.VOCABULARY, M.BATCH)]
    got = M.log_probabilities(net, around, target)
    for k in range(0, len(target), 997):
        h = np.tanh((net["embed"][around[k]] * net["place"]).sum(axis=0) @ net["w"] + net["b"])
        c, want = target[k] // M.WIDTH, 0.0
        for logits, at in ((h @ net["c"] + net["cb"], c), (h @ net["o"][c] + net["ob"][c], target[k] % M.WIDTH)):
            want += logits[at] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        assert abs(got[k] - want) < 1e-6
    assert abs(M.gradients(net, around, target)[0] + got.mean()) < 1e-6


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_sums_of_rows(kind):
    r = np.random.default_rng(5)
    of = np.r_[np.repeat(np.arange(9), np.arange(9)), np.full(500, 11), [19]].astype(np.uint16)  # 0 to 8 rows a number, many, one
    of, rows = r.permutation(of), r.integers(-9, 9, (len(of), M.EMBED)).astype(kind)
    want = np.zeros((20, M.EMBED), dtype=kind)
    np.add.at(want, of, rows)
    got = M._sums(rows, of, 20)
    assert got.dtype == kind and (got == want).all() and not M._sums(rows[:1], of[:1] * 0 + 3, 20)[4:].any()


def test_words_are_coded_without_a_call_for_each(spark, monkeypatch):
    words = [f"{'añ' * (k % 9)}{k}" for k in range(5000)]
    text, calls = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([" ".join(words[:3000]), None, " ".join(words)])], names=["doc_id", "text"]), []
    run = M._encode(spark.sparkContext.broadcast(words[:40]))
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" and frame.f_code.co_filename == M.__file__ else None)
    try:
        first = list(run(iter([text])))
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words) / 2
    monkeypatch.setattr(M, "KEPT_WORDS", 1000)  # kept words are dropped and found anew
    for batch in (*first, *run(iter([text])), *run(iter([text]))):
        own = [[], [], []]
        for k, told in enumerate((words[:3000], [], words)):
            own[k] = [j if (j := words.index(w) if w in words[:40] else -1) >= 0 else M.VOCABULARY - M.SHAPES + M.shape(w) for w in told]
            assert np.frombuffer(batch.column("ids")[k].as_py(), dtype=np.uint16).tolist() == own[k]
            assert dict(zip(batch.column("tail")[k].as_py(), batch.column("times")[k].as_py())) == Counter(M.tail_hash(w) for w in told[40:])


def test_rounds_mask_every_position_once():
    lengths = np.array([1000, 0, 5000])
    found = [M.masked(np.arange(3, dtype=np.uint64), lengths, k, 4) for k in range(4)]
    assert sorted(np.concatenate(found).tolist()) == list(range(6000)) and all(1300 < len(x) < 1700 for x in found)


def test_contexts():
    ids = np.array([1, 2, 3, 4, 5], dtype=np.uint16)
    e = M.EDGE
    assert M.contexts(ids, np.array([3, 0, 2]), np.arange(5)).tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, 5, e], [e, 4, e, e]]


def test_hash_in_columns(spark):
    for w in ("", "a", "größe", "x" * 100, "слово"):
        assert spark.sql(f"select shiftrightunsigned(xxhash64('{w}'), {M.SPLIT}) as h").first().h == M.tail_hash(w)


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(16)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(r.choice(common) if r.random() < 0.6 else f"t{r.randrange(9000)}" for _ in range(120))) for i in range(400)]
    rare = lambda: "".join(r.choice("aeioubcdfghlmnprst") for _ in range(9))
    rows += [(1000 + i, " ".join(r.choice(common) if r.random() < 0.6 else rare() for _ in range(120))) for i in range(40)]
    rows += [(2000 + i, rows[400 + i][1]) for i in range(20)]  # 1000.. to 1019 occur twice
    return rows


def test_same_scores_in_any_partitioning(spark, many, monkeypatch):
    monkeypatch.setattr(M, "UNIT", 10_000)
    docs = spark.createDataFrame(many, "doc_id long, text string")
    got = [sorted((r.doc_id, r.log_likelihood) for r in M.pseudo_likelihood(docs.repartition(n)).collect()) for n in (4, 16)]
    assert [i for i, _ in got[0]] == [i for i, _ in got[1]] and max(abs(a[1] - b[1]) for a, b in zip(*got)) < 1e-4  # of about 1000


def test_words_outside_the_vocabulary_are_told_apart(spark, many):
    got = {r.doc_id: r.per_token for r in M.pseudo_likelihood(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    twice, single = [got[1000 + k] for k in range(20)], [got[1000 + k] for k in range(20, 40)]
    assert np.mean(twice) > np.mean(single) + 0.1


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.pseudo_likelihood(empty).count() == 0
    assert [r.per_token for r in M.pseudo_likelihood(spark.createDataFrame([(1, None)], empty.schema)).collect()] == [None]
