import random

from pyspark.sql import functions as F

from foliate.llm import decontamination as D
from foliate.llm.shared import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, items, least):
    cut = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    marked = [(i, n, cut(words(t), n)) for i, t in set(items) if i is not None for n in [min(5, len(words(t)))] if n]
    out = []
    for d, t in docs:
        own = {n: cut(words(t), n) for n in range(1, 6)}
        out += [(d, i, round(len(s & own[n]) / len(s), 9)) for i, n, s in marked if len(s & own[n]) / len(s) >= least]
    return sorted(out, key=str)


def make():
    r = random.Random(8)
    w = ["".join(r.choice("abcdefghijk") for _ in range(r.randint(1, 6))) for _ in range(500)]
    text = lambda n: [r.choice(w) for _ in range(n)]
    items = [(i, text(r.choice([2, 3, 5, 6, 7, 8, 9, 10, 15, 20, 60]))) for i in range(120)]
    docs = []
    for i in range(300):
        own = text(r.choice([0, 3, 30, 200, 3000]))
        for _ in range(r.choice([0, 0, 1, 2])):
            passage = [r.choice(w) if r.random() < 0.03 else x for x in r.choice(items)[1]]
            at = r.randint(0, len(own))
            own[at:at] = passage[: r.choice([len(passage), len(passage), 8])]
        docs.append((i, " ".join(own)))
    items = [(i, " ".join(t)) for i, t in items]
    docs += [docs[1], docs[1], (None, items[0][1]), (900, None), (901, ""), (902, "z " * 200000 + items[3][1])]
    return docs, items + [items[5], (500, None), (None, items[0][1]), (501, "too short"), (502, "")]


def test_leaks_match_brute_force(spark, monkeypatch):
    docs, items = make()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).withColumns({"item_id": F.lit("q"), "containment": F.lit(1)})
    want = brute(docs, items, 0.5)
    assert len(want) > 150
    for chars in (D.INDEX_CHARS, 3000):  # one index, or several passes
        monkeypatch.setattr(D, "INDEX_CHARS", chars)
        got = sorted(((r.doc_id, r.item_id, round(r.containment, 9)) for r in D.leaks(table, bench).collect()), key=str)
        assert got == want
        assert (902, 3, 1.0) in got and (None, 0, 1.0) in got and {len(dict(items)[i].split()) for _, i, _ in got if i is not None} >= {2, 3, 5, 6, 7, 8}
        kept = D.decontaminate(table, bench)
        assert kept.columns == table.columns
        bad = {d for d, _, _ in got}
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 0)], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 1
    assert D.leaks(docs.limit(0), bench).count() == D.leaks(docs, bench.limit(0)).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == 1
