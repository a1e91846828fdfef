"""run() of the pipeline against the operators' brute-force versions, one stage after the other."""

import random

import test_decontamination
import test_mixing
import test_simhash

import corpus_pipeline
from foliate.llm import decontamination, mixing, pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    r = random.Random(9)
    vocab = ["".join(r.choice("abdehilnorstu") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(20))) for i in range(10)]
    rows, labels = [], []
    for i in range(240):
        own = text(r.randint(30, 120))
        kind = i % 8
        if kind == 0:
            for _ in range(4):
                own.insert(r.randrange(len(own)), r.choice(["stupid", "worthless", "5cum", "scum"]))
        elif kind == 1 and i > 8:
            own = rows[i - 4][1].split() + ["extra"]
        elif kind == 2:
            own[10:10] = items[i % 10][1].split()
        elif kind == 3:
            own.insert(5, f"user{i}@mail.example.com")
        rows.append((i, " ".join(own), f"s{i % 3}"))
        labels.append((i, 1, int(kind == 0)))
    return rows + [(900, None, "s1"), (901, "", None), (None, "alone here without number", "s1")], labels, items


def test_run_matches_brute_force(spark, tmp_path):
    rows, labels, items = make()
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = toxicity.fit(docs, labelled).prepare()
    left = [x for x in rows if model.score(x[1]) <= model.threshold]
    assert not {i for i, _, _ in left} & {i for i, _, bad in labels if bad} and len(left) == len(rows) - sum(bad for _, _, bad in labels)
    group = test_simhash.brute([(i, t) for i, t, _ in left])
    left = [x for x in left if group.get(x[0], x[0]) == x[0]]
    assert group
    leaked = {d for d, _, _ in test_decontamination.brute([(i, t or "") for i, t, _ in left], items, decontamination.CONTAINMENT)}
    assert leaked
    left = [x for x in left if x[0] not in leaked]
    want = {i for i, *_ in test_mixing.brute([(i, t, s) for i, t, s in left], mixing.BUDGETS, mixing.TEMPERATURE)}

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == want
    before = {i: t for i, t, _ in left}
    for i, text in got.items():
        marked = pii.entities(before[i])
        assert (text != before[i]) == bool(marked)
        assert not {s[3] for s in marked} & {s[3] for s in pii.entities(text)}
    assert any(pii.entities(before[i]) for i in got)


def test_run_with_any_columns_and_empty(spark, tmp_path):
    names = ["__md5", "__known", "__source", "__most", "__id", "__id0", "__hash", "__hash0", "__stays", "md5", "found", "known", "most", "id", "stays", "again", "whole", "h", "level"]
    words = [f"w{k}" for k in range(3000)]
    random.Random(4).shuffle(words)
    texts = [" ".join(words[k * 40 : k * 40 + 40]) + f" mail user{k}@example.com" for k in range(60)]
    texts += [texts[0], texts[0], None, "", " ".join(words) * 40]
    rows = [(k if k < 60 or k > 61 else 0, t, "en", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'mine' as `{c}`" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == docs.columns and got and all(r[c] == "mine" for r in got for c in names)
    assert len({r.doc_id for r in got if r.text}) == sum(bool(r.text) for r in got)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
