import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import toxicity
from foliate.llm.toxicity import BREAK, DROP, LEET, ONCE, TWICE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(5)
    plain = ["".join(r.choice("abdehilnorstu") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        w = [r.choice(plain) for _ in range(r.randint(15, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(r.randrange(len(w)), r.choice(["stupid", "worthless", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "stupid scum, stupid worthless"), (1002, "x " * 100000 + "5tup1d sc*m w.o.r.t.h.l.e.s.s"), (1003, "s t u p i d and scuuuum and $tupid"), (1003, "s t u p i d and scuuuum and $tupid"), (1004, "***!!! $$$ 123 a@b.example.com")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + extra], SCHEMA)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")


def test_flags_what_the_labels_and_obfuscations_say(spark, tables):
    docs, labels = tables
    got = sorted((r.doc_id for r in toxicity.toxic_documents(docs, labels).collect()), key=str)
    assert got == sorted([*range(0, 300, 4), None, 1002, 1003, 1003], key=str)
    kept = toxicity.drop_toxic(docs.withColumns({"score": F.lit("s"), "toxic": F.lit(0)}), labels)
    assert kept.columns == [*docs.columns, "score", "toxic"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i % 4] + [1000, 1001, 1004]


def test_viterbi_finds_the_best_of_all_paths(tables):
    model = toxicity.fit(*tables).prepare()

    def brute(token):
        ways, k = [], 0
        while k < len(token):
            c, r = token[k], 1
            while (c in LEET or c.isalpha()) and k + r < len(token) and token[k + r] == c:
                r += 1
            if c.isalpha():
                ways.append([(c, 0.0)] if r == 1 else [(c, ONCE if r > 2 else TWICE), (c * 2, TWICE if r > 2 else 0.0)])
            elif c in LEET:
                w = [(x * m, p * m + (ONCE if r > 1 and m == 1 else 0)) for x, p in LEET[c].items() for m in {1, min(r, 2)}] + [(" ", BREAK)]
                ways.append(w + [("", DROP)] * (c in "*|"))
            else:
                ways.append([("", DROP), (" ", BREAK)])
            k += r
        best = None
        for path in itertools.product(*ways):
            s, h = 0.0, "    "
            for x, p in path:
                s += p
                for y in x:
                    if not (y == " " and h[-1] == " "):
                        s += model.step(h, y)
                        h = "    " if y == " " else h[1:] + y
            s += model.step(h, " ") if h[-1] != " " else 0
            if best is None or s > best[0]:
                best = (s, "".join(x for x, _ in path))
        return best[1]

    for token in ["5tup1d", "sc*m", "w0rth1e55", "s.t.u.p.i.d", "llooo1-3", "st_u**pid", "a4@a", "tttt7"]:
        assert model.restore(token) == brute(token), token
    assert model.restore("5tup1d") == "stupid" and model.restore("s-c-u-m") == "scum"


def test_empty_tables(spark, tables):
    docs, labels = tables
    assert toxicity.toxic_documents(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()


def test_a_minority_language_has_its_own_lexicon(spark):
    rows, labels = corpus()
    r = random.Random(11)
    plain = ["".join(r.choice("äöyukmpvjgfc") for _ in range(r.randint(3, 6))) for _ in range(2000)]
    bad = ["tollo", "urpo", "moukka", "lurjus", "kelmi", "hylkiö", "konna", "roisto"]
    docs = [(i, t, "en") for i, t in rows]
    for i in range(60):  # each bad word in 4 of 8 toxic documents: few beside the English ones
        w = [r.choice(plain) for _ in range(30)]
        for k in range(4 * (i < 8)):
            w.insert(r.randrange(len(w)), bad[(i + k) % 8])
        docs.append((2000 + i, " ".join(w), "fi"))
        labels.append((2000 + i, 1, int(i < 8)))
    docs += [(3000, "a urpo and a kelmi and a moukka", "fi"), (3001, "stupid worthless scum here", "fi"), (3002, "stupid worthless scum here", "xx"), (3003, "stupid worthless scum here", None)]
    df = spark.createDataFrame([(i, t, k, "s", 0) for i, t, k in docs], SCHEMA)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(r.doc_id for r in toxicity.toxic_documents(df, told).collect())
    assert got == [*range(0, 300, 4), *range(2000, 2008), 3000, 3001, 3002, 3003]


def test_threshold_ignores_toxic_documents_without_a_word():
    zero, score = [0.0] * 400, [9.0, 10.0, 15.0]
    assert toxicity.cut_point(np.array([*zero, 4.0]), np.array([0.0, *score])) == 6.5


def test_spaced_doubled_and_split_words(tables):
    model = toxicity.fit(*tables).prepare()
    one = {w: model.lexicon[w] for w in ("stupid", "worthless", "scum")}
    for text, found in [
        ("a s t u p i d", ["stupid"]), ("you are a s t u p i d", ["stupid"]), ("s t u p i d s c u m", ["stupid", "scum"]), ("s t u p i d   s c u m", ["stupid", "scum"]),
        ("sstupid", ["stupid"]), ("stuupid", ["stupid"]), ("stu pid", ["stupid"]), ("(wor th less)", ["worthless"]), ("s cu m", ["scum"]),
        ("sc um, stu pid", ["scum", "stupid"]), ("s t u p i d", ["stupid"]), ("a e", []), ("no run", []), ("stupid", ["stupid"]),
    ]:
        assert abs(model.score(text) - sum(one[w] for w in found)) < 1e-9, text
    assert toxicity.SPACED.search("x a b y").group() == "x a b y" and toxicity.SPACED.search("it a b is").group() == "a b"
    three = toxicity.Model({"fag": 5.0}, model.grams, 1.0).prepare()
    assert three.score("he is f a g here") == 5.0
    assert model.score("a b " * 100000) == 0


def test_long_tokens_take_linear_time():
    m = toxicity.Model({"stupid": 5.0, "idiot": 5.0}, np.random.default_rng(1).integers(0, 50, toxicity.N**3), 1.0).prepare()
    took = []
    for n in (400, 4000):
        began = time.process_time()
        m.restore("a" + "*1" * n + "b")
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 0.5


def test_lookalike_letters():
    m = toxicity.Model({"stupid": 5.0, "scum": 4.0, "глупый": 3.0}, np.ones(toxicity.N**3, dtype=np.int64), 1.0).prepare()
    assert m.score("you stuріd") == 5.0 and m.score("ｓｃｕｍ") == 4.0 and m.score("𝐬𝐭𝐮𝐩𝐢𝐝") == 5.0  # Cyrillic, full-width, bold
    assert m.score("он глупый") == 3.0 and m.score("гл*пый") == 0 and m.score("глуп4ый") == 0 and m.score("rоse") == 0
