import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliate.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, shares, temperature):
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    n = lambda t: len((t or "").split())
    by = defaultdict(list)
    for i, t, s in rows:
        if i is not None:
            by[s or ""].append((h(i), i, n(t)))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    total = {s: v for s, v in total.items() if v}
    out = []
    for s in total:
        for x, i, k in by[s]:
            before = sum(y[2] for y in by[s] if y[0] < x)
            took = [lv for lv, share in enumerate(shares, 1) if before < int(share * sum(total.values()) * total[s] ** temperature / sum(v**temperature for v in total.values()))]
            if took:
                out.append((i, s, k, took[0]))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), f"s{r.choice([0, 0, 0, 0, 1, 2])}") for i in range(400)]
    return rows + [rows[0], rows[0], (None, "a b", "s1"), (500, None, "s1"), (501, "", "s2"), (502, "a\tb\n c", None), (503, "w " * 100000, "long")]


def test_levels(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    for shares, temperature in ((mixing.BUDGETS, mixing.TEMPERATURE), ((0.01, 0.9), 0.0)):
        got = sorted((r.doc_id, r.source, r.tokens, r.level) for r in mixing.levels(docs, shares, temperature).collect())
        assert got == brute(rows, shares, temperature)


def test_mix_keeps_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA).withColumns({c: F.lit("mine") for c in ("h", "level", "threshold", "__source", "__most", "told_source", "Most")})
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(x[0] for x in brute(rows, mixing.BUDGETS, mixing.TEMPERATURE))
    assert {(r["__source"], r.told_source, r.Most) for r in out.collect()} == {("mine",) * 3}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.levels(docs.limit(0)).count() == 0
