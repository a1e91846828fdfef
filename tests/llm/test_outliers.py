import math
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliate.llm import outliers as O

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghiklmnorstu") for _ in range(r.randint(1, 9))) for _ in range(800)]
    rows = []
    for i in range(900):
        own = [r.choice(vocab) for _ in range(int(math.exp(r.gauss(4.5, 0.7))) + 3)]
        text = ". ".join(" ".join(own[k : k + 9]).capitalize() for k in range(0, len(own), 9))
        if i % 10 == 0:
            text = re.sub(r" ", " $$$ %%% ", text)
        elif i % 10 == 1:
            text = " ".join([own[0].upper()] * 60)
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, text, lang, r.choice(["a", "b"]) if lang == "en" else f"s{i % 50}"))
    rows += [(2000, None, "en", "a"), (2001, "", "en", "a"), (2002, " \n ", "xx", None), (2003, "One small text of an unknown language.", None, None), (None, rows[2][1], "en", "a")]
    return rows + [rows[4]] * 500 + [(2004, "word of length " * 100000, "en", "a")]


def vector(text):
    w = [x for x in re.split(r"[ \t\r\n]+", text or "") if x]
    if not w:
        return None
    n, spaces = len(text), len(re.findall(r"[ \t\r\n]", text))
    signs = sum(not (c.isalpha() or c.isnumeric() or c in " \t\r\n") for c in text)
    return (math.log(len(w)), math.log(len(set(w))), math.log((n - spaces + 10) / (len(w) + 2)), math.log((sum(c.isupper() for c in text) + 5) / (n + 150)), math.log((signs + 5) / (n + 150)), math.log((text.count("\n") + 1) / (len(w) + 100)))


def mcd(x):
    """One group by the same definition, in memory."""
    ridge = O.RIDGE * np.eye(O.D)
    q = np.percentile(np.floor(x * O.GRID + 0.5), [25, 50, 75], axis=0) / O.GRID
    mid, scale = q[1], np.maximum((q[2] - q[0]) / 1.349, O.RIDGE**0.5)
    z = (x - mid) / scale
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    both = np.outer(scale, scale)
    starts = [both * np.eye(O.D), both * np.corrcoef(np.tanh(z).T), both * (u.T @ u) / len(x) * O.D]

    def far(m, c):
        return np.einsum("ki,ij,kj->k", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        cell = np.floor(np.log(far(m, c) + 1e-9) * O.GRID)
        near = x[cell <= np.ceil(np.percentile(cell, 100 * O.H))]
        return near.mean(axis=0), np.cov(near.T, bias=True) + ridge

    found = []
    for c in starts:
        now = mid, c + ridge
        for _ in range(O.FIRST_STEPS):
            now = step(*now)
        found.append((np.linalg.slogdet(now[1])[1], now))
    now = min(found, key=lambda f: f[0])[1]
    for _ in range(O.MOST_STEPS):
        was, now = now, step(*now)
        if abs(np.linalg.slogdet(now[1])[1] - np.linalg.slogdet(was[1])[1]) < O.STILL:
            break
    near = x[far(*now) <= O.chi2_beyond(1 - O.REWEIGHT, O.D) * O.consistency(O.H)]
    return near.mean(axis=0), O.consistency(O.REWEIGHT) * np.cov(near.T, bias=True) + ridge


def brute(rows):
    groups = defaultdict(set)
    for _, t, lang, source in rows:
        if v := vector(t):
            own = lang or "", source or ""
            for level in ((0, *own), (1, own[0], ""), (2, "", "")):
                groups[level].add((own, v))
    fits = {g: mcd(np.array(sorted(v for _, v in own))) for g, own in groups.items() if len(own) >= O.LEAST}
    out = []
    for i, t, lang, source in rows:
        own = lang or "", source or ""
        if not (v := vector(t)):
            out.append((i, *own, None, None, True))
            continue
        level = next(g for g in ((0, *own), (1, own[0], ""), (2, "", "")) if g in fits)
        m, c = fits[level]
        d = math.sqrt((np.array(v) - m) @ np.linalg.inv(c) @ (np.array(v) - m))
        out.append((i, *own, level[0], d, d * d > O.chi2_beyond(O.TAIL, O.D)))
    return sorted(out, key=str)


def test_verdicts_match_estimates_in_memory(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], SCHEMA).withColumns({"level": F.lit("l"), "x0": F.lit(1), "start": F.lit(2), "n": F.lit(3)})
    got = sorted((tuple(r) for r in O.verdicts(docs).collect()), key=str)
    want = brute(rows)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[5])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str)
    near = {key(r): r[4] for r in want}
    assert all(r[4] is None and near[key(r)] is None or abs(r[4] - near[key(r)]) < 0.02 * max(1, r[4]) for r in got)
    assert {r[3] for r in got} == {0, 1, 2, None}
    bad = {r[0] for r in got if r[5]}
    assert bad >= {i for i in range(900) if i % 10 < 2} | {2000, 2001, 2002, 2004} and len([i for i in bad if i is not None and i < 900 and i % 10 > 1]) <= 5
    assert {r.doc_id for r in O.keep(docs).collect()} == {r[0] for r in got if not r[5]}


def test_empty_and_one_row(spark):
    docs = spark.createDataFrame([(1, "only one", "en", "a", 0)], SCHEMA)
    assert O.verdicts(docs.limit(0)).count() == 0
    assert [r.rejected for r in O.verdicts(docs).collect()] == [False]


def test_chi_square():
    assert abs(O.chi2_beyond(0.025, 6) - 14.4494) < 1e-3 and abs(O.chi2_tail(13.3616, 8) - 0.1) < 1e-4
