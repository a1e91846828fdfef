import io
import json
import random
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliate.functions import classify as C
from foliate.functions import text as T
from foliate.operators import anchors as A
from foliate.operators import convert as K
from foliate.operators import grouped as G
from foliate.operators import levels as L
from foliate.operators import pages as P
from foliate.operators import render as R
from foliate.operators import tables as TB
from foliate.operators import translate as TR
from foliate.sources import providers as S
from foliate.streaming import ingest


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return df.select(f(*(F.col(n) for n in names)).alias("x")).first().x


@pytest.mark.parametrize(("text", "key", "core"), [("— IV — The  End", "theend", "theend"), ("第三章 “法”的$x$概念", '第三章"法"的x概念', "法的x概念"), ("1. Größe$^{2}$", "1.grösse", "grösse"), ("  ", "", "")])
def test_title_keys(spark, text, key, core):
    assert one(spark, T.title_key, text) == key and one(spark, T.core_key, text) == core


def test_scalars(spark):
    assert one(spark, T.strip_trailing_page, "Intro ……… 60") == "Intro"
    assert one(spark, T.join_dehyphened, "exam-", "ple") == "example" and one(spark, T.join_dehyphened, "two", "words") == "two words" and one(spark, T.join_dehyphened, "中", "文") == "中文"
    assert one(spark, T.full_punctuation, "中文, a $x,y$ 3.5.") == "中文， a $x,y$ 3.5."
    assert one(spark, T.newer, "v1.10", "1.9.3") and not one(spark, T.newer, "1.2", "1.2.0")
    assert json.loads(one(spark, T.first_json, 'x ```json\n{"a": 1}\n``` {')) == {"a": 1}
    assert [one(spark, C.roman, x) for x in ("MCMXCIV", "iv", "ABC", "")] == [1994, 4, None, None]
    assert tuple(one(spark, C.series, "IX. end")) == ("roman", 9) and one(spark, C.series, "none") is None
    assert [one(spark, C.title_shape, x) for x in ("第一章 x", "Kapitel 2", "(3) a", "b. c", "word")] == ["chap_cn", "chap_en", "num_paren", "alpha", "plain"]
    assert one(spark, C.is_list_item, "（二）x") and not one(spark, C.is_list_item, "word")
    assert tuple(one(spark, C.caption_number, "Table A-1. x")) == ("table", "A1")
    assert one(spark, T.half_width, "ＡＢ１") == "AB1"


def test_boxes(spark):
    df = spark.createDataFrame([([10.0, 5.0, 30.0, 25.0],), ([10.0, 5.0, 10.0, 25.0],), ([-5.0, 0.0, 500.0, 2.5],)], "b array<double>")
    assert [r.x for r in df.select(C.norm_box(F.col("b"), F.lit(100.0), F.lit(1000.0)).alias("x")).collect()] == [[100, 5, 300, 25], None, [0, 0, 1000, 2]]
    bad = spark.createDataFrame([([0.1, 0.1, 0.2, 0.2],), ([0.1, 0.3, 0.2, 0.2],), ([0.1, 0.1, 1.2, 0.2],), ([0.1],)], "b array<double>")
    assert [r.x for r in bad.select(C.box_problem(F.col("b")).alias("x")).collect()] == [None, "corners out of order", "outside of the page", "not four numbers"]


def test_merge_refusals(spark):
    row = {"text_between": False, "caption1": "Table 1", "caption2": "Table 1 (continued)", "captions_agree": True, "footnotes": 1, "width1": 100.0, "width2": 105.0, "columns_agree": True}
    cases = [({}, None), ({"text_between": True}, "[text]"), ({"captions_agree": False}, "[caption]"), ({"caption2": "Table 1"}, "[continuation]"), ({"footnotes": 2}, "[footnote]"), ({"width2": 120.0}, "[width]"), ({"columns_agree": False}, "[columns]"), ({"caption2": None, "footnotes": 0}, None)]
    schema = "text_between boolean, caption1 string, caption2 string, captions_agree boolean, footnotes int, width1 double, width2 double, columns_agree boolean"
    df = spark.createDataFrame([tuple((row | c).values()) for c, _ in cases], schema)
    got = [r.x for r in df.select(C.merge_refusal({k: F.col(k) for k in row}).alias("x")).collect()]
    assert [g and g.split()[0] for g in got] == [w for _, w in cases]


def match_loop(key, anchors):
    if not key:
        return None
    tiers = [
        [(0, a) for a in anchors if a[1] == key], [(-len(a[1]), a) for a in anchors if a[1].startswith(key) and a[1] != key], [(len(a[1]), a) for a in anchors if len(key) >= 3 and a[1].endswith(key) and a[1] != key],
        [(-len(a[1]), a) for a in anchors if len(a[1]) >= 6 and key.startswith(a[1]) and a[1] != key], [(len(a[1]), a) for a in anchors if len(key) >= 8 and key in a[1]],
    ]
    for name, found in zip(A.TIERS, tiers):
        if found:
            return name, min(found)[1][0]
    near = []
    for a in anchors if len(key) >= 4 else []:
        rest = key[len(a[1]) :] if key.startswith(a[1]) else ""
        if rest and (rest[0].isdigit() or len(rest) == 1 and rest.isascii() and rest.isalpha()):
            continue
        limit = 1 if max(len(key), len(a[1])) < 8 else 2
        if (d := L.distance(key, a[1], limit)) <= limit:
            near.append((d, a[0]))
    best = sorted(near)
    return ("fuzzy", best[0][1]) if best and (len(best) == 1 or best[1][0] > best[0][0]) else None


def test_anchor_tiers_match_a_loop(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ab1x") for _ in range(n))
    anchors = [(d, k, word(r.randint(2, 18))) for d in range(20) for k in range(8)]
    blocks = []
    for d in range(20):
        for o in range(40):
            k = list(r.choice([a for a in anchors if a[0] == d])[2])
            for _ in range(r.randint(0, 2)):
                k[r.randrange(len(k))] = r.choice("ab1x")
            k = "".join(k)
            blocks.append((d, o, r.choice([k, k[: r.randint(1, len(k))], k[r.randrange(len(k)) :], k + word(3), k[1:-1], ""])))
    table = A.anchor_table(spark.createDataFrame([(d, k, t, 1, 1) for d, k, t in anchors], "doc_id int, toc_ord int, text string, level int, page int"))
    got = {(x.doc_id, x.ord): (x.tier, x.toc_ord) for x in A.match_anchors(spark.createDataFrame(blocks, "doc_id int, ord int, key string"), table).collect()}
    want = {(d, o): m for d, o, k in blocks if (m := match_loop(k, [(a[1], a[2]) for a in anchors if a[0] == d]))}
    assert got == want and {t for t, _ in got.values()} == set(A.TIERS)


def test_anchors_form_no_pairs(spark):
    """each block met each anchor of its document in a join."""
    b = spark.createDataFrame([(1, o, 1 + o // 8, f"key{o}") for o in range(30)] + [(1, 90, 1, "")], "doc_id long, ord int, page int, key string")
    a = A.anchor_table(spark.createDataFrame([(1, k, f"key{k}", 1, 10 * k) for k in range(5)], "doc_id long, toc_ord int, text string, level int, page int"))
    matches, votes = A.match_anchors(b, a), A.toc_pages(b, a)
    full = A.enriched_titles(b.withColumn("text", F.upper("key")), a)
    for df in (matches, votes, full):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.ord for r in matches.collect() if r.tier == "exact") == [0, 1, 2, 3, 4] and [tuple(r) for r in votes.collect()] == [(1, 1, 5)]
    assert {r.ord: r.full for r in full.collect()} == {o: f"key{o}" if o < 5 else f"KEY{o}" for o in range(30)} | {90: ""}


def test_index_of_long_documents_matches_a_scan(monkeypatch):
    """texts within anchors are found by their runs of eight characters where a document is long."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    keys = {word(r.randint(1, 40)): ((k, 0), {k}) for k in range(150)}
    scan = A.Index(keys)
    monkeypatch.setattr(A.Index, "SCANNED", 0)
    long = A.Index(keys)
    for _ in range(3000):
        k = word(r.randint(8, 14))
        want = min((x for x in keys if k in x), key=lambda x: (len(x), keys[x][0]), default=None)
        assert scan.containing(k) == long.containing(k) == want
        top = max((x for x in keys if k.startswith(x) and x != k), key=len, default=None)
        if (m := long.match(k, False)) and m[0] == 3:
            assert m[1] == top


def test_near_duplicate_pages_match_a_loop(spark):
    """each page's shingles were built one by one and exchanged with two neighbours'."""
    r = random.Random(7)
    base = "".join(r.choices("abcdefgh", k=200))
    pages = [(d, p, 0, r.choice([base, base[:190], base[:150], base + "x" * r.randint(1, 40), "short", " "])) for d in range(20) for p in range(12)]
    df = P.near_duplicate_pages(spark.createDataFrame(pages, "doc_id int, page int, ord int, text string"))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for d in range(20):
        back = []
        for _, p, _, t in [x for x in pages if x[0] == d and x[3].strip()]:
            s = {t[k : k + 8] for k in range(max(len(t) - 7, 1))}
            want[d, p] = any(kept and len(s & o) > 0.8 * len(s | o) for o, kept in back[-2:])
            back.append((s, not want[d, p]))
    assert {(x.doc_id, x.page): x.dropped for x in df.collect()} == want and {*want.values()} == {True, False}


def test_abbreviations_match_a_loop(spark):
    """F16: titles of a page were paired, their cores built four times."""
    r = random.Random(3)
    rows = [(d, o, o // 8, 1 + o % 2, c + "." * r.randint(0, 2), c) for d in range(5) for o in range(80) for c in [r.choice(["", "a", "ab", "abc", "b", "ba"])]]
    df = K.abbreviations(spark.createDataFrame(rows, "doc_id int, ord int, page int, level int, text string, core string"))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    gone = lambda a, b: a[:1] + a[2:4] == b[:1] + b[2:4] and a[1] != b[1] and a[5] and (b[5].startswith(a[5]) and b[5] != a[5] or a[5] == b[5] and (-len(a[4]), a[1]) > (-len(b[4]), b[1]))
    assert sorted((x.doc_id, x.ord) for x in df.collect()) == sorted((a[0], a[1]) for a in rows if any(gone(a, b) for b in rows))


def test_title_keys_of_plain_texts_take_the_short_way(spark):
    texts = ["plain Text", "\u3000- X. - a", "\u00a0—C—b\n", "\n- V -\n\n", "$^{2}$ - I - z", " $-I-$ w", "a \\left( b", "„a“ ‘b’", "Straße -I- x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def whole(x):
        x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\$\^\{[^}]*\}\$", ""), r"(?U)^\s+|\s+$", ""), r"(?i)^[–—-]\s*[CDILMVX]+\.?\s*[–—-]\s*", "")
        for old, new in (("$", ""), (r"\left", ""), (r"\right", ""), *T.QUOTES):
            x = F.replace(x, F.lit(old), F.lit(new))
        return T.fold(T.squeeze(x))

    assert all(r.a == r.b for r in df.select(T.title_key(F.col("t")).alias("a"), whole(F.col("t")).alias("b")).collect())


def test_parents_match_a_stack(spark):
    r = random.Random(2)
    rows = [(d, o, o + 1 if d == 4 and o < 15 else r.randint(-1, 15)) for d in range(5) for o in range(80)]
    want = {}
    for d in range(5):
        stack = []
        for _, o, level in [x for x in rows if x[0] == d]:
            depth = level if level > 0 else 100
            while stack and stack[-1][0] >= depth:
                stack.pop()
            want[d, o] = stack[-1][1] if stack else -1
            stack.append((depth, o))
    got = {(x.doc_id, x.ord): x.parent for x in P.parents(spark.createDataFrame(rows, "doc_id int, ord int, level int")).collect()}
    assert got == want


def test_calibration_and_ladder():
    t = pd.DataFrame([(1, 0, True, 1, "chap_en"), (1, 1, False, 5, "num_dot"), (1, 2, True, 2, "sec_en"), (1, 3, False, 9, "num_dot"), (1, 4, True, 1, "chap_en"), (1, 5, False, 3, "plain")], columns=["doc_id", "ord", "anchored", "level", "shape"])
    assert L.calibrate(t)["new_level"].tolist() == [1, 2, 2, 3, 1, 3]
    assert [len(g) for g in L.split_by_variation([1, 1, 1, 5, 5, 5])] == [3, 3]
    h = pd.DataFrame({"doc_id": 1, "ord": range(9), "height": [0.05] * 3 + [0.03] * 3 + [0.01] * 3, "anchored": [True, False, False] + [False] * 6, "level": [1] + [0] * 8})
    assert L.height_ladder(h)["ladder_level"].tolist() == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert L.height_ladder(h.iloc[:5]).empty


def test_chunks_and_votes():
    c = L.chunks(pd.DataFrame({"doc_id": 1, "page": range(1, 41), "items": 1}))
    assert c["first"].iloc[0] == 1 and c["last"].iloc[-1] == 40 and (c["first"].iloc[1:].tolist() == c["last"].iloc[:-1].tolist())
    assert len(L.chunks(pd.DataFrame({"doc_id": [1], "page": [3], "items": [9]}))) == 1
    v = pd.DataFrame([(1, 1, 13, 1, 2), (1, 1, 13, 2, 3), (1, 13, 25, 2, 1), (1, 13, 25, 3, 1)], columns=["doc_id", "first", "last", "id", "level"])
    assert dict(zip(*L.merge_votes(v)[["id", "level"]].T.values)) == {1: 2, 2: 3, 3: 3}


def test_orphans_rows_and_rescue():
    b = pd.DataFrame([(1, 0, 1, 0, "num_dot", 1, 10, False), (1, 1, 1, 2, "num_dot", 2, 10, False), (1, 2, 9, 2, "alpha", 3, 10, False)], columns=["doc_id", "ord", "page", "level", "family", "n", "size", "closed"])
    assert sorted(map(tuple, L.orphans(b)[["ord", "new_level"]].values.tolist())) == [(0, 2), (2, -1)]
    rows = pd.DataFrame([(1, 1, 0, 100, "a", False), (1, 1, 1, 110, "b", False), (1, 1, 2, 111, "7", True), (1, 1, 3, 300, "9", True)], columns=["doc_id", "page", "ord", "y", "text", "is_number"])
    assert L.row_matches(rows)[["entry_ord", "number"]].values.tolist() == [[1, 7]]
    r = pd.DataFrame([(1, 0, 5, "chapterone", 0, None, False), (1, 1, 8, "else", 0, None, False), (1, -1, 5, "chapterome", 1, 0, True), (1, -1, 8, "chaptertwo", 1, 1, True)], columns=["doc_id", "ord", "page", "key", "level", "toc_ord", "missing"])
    assert L.rescue(r)[["toc_ord", "ord", "sub_ord", "how"]].values.tolist() == [[0, 0, 0, "promoted"], [1, 1, -1, "made"]]


def test_tables(spark):
    a = '<table><tr><th colspan="2">H</th></tr><tr><td rowspan="2">x</td><td>1</td></tr><tr><td>2</td></tr></table>'
    b = '<table><tr><th colspan="2">Ｈ</th></tr><tr><td>y</td></tr></table>'
    rows = TB.parse(a)
    assert TB.total_columns(rows) == 2 and TB.row_widths(rows, 2) == (1, 1, 2) and [c["text"] for c in TB.last_cells(rows)] == ["x", "2"]
    assert TB.header_rows(rows, TB.parse(b)) == 1 and TB.columns_agree(rows, TB.parse(b)) and not TB.columns_agree(rows, [])
    assert TB.merge(a, b).endswith('<tr><td>2</td></tr><tr><td colspan="2">y</td></tr></table>')
    assert "<td>2y</td>" in TB.merge(a, "<table><tr><td></td><td>y</td></tr></table>", [0, 1])
    chain = spark.createDataFrame([(1, 0, a, False), (1, 1, b, True), (1, 2, b, True), (1, 3, a, False)], "doc_id long, ord int, html string, follows boolean")
    got = {r.ord: (r.fragments, r.html.count("<tr>")) for r in TB.merge_chains(chain).collect()}
    assert got == {0: (3, 5), 3: (1, 3)}


def test_long_chains_read_each_table_once(spark, monkeypatch):
    """a chain was read anew for each of its tables."""
    row = lambda k: f"<table><tr><th>a</th><th>b</th></tr><tr><td>{k}</td><td>x &amp; y</td></tr></table>"
    parse, read = TB.parse, []
    monkeypatch.setattr(TB, "parse", lambda s: read.append(len(s)) or parse(s))
    (got,) = TB._followed((1, k + 1, 8 * k, row(k)) for k in range(400))
    assert got[:2] == (1, 0) and got[3] == 400 and got[2].count("<th>a</th>") == 1 and got[2].count("x &amp; y") == 400
    assert sum(read) <= 2 * sum(len(row(k)) for k in range(400))
    monkeypatch.undo()
    pages = [(d, p, 8 * p, row(p) if p != 3 else "<table><tr><td>1</td></tr><tr><td>2</td></tr></table>") for d in range(3) for p in (1, 2, 3, 4, 6)]
    t = spark.createDataFrame(pages, "doc_id long, page int, ord int, html string")
    agree = TB.merge_candidates(t).where("agree").select("doc_id", F.col("next_ord").alias("ord"), F.lit(True).alias("follows"))
    two = sorted(map(tuple, TB.merge_chains(t.join(agree, ["doc_id", "ord"], "left")).collect()))
    assert two == sorted(map(tuple, TB.merge_pages(t).collect())) and [r[3] for r in two] == [2, 1, 1, 1] * 3


def test_plain_tables_are_cut_as_they_are_read():
    """regular rows take no parser; what they cover is counted without a grid."""
    r = random.Random(5)
    for _ in range(300):
        cell = lambda: f"<{(t := r.choice(['td', 'th']))}{r.choice(['', '', ' colspan=\"2\"', ' rowspan=\"3\"', ' colspan=\"0\"'])}>{r.choice(['', 'a', '&lt;b&gt; &amp;'])}</{t}>"
        source = "<table>" + "".join("<tr>" + "".join(cell() for _ in range(r.randint(0, 4))) + "</tr>" for _ in range(r.randint(0, 5))) + "</table>"
        reader = TB._Reader()
        reader.feed(source)
        rows = [x for x in reader.rows if x]
        assert TB.parse(source) == rows
        assert TB.covered(rows) == [(len(g), sum(s is not None for s in g)) for g in TB.grid(rows)]


def test_navigation_of_a_thousand_units(spark):
    """names have three digits, so the parts 100 and 1000 had one name and took each other's chapters."""
    units = spark.createDataFrame([(1, k, "t", "divider" if k % 100 == 0 else "chapter") for k in range(1101)], "doc_id long, unit int, title string, kind string")
    nav = R.navigation(R.unit_files(units)).first().nav
    assert [e.unit for e in nav] == [*range(0, 1101, 100)] and [len(e.children) for e in nav] == [99] * 11 + [0]


def test_rendering(spark):
    assert R.mathml("x_{1}^2 + \\alpha") == "<msup><msub><mi>x</mi><mrow><mn>1</mn></mrow></msub><mn>2</mn></msup><mo>+</mo><mo>α</mo>"
    assert R.mathml("\\frac{1}{2}") is None and R.mathml("x_") is None and R.with_mathml("a $\\bad{x}$").startswith('a <code class="latex">')
    book = R.epub("T & t", "de", "id", [("a.xhtml", "A", "<p>x</p>")])
    z = zipfile.ZipFile(io.BytesIO(book))
    assert z.namelist()[0] == "mimetype" and "T &amp; t" in z.read("OEBPS/content.opf").decode() and book == R.epub("T & t", "de", "id", [("a.xhtml", "A", "<p>x</p>")])
    notes = spark.createDataFrame([(3, "[12] See there.")], "n int, t string")
    assert notes.select(R.footnote_html(F.col("n"), F.col("t")).alias("x")).first().x.endswith('">3</a> See there.</p></aside>')


def test_books_are_packed_few_at_a_time(spark):
    """all books of a batch were held as objects, texts and packed, so memory followed the batch."""
    pages = lambda d: [{"file": "a.xhtml", "title": "A", "html": f"{d} " + "x" * 1_000_000}]
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "title": str(d), "language": None, "files": pages(d)} for d in range(20)])
    assert max(b.num_rows for b in G.pieces(batch)) <= 4 and sum(b.num_rows for b in G.pieces(batch)) == 20
    schema = pa.schema([("doc_id", pa.int64()), ("epub", pa.binary())])
    got = [x for b in R._packed(iter([batch]), schema) for x in b.to_pylist()]
    assert [x["doc_id"] for x in got] == list(range(20)) and got[3]["epub"] == R.epub("3", "zh", "doc-3", [("a.xhtml", "A", pages(3)[0]["html"])])
    books = spark.createDataFrame([(1, "t", "de", [("a.xhtml", "A", "h")])], "doc_id long, title string, language string, files array<struct<file:string,title:string,html:string>>")
    assert bytes(R.epubs(books).first().epub) == R.epub("t", "de", "doc-1", [("a.xhtml", "A", "h")])


def test_scorer(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    upper = lambda parts: (p.assign(reply=p.prompt.str.upper())[["id", "reply"]] for p in parts)
    assert sorted((r.id, r.reply) for r in TR.score(rows, upper, "id long, reply string").collect()) == [(1, "A"), (2, "B")]


def test_sources_and_sinks(spark, tmp_path):
    for book, engine, texts in (("b1", "e1", ["x", "y"]), ("b1", "e2", ["x"]), ("b2", "e2", ["z"])):
        folder = tmp_path / "in" / book / engine
        folder.mkdir(parents=True)
        (folder / "content_list.json").write_text(json.dumps([{"page_idx": k, "bbox": [0, 0, 1, 1], "text": t, "type": "text"} for k, t in enumerate(texts)]))
    blocks = S.read("content_list", spark, str(tmp_path / "in"))
    assert sorted((r.document, r.engine, r.ord, r.page, r.text) for r in blocks.collect()) == [("b1", "e1", 0, 1, "x"), ("b1", "e1", 1, 2, "y"), ("b1", "e2", 0, 1, "x"), ("b2", "e2", 0, 1, "z")]
    best = S.preferred_engine(blocks, "e2")
    assert sorted((r.document, r.engine) for r in best.select("document", "engine").distinct().collect()) == [("b1", "e2"), ("b2", "e2")]
    assert {r.document: r.engine for r in S.best_annotated(blocks, blocks.where("engine = 'e2'")).collect()} == {"b1": "e2", "b2": "e2"}
    assert {(r.document, r.blocks, r.pages) for r in S.metadata(best).collect()} == {("b1", 1, 1), ("b2", 1, 1)}
    S.structures(S.metadata(best), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="content_list"):
        S.read("none", spark, "")
    (tmp_path / "p.jsonl").write_text(json.dumps({"document": "d", "page_idx": 0, "blocks": [{"label": "image", "content": "", "bbox": [1, 2, 3, 4]}], "images": {"img_box_1_2_3_4.jpg": "u"}}))
    assert [(r.page, r.image) for r in S.read("json_lines", spark, str(tmp_path / "p.jsonl")).collect()] == [(1, "u")]
    assert [r.page_idx for r in S.rebase(spark.createDataFrame([(2, 5)], "chunk_no int, page_idx int")).collect()] == [405]


def test_stream_writes_each_block_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"document": "d", "ord": k % 3, "page": 1, "text": "t", "at": "2026-01-01T00:00:00Z"} for k in range(6)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        ingest.run(ingest.deduplicated(ingest.blocks_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_math_and_scripts():
    assert K.scripts_to_latex(r"H₂O\. x¹.² $a₁$") == r"H$_{2}$O. x$^{1.2}$ $a₁$"
    assert K.scripts_to_latex("x ₁") == "x$_{1}$"
    assert K.tidy_math(r"$ \mathrm{a b c}_{1 2} $ and $$ x $$") == r"$\mathrm{abc}_{12}$ and $$ x $$"
    assert K.last_coordinates("a [1] b [2, [3]] c]") == "[2, [3]]" and K.last_coordinates("none") is None


def test_lone_display_is_idempotent():
    alone = '<p>(1) <math alttext="\\frac{aaaaaaaaaaaa}{bbbbbbbbbbbb}"><mi>x</mi></math>.</p>'
    once = K.lone_display(alone)
    assert once == alone.replace("<math ", '<math display="block" ') == K.lone_display(once)
    for other in (alone.replace("(1)", "because"), alone.replace("\\frac", "x"), alone.replace(".</p>", " holds</p>")):
        assert K.lone_display(other) == other


def test_levels_said_by_a_model(spark):
    t = spark.createDataFrame([(1, 0, 2, True, False), (1, 1, 9, False, True), (1, 2, 9, False, False)], "doc_id int, ord int, level int, anchored boolean, plain boolean")
    said = spark.createDataFrame([(1, 0, 7), (1, 1, 1), (1, 2, 0)], "doc_id int, ord int, level int")
    assert {r.ord: r.new_level for r in K.applied_levels(t, said).collect()} == {0: 2, 1: 3, 2: 1}


def test_folds_take_no_frame_for_a_group(spark):
    """A frame was built for each group, however small."""
    rows = spark.createDataFrame([(d, p, o, 10 * o, str(o), o % 2 == 1) for d in range(50) for p in range(3) for o in range(40)], "doc_id long, page int, ord int, y int, text string, is_number boolean").repartition(3)
    got = L.by_document(rows, L.row_matches, "doc_id long, page int, entry_ord int, number int", "doc_id", "page")
    assert "PandasGroups" not in got._jdf.queryExecution().toString() and "InPandas" not in got._jdf.queryExecution().toString()
    want = L.row_matches(pd.DataFrame([(0, 0, o, 10 * o, str(o), o % 2 == 1) for o in range(40)], columns=["doc_id", "page", "ord", "y", "text", "is_number"]))
    one = sorted(map(tuple, want[["entry_ord", "number"]].values.tolist()))
    found = {}
    for r in got.collect():
        found.setdefault((r.doc_id, r.page), []).append((r.entry_ord, r.number))
    assert len(found) == 150 and all(sorted(v) == one for v in found.values()) and len(one) == 20


def test_groups_over_batches():
    """A group may begin and end in any batch."""
    rows = [(k // 7, k) for k in range(50)]
    for cuts in ([10, 14, 15, 49], [7, 21], [1], []):
        ends = [0, *cuts, 50]
        batches = [pa.RecordBatch.from_pydict({"g": [g for g, _ in rows[a:b]], "v": [v for _, v in rows[a:b]]}) for a, b in zip(ends, ends[1:])]
        assert [g["v"] for g in G.groups(iter(batches), ("g",))] == [[v for g, v in rows if g == k] for k in range(8)]


def test_chunks_follow_the_pages():
    """pages were gone through for each chunk."""

    class Counted(int):
        seen = 0

        def __lt__(self, other):
            Counted.seen += 1
            return int.__lt__(self, other)

        __le__ = __gt__ = __ge__ = __lt__

    n = 4000
    L.chunks.core({"doc_id": [1] * n, "page": [Counted(k) for k in range(1, n + 1)], "items": [k % 7 for k in range(n)]})
    assert Counted.seen < 40 * n
    r = random.Random(6)
    for _ in range(200):
        m = r.randint(1, 40)
        pages = sorted(r.sample(range(1, 90), m))
        items = [r.randint(0, 3) for _ in pages]
        count, at, end, want = dict(zip(pages, items)), pages[0], pages[-1], []
        while at < end:
            near = [p for p in pages if at + 7 <= p <= at + 17 and p > at]
            to = max(near, key=lambda p: (count[p], -p)) if near else next((p for p in pages if p > at + 12), end)
            to = end if end - to <= 2 else to
            want.append((at, to))
            at = to
        assert [x[2:] for x in L.chunks.core({"doc_id": [1] * m, "page": pages, "items": items})] == (want or [(at, at)])


def test_orphans_match_a_loop():
    """F4."""
    r = random.Random(12)
    for _ in range(300):
        rows = [(1, o, o // 4, r.choice([0, 0, 1, 2]), r.choice(["", "a", "b"]), r.randint(1, 4), r.choice([1, 9, 41]), r.random() < 0.2) for o in range(r.randint(1, 30))]
        want = []
        for f in ("a", "b"):
            own = [x for x in rows if x[4] == f and x[3] > 0]
            if own and min(x[5] for x in own) >= 2:
                head = min(own, key=lambda x: (x[2], x[1]))
                near = [x[1] for x in rows if x[4] == f and x[3] <= 0 and x[5] == 1 and 2 <= x[6] <= 40 and not x[7] and abs(x[2] - head[2]) <= 3]
                want += [(1, near[0], head[3])] if near else [(1, x[1], -1) for x in own] if min(x[5] for x in own) >= 3 else []
        got = L.orphans.core(dict(zip(("doc_id", "ord", "page", "level", "family", "n", "size", "closed"), map(list, zip(*rows)))))
        assert sorted(got) == sorted(want)


def test_edit_distance_of_equal_ends_reads_little():
    """keys that differ in one letter were compared cell by cell."""

    class Counted(str):
        seen = 0

        def __getitem__(self, k):
            Counted.seen += 1
            return str.__getitem__(self, k)

    key = "".join(random.Random(9).choices("abcdef", k=5000))
    assert L.distance(key, Counted(key[:2500] + "#" + key[2501:]), 2) == 1 and L.distance(key, key + "ab", 2) == 2 and L.distance(key, key + "abc", 2) == 3
    assert Counted.seen < 100


def test_edit_distance_in_a_band():
    def whole(a, b):
        line = [*range(len(b) + 1)]
        for row, x in enumerate(a, 1):
            corner, line[0] = line[0], row
            for k, y in enumerate(b, 1):
                corner, line[k] = line[k], corner if x == y else 1 + min(corner, line[k], line[k - 1])
        return line[-1]

    r = random.Random(8)
    for _ in range(3000):
        a, most = "".join(r.choices("ab", k=r.randrange(9))), r.randrange(4)
        b = "".join(r.choices("ab", k=r.randrange(9)))
        assert L.distance(a, b, most) == min(whole(a, b), most + 1)


def test_edit_distance_reads_no_more_than_the_band():
    class Counted(str):
        seen = 0

        def __getitem__(self, k):
            Counted.seen += 1
            return str.__getitem__(self, k)

        def __iter__(self):
            for x in str.__iter__(self):
                Counted.seen += 1
                yield x

    key = "".join(random.Random(9).choices("abcdef", k=1500))
    assert L.distance(key, Counted(key[:-1] + "#"), 2) == 1
    assert Counted.seen <= 5 * len(key)  # 1500 times as many in the whole table
