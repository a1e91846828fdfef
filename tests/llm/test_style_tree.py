import math
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliate.llm import style_tree as S

SCHEMA = "page_id long, url string, html string"


def page(i, host="news.example.org"):
    body = "".join(f"<p>Story {i} part {k} says {i * 7 + k} things. And more {i}-{k}.</p>" for k in range(1 + i % 4))
    nav = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "World", "Sport"))
    return (i, f"https://{host}/a/{i}", f'<html><head><title>T{i}</title><script>var a="<p>no</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- x --><article><h1>Head {i}</h1>{body}</article><div class="legal">All rights reserved. Terms &amp; conditions apply.</div></body></html>')


def make():
    rows = [page(i) for i in range(40)] + [page(100 + i, "small.example.org") for i in range(2)]
    rows += [(200, "https://news.example.org/x", None), (201, "https://news.example.org/y", ""), (202, None, "<p>alone"), (None, "::bad::[", "<b>x<p>y</b>z</p>"), (203, "https://NEWS.example.org:80/z", page(3)[2]), (204, "https://big.example.org/", "<div>" * 3000 + "w " * 200000 + "<a href='")]
    return rows + [rows[5]] + [(400 + k, "https://mirror.example.org/", page(7)[2]) for k in range(3)]


def brute(rows, threshold=S.THRESHOLD):
    """Merged trees as nested dicts, importance by recursion straight from the definition."""
    trees = {}
    for _, url, source in rows:
        h = S.host_of(url)
        trees.setdefault(h, []).append(S.parse(source))
    cutting = {}

    def visit(nodes, path, every):
        """(importance, greatest importance below); nodes: the same element on several of every page of the host."""
        m = len(nodes)
        if m < 2:
            return 1.0, 1.0
        base = math.log(m)
        if nodes[0].text is not None or nodes[0].tag == "img":
            by = defaultdict(list)
            for n in nodes:
                for f, c in Counter(S.features(n)).items():
                    by[f].append(c)
            ent = [-sum(c / sum(v) * math.log(c / sum(v)) for c in v) / math.log(every) for v in by.values()]
            comp = max(0.0, 1 - sum(ent) / len(ent))
            worst = comp
        else:
            styles = defaultdict(list)
            for n in nodes:
                styles[tuple((c.tag, c.look, c.below) for c in n.children)].append(n)
            own = -sum(len(v) / m * math.log(len(v) / m) for v in styles.values()) / base
            total, worst = 0.0, 0.0
            for sig, v in styles.items():
                kids = [k for k, c in enumerate(sig) if c[2]]
                if not kids:
                    continue
                got = [visit([n.children[k] for n in v], (*path, sig, k), every) for k in kids]
                total += len(v) / m * sum(c for c, _ in got) / len(got)
                worst = max([worst, *(w for _, w in got)])
            comp = (1 - S.GAMMA ** len(styles)) * own + S.GAMMA ** len(styles) * total
            worst = max(worst, comp)
        if worst < threshold:
            cutting.update({id(n): True for n in nodes})
        return comp, worst

    for h, roots in trees.items():
        roots = [r for r in roots if r.below]
        before = dict(cutting)
        if roots and visit(roots, (h,), len(roots))[1] < threshold:  # all pages are copies: nothing is template
            cutting.clear()
            cutting.update(before)
    out = []
    flat = {h: iter(r) for h, r in trees.items()}
    for i, url, source in rows:
        root = next(flat[S.host_of(url)])
        removed, parts, stack = 0, [], [root]
        while stack:
            n = stack.pop()
            if id(n) in cutting:
                removed += 1
            elif n.text is not None:
                parts.append(n.text)
            else:
                stack += reversed(n.children)
        out.append((i, None if source is None else "".join("".join(parts).split()), removed if source is not None else 0))
    return sorted(out, key=str)


def test_extraction_matches_recursive_definition(spark):
    pages = spark.createDataFrame(make(), SCHEMA).withColumns({"host": F.lit("h"), "node": F.lit(1), "noise": F.lit(2), "text": F.lit("t"), "removed": F.lit("r")})
    got = S.extract(pages).collect()
    assert sorted(((r.page_id, None if r.text is None else "".join(r.text.split()), r.removed) for r in got), key=str) == brute(make())
    text = {r.page_id: r.text for r in got}
    for i in range(40):
        assert "Home" not in text[i] and "rights" not in text[i] and f"Head {i}" in text[i] and f"Story {i} part 0" in text[i] and "var a" not in text[i]
    # two pages of a host show a template; copies of one page show none
    assert "Home" not in text[100] and "Story 100 part 0" in text[100] and all("Home" in text[k] for k in (400, 401, 402)) and text[202] == "alone" and text[200] is None and text[201] == "" and text[204].count("w") == 200000


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_exchanged_and_broadcast_noise_agree(spark, limit):
    rows = make() + [page(i, "other.example.net") for i in range(300, 330)]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = S.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(((r.page_id, None if r.text is None else "".join(r.text.split()), r.removed) for r in got), key=str) == brute(rows)


def test_hosts_as_column(spark):
    urls = [None, "", "http://A.b.C/x", "https://u:p@h.org:80/a@b", "//x.net?q", "mailto:x@y", "::bad::[", "http://[::1]:8/x", "http://a.b#c", "/no/host", "http://", "  http://pad.example/"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "url string").select(S.host(F.col("url")).alias("h")).collect()]
    assert got == [S.host_of(u) for u in urls]


HOSTILE = ["<a " * 200_000, "<a " * 100_000 + '">"', '(<a "> " ' * 100_000, "<!" * 300_000, '<a x="' * 100_000, "<a " + "b" * 400_000 + ">", "<li><ul>" + "<b>" * 100_000 + "<li></li>" * 100_000, "<td><table>" * 50_000 + "<td>" * 50_000, "<" * 500_000, "</b>" * 200_000]


@pytest.mark.parametrize("source", HOSTILE, ids=lambda s: s[:12])
def test_hostile_pages_take_linear_time(source):
    began = time.process_time()
    S.content(S.parse(source), "h", {5})
    assert time.process_time() - began < 12  # over half a megabyte; quadratic parsing would take minutes


def test_empty(spark):
    assert S.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parse_mends_tags():
    root = S.parse("<ul><li>a<li>b</ul><p>c<b>d<p>e</i></p><br>f<img src=x.png><table><tr><td>1<td>2<tr><td>3</table>")
    say = lambda n: n.text or f"<{n.tag}:{''.join(say(c) for c in n.children)}>"
    assert say(root) == "<#root:<ul:<li:a><li:b>><p:c<b:d>><p:e><br:>f<img:><table:<tr:<td:1><td:2>><tr:<td:3>>>>"
