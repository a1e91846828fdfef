import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    "write to Ann.Bee@mail8.example.com or ann.bee@mail8.example.com, not bob@mail8.example.com",
    "call +1 (988) 555-2485 or +1 988-555-2485 or (456) 555-2186.",
    "from 42.144.35.254 and 192.168.3.4, not 1.2.3.4.5 or 300.1.1.1",
    "card 4337 1665 9846 4399 or 4337166598464399; not 4337166598464398",
    "SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00",
    "Mary Smith met Mr. Smith and MARY SMITH; Dr. Jones, Frau Müller, Анна Петрова, г-н Иванов, James",
    "card 43 37 16 65 98 46 43 99 and ٠١٢-٣٤٥-٦٧٨٩ and 2001:db8::ff00:42:8329 at 12:30:45", "Hello, my name is Priya Raman. Je m'appelle Quentin",
    "nothing personal here, 404189 only", "", None,
]


def make(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[1]), (99, "x " * 100000 + TEXTS[0])]
    rows += [(1000 + k, f"mail a{k % 7}@b{k % 3}.org from 10.0.{k % 5}.{k % 250} call (212) 555-{k:04d}, Mr {chr(65 + k % 26)}{chr(97 + k // 26)}son") for k in range(300)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


def test_surrogates(spark):
    docs = make(spark).withColumns({"kind": F.lit("k"), "canon": F.lit(1), "new": F.lit(None).cast("string"), "t": F.lit(2)})
    out = pii.replace(docs, "key")
    assert out.columns == docs.columns
    before = {}
    for r in docs.collect():
        before.setdefault(r.doc_id, r.text)
    after = {r.doc_id: r.text for r in out.collect()}
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in docs.collect())
    mapping, owner = {}, {}
    for i, old in before.items():
        a, b = pii.entities(old), pii.entities(after[i])
        assert len(a) == len(b) and all(x[2] == y[2] or x[2] == "given:n" and y[2].startswith("given") for x, y in zip(a, b)), (old[-300:], after[i][-300:])
        gaps = lambda t, e: [t[x:y] for x, y in zip([0, *(s[1] for s in e)], [*(s[0] for s in e), len(t or "")])] if t else t
        assert gaps(old, a) == gaps(after[i], b)
        for x, y in zip(a, b):
            assert mapping.setdefault(x[2:], y[3]) == y[3]  # coreference
            assert owner.setdefault((x[2].split(":")[0], y[3]), x[2:]) == x[2:]  # distinctness
            if not x[2].startswith("given"):
                assert y[3] not in {k[1] for k in mapping if k[0] == x[2]} or (x[2], y[3]) not in mapping
            old_s, new_s = old[x[0] : x[1]], after[i][y[0] : y[1]]
            if x[2] in ("card", "phone", "ssn", "iban"):
                assert re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", old_s)) == re.sub(r"\d", "0", re.sub(r"[A-Z]", "A", new_s))
            assert old_s.isupper() == new_s.isupper() or x[2] in ("email",)
            if x[2].startswith("given") or x[2] == "surname":
                assert pii.script(old_s) == pii.script(new_s)
    assert after[8] == TEXTS[8] and after[9] == "" and after[10] is None
    assert not any(x in after[6] + after[7] for x in ("43 37", "٠١٢", "2001:db8::ff00", "Priya", "Raman", "Quentin")) and "12:30:45" in after[6]
    assert "4337166598464398" in after[3] and "300.1.1.1" in after[2]
    assert after[2].split()[3].startswith("192.168.")
    assert {r.text for r in pii.replace(docs, "key").where("doc_id = 5").collect()} == {after[5]} != {r.text for r in pii.replace(docs, "other").where("doc_id = 5").collect()}


def test_collisions_are_drawn_again(spark):
    # ten one-digit local parts of one domain: the draws must collide, and end distinct
    found = spark.createDataFrame([("m", "email", f"{k}@x.org") for k in range(10)] + [("m", "surname", f"{a}{b}") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], "text_md5 string, kind string, canon string")
    got = pii.assign(found, "key").collect()
    assert len(got) == 686 and len({(r.kind, r.new) for r in got}) == 686
    assert not {(r.kind, r.new) for r in got} & {(r.kind, r.canon) for r in got}


def test_empty(spark):
    assert pii.replace(make(spark).limit(0), "key").count() == 0


def brute(rows, key):
    """Tokens scanned by other means, and surrogates assigned one entity after the other, round by round, in memory."""
    found = {x[2:] for _, t in rows for x in pii.entities(t)}
    space = lambda k: "given" if k.startswith("given") else k
    taken = {(space(k), c) for k, c in found if space(k) != "given"}
    done, held, attempt = {}, set(), 0
    left = sorted(found, key=lambda x: (x[1], x[0]))
    while left:
        drawn = [(x, (space(x[0]), pii.surrogate(*x, attempt, key))) for x in left]
        now = {}
        for x, new in drawn:
            now.setdefault(new, x)
        for new, x in now.items():
            if new not in taken and new not in held:
                done[x] = new[1]
        held |= {(space(x[0]), n) for x, n in done.items()}
        left = [x for x in left if x not in done]
        attempt += 1
    out = []
    for i, t in rows:
        for begin, end, kind, canon in reversed(pii.entities(t)):
            t = t[:begin] + pii.render(t[begin:end], kind, done[kind, canon]) + t[end:]
        out.append((i, t))
    return out


def test_replace_matches_brute_force(spark):
    docs = make(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.text) for r in pii.replace(docs, "key").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, "key"), key=str)


def plain_scan(text):
    """Mentions that a reader without regular expressions finds: addresses, groups of digits, listed names."""
    out = set()
    for token in text.split():
        core = token.strip(".,;:!?")
        local, _, domain = core.partition("@")
        if local.isalnum() and domain.isascii() and domain.count(".") == 1 and all(x.isalpha() and len(x) > 1 for x in domain.split(".")):
            out.add(core.lower())
        parts = core.split(".")
        if len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) < 4 and int(x) < 256 for x in parts):
            out.add(".".join(str(int(x)) for x in parts))
        if core in {n for names in pii.GIVEN.values() for n in names}:
            out.add(core.casefold())
    return out


def test_detection_finds_what_a_plain_scan_finds():
    import random

    r = random.Random(4)
    names = sorted({n for v in pii.GIVEN.values() for n in v})
    for _ in range(400):
        made = [r.choice([lambda: f"u{r.randint(1, 99)}@site.org", lambda: ".".join(str(r.randint(0, 300)) for _ in range(4)), lambda: r.choice(names), lambda: r.choice(["word", "and", "3.14", "12:30"])])() for _ in range(8)]
        text = " ".join(x + r.choice(["", ",", "."]) for x in made)
        assert plain_scan(text) <= {c for *_, c in pii.entities(text)}, text


SOME = st.sampled_from([*"0123456789٣", "+", "(", ")", "-", " ", ".", ":", "::", "@", "DE89", "2001:db8", "a.b@c.org", "Mr ", "г-н ", "Анна", "Priya ", "my name is ", "Xu", "é", "x", "4337 1665 9846 4399", "(988) 555-2485"])


@settings(max_examples=3000, deadline=None)
@given(st.lists(SOME, max_size=24).map("".join))
def test_texts_turned_away_have_no_entity(text):
    if not pii.maybe(text):
        assert not pii.PATTERN.search(text) or not [x for x in _unfiltered(text)]


def _unfiltered(text):
    was, pii.maybe = pii.maybe, lambda _: True
    try:
        return pii.entities(text)
    finally:
        pii.maybe = was


def test_small_formats_never_run_out(spark):
    greek = [("m", "surname", "Α" + "".join(chr(0x3B1 + (k // 20**j) % 16) for j in range(4))) for k in range(10_000)]
    greek += [("m", "given:f", f"Α{chr(0x3B1 + k % 16)}{chr(0x3B1 + k // 16 % 16)}ω") for k in range(250)] + [("m", "ip", f"10.0.0.{k}") for k in range(256)]
    found = spark.createDataFrame(greek, "text_md5 string, kind string, canon string").distinct()
    got = pii.assign(found, "key").collect()
    assert len(got) == found.count() == len({(r.kind[:5], r.new) for r in got})


def test_wide_surrogates_keep_their_kind():
    for text in TEXTS[:8]:
        for begin, end, kind, canon in pii.entities(text):
            for attempt in (0, 3, 5, 9, 30):
                new = pii.render(text[begin:end], kind, pii.surrogate(kind, canon, attempt, "k"))
                assert new and new != text[begin:end]
                assert len({pii.surrogate(kind, canon, attempt + j, "k") for j in range(3)}) > 1


def test_key(spark):
    import pytest

    with pytest.raises(ValueError):
        pii.replace(make(spark), "")
    assert pii.key_of(spark) != pii.key_of(spark)
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.key_of(spark) == "mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_any_column_names(spark):
    names = ("md5", "_md5", "__md5", "found", "known", "__known", "space", "attempt")
    docs = make(spark).withColumns({c: F.lit(f"mine {c}") for c in names})
    out = pii.replace(docs, "key")
    assert out.columns == docs.columns and [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(f"mine {c}" for c in names)]
