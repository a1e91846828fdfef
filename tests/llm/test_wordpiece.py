import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliate.llm import wordpiece as W


def naive(word: bytes, first: set, inner: set) -> int:
    n = at = 0
    while at < len(word):
        own = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in own), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def split(pieces):
    return {p[1:] for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}


@given(st.lists(st.tuples(st.booleans(), st.text("abc", min_size=1, max_size=5)), max_size=25), st.text("abc", min_size=1, max_size=14))
@settings(max_examples=500, deadline=None)
def test_any_vocabulary(pieces, word):
    pieces = [(b" " if first else b"") + p.encode() for first, p in pieces]
    assert W.Automaton(pieces).count(word.encode()) == naive(word.encode(), *split(pieces))


def test_query(spark):
    pieces = W.load()
    first, inner = split(pieces)
    r = random.Random(1)
    texts = ["The quick brown fox", "naïve Übermut 漢字 don't", "<|endoftext|>", "a" * 50000, "", None, " \t\n ", "x\ty z"]
    texts += ["".join(r.choice("abcdefghijklmnop    éü12.,") for _ in range(400)) for _ in range(50)]
    docs = spark.createDataFrame([(i if i != 1 else None, t, 5) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, tokens long")
    got = sorted((str(r.doc_id), r.words, r.tokens) for r in W.token_counts(docs).collect())
    want = sorted((str(i if i != 1 else None), len((t or "").split()), sum(naive(w.encode(), first, inner) if len(w) < 1000 else W.Automaton(pieces).count(w.encode()) for w in (t or "").split())) for i, t in enumerate(texts + texts[:2]))
    assert got == want
    assert W.token_counts(docs.limit(0)).count() == 0


def greedy(word: bytes, pieces: set) -> int:
    n, rest = 0, b" " + word
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), None)
        if k is None:
            return 1
        n, rest = n + 1, rest[k:]
    return n


@given(st.lists(st.tuples(st.booleans(), st.text("abc", min_size=1, max_size=5)), max_size=25), st.text("abc", min_size=1, max_size=14))
@settings(max_examples=500, deadline=None)
def test_any_vocabulary_with_the_space_alone(pieces, word):
    pieces = [(b" " if first else b"") + p.encode() for first, p in pieces] + [b" "]
    assert W.Automaton(pieces).count(word.encode()) == greedy(word.encode(), set(pieces))


def test_every_byte_string_is_split():
    pieces = W.load()
    known, automaton = set(pieces), W.Automaton(pieces)
    for word in ["中文文本", "한국어", "ภาษาไทย", "かな", "हिन्दी", "漢字", "word", "中文" * 500]:
        assert automaton.count(word.encode()) == greedy(word.encode(), known) > (word != "word"), word
    for c in set(range(256)) - {0x20}:
        assert automaton.count(bytes([c, 0xE4])) == greedy(bytes([c, 0xE4]), known)
    assert automaton.count("中文文本".encode() * 100) > 100
