"""Operator 7: toxicity after noisy-channel deobfuscation.

A lexicon of words typical of toxic documents is fitted on labelled rows, by language. A character language model is counted over
all documents. Tokens with leetspeak, in-word separators or repeated letters, runs of spaced single characters, and words split in pieces
become lattices whose best path under the language model (Viterbi) is the restored text. Documents are scored by the
lexicon's weights over plain and restored words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, once, slices, words

#: Labelled documents on which the lexicons are fitted, at most: those of the least hashed ids, languages taking turns.
SAMPLE_ROWS = 20_000
#: Share of a lexicon's words that may be there by accident, and the least ratio of a word's shares.
ALPHA, RATIO = 0.05, 20
#: The language model's characters; any other counts as a blank.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàâáäãåçèéêëìíîïñòóôöõøùúûüýÿßœæабвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґαβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ"
N = len(ALPHABET)
INDEX = {c: k for k, c in enumerate(ALPHABET)}
_CODES = np.zeros(0x600, dtype=np.int64)
for _c, _k in INDEX.items():
    _CODES[ord(_c)] = _k
#: What a symbol may stand for, with the log-probability of the channel.
LEET = {
    "0": {"o": -0.2}, "1": {"i": -0.7, "l": -0.9}, "2": {"z": -1.0}, "3": {"e": -0.2}, "4": {"a": -0.2}, "5": {"s": -0.2},
    "6": {"g": -0.7, "b": -1.2}, "7": {"t": -0.3}, "8": {"b": -0.4}, "9": {"g": -0.6}, "@": {"a": -0.2}, "$": {"s": -0.2},
    "!": {"i": -0.5}, "|": {"l": -0.7, "i": -0.9}, "+": {"t": -0.3}, "(": {"c": -0.6}, "€": {"e": -0.3},
    "*": {c: -2.0 for c in "aeiou"},
}
BREAK, DROP, ONCE, TWICE = -4.0, -0.4, -0.2, -1.0
#: A blank between spaced characters that ends a word.
SPLIT = -1.0
EDGE = ".,;:?!\"'`´“”„«»()[]{}<>…&%#*|~=/\\"
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+)+\S(?!\S)")
TWIN = re.compile(r"([^\W\d_])\1")
#: Letters of other scripts that look like Latin ones, read so in words that have Latin letters too.
ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнαοερκντυιχ", "aeopcyxijsdhkmtbhaoepkvtuix")
FOREIGN, MIXED = re.compile(r"[Ͱ-ԯ]"), re.compile(r"(?=\S*[a-zß-ÿ])\S*[Ͱ-ԯ]\S*")
UNSEEN = re.compile("[­​-‏⁠﻿]")
KEPT_TOKENS = 200_000


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(N**3, dtype=np.int64))
    threshold: float = math.inf
    #: By language ("" where it is null): lexicon and threshold. Other languages take those above, fitted on all.
    own: dict[str, tuple[dict[str, float], float]] = field(default_factory=dict)

    def prepare(self) -> Model:
        """Turn counts to log-probabilities: three characters of the corpus, mixed with five of the lexicon's words."""
        n = self.grams.reshape(N, N, N).astype(float)
        one = (n.sum((0, 1)) + 1) / (n.sum() + N)
        two = n.sum(0)
        two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        self.corpus = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
        self.by_lang = {k: Model(lexicon, self.grams, threshold)._follow(self.corpus) for k, (lexicon, threshold) in self.own.items()}
        return self._follow(self.corpus)

    def _follow(self, corpus: np.ndarray) -> Model:
        self.corpus = corpus
        self.starts = {w[:k] for w in self.lexicon for k in range(1, len(w))}
        self.after: dict[str, Counter] = {}
        for w in self.lexicon:
            w = f"    {w} "
            for k in range(4, len(w)):
                self.after.setdefault(w[k - 4 : k], Counter())[w[k]] += 1
        self.heads = {past[:3] for past in self.after}
        self.memo: dict[str, float] = {}
        self.steps: dict[str, float] = {}
        return self

    def of(self, lang: str | None) -> Model:
        return self.by_lang.get(lang or "", self)

    def step(self, past: str, c: str) -> float:
        """log P(c | the four characters before)."""
        key = past + c
        if (p := self.steps.get(key)) is None:
            p = float(self.corpus[INDEX.get(past[-2], 0), INDEX.get(past[-1], 0), INDEX.get(c, 0)])
            if (seen := self.after.get(past)) is not None:
                p = 0.6 * p + 0.4 * seen[c] / seen.total()
            if len(self.steps) > KEPT_TOKENS:
                self.steps.clear()
            p = self.steps[key] = math.log(max(p, 1e-9))
        return p

    def restore(self, token: str) -> str:
        """The likeliest text behind an obfuscated token or spaced run: Viterbi over its lattice.

        One blank joins the characters beside it or parts two words; a wider one parts them, or rarely joins. Of the characters
        before, a state has only those that still matter to the model, so that there are few states and time is linear in the token.
        """
        after, heads = self.after, self.heads
        best: dict[str, tuple[float, tuple | None]] = {"    ": (0.0, None)}
        k = 0
        while k < len(token):
            c, r = token[k], 1
            if c in LEET or c.isalpha() or c == " ":
                while k + r < len(token) and token[k + r] == c:
                    r += 1
            if c.isalpha():
                ways = [(c, 0.0)] if r == 1 else [(c, ONCE if r > 2 else TWICE), (c * 2, TWICE if r > 2 else 0.0)]
            elif c in LEET:
                ways = [(x * m, p * m + (ONCE if r > 1 and m == 1 else 0)) for x, p in LEET[c].items() for m in {1, min(r, 2)}] + [(" ", BREAK)]
                if c in "*|":
                    ways.append(("", DROP))
            elif c == " ":
                ways = [("", DROP), (" ", SPLIT)] if r == 1 else [(" ", 0.0), ("", BREAK)]
            else:
                ways = [("", DROP), (" ", BREAK)]
            k += r
            new: dict[str, tuple[float, tuple | None]] = {}
            for past, (score, text) in best.items():
                for x, p in ways:
                    s, h = score + p, past
                    for y in x:
                        if not (y == " " and h[-1] == " "):
                            s += self.step(h, y)
                            h = "    " if y == " " else h[1:] + y
                            if h not in after and y != " ":
                                h = "\0" + h[1:] if h[1:] in heads else "\0\0" + h[2:]
                    if h not in new or s > new[h][0]:
                        new[h] = (s, (text, x))
            best = new
        path = max(((s + (self.step(h, " ") if h[-1] != " " else 0.0), text) for h, (s, text) in best.items()), key=lambda x: x[0])[1]
        parts = []
        while path is not None:
            path, x = path
            parts.append(x)
        return "".join(reversed(parts))

    def value(self, text: str) -> float:
        return sum(self.lexicon.get(w, 0.0) for w in words(text))

    def token(self, token: str) -> float:
        """The score of one token without white space."""
        core = token.strip(EDGE)
        if core.isalpha() and not TWIN.search(core):
            return self.lexicon.get(core, 0.0)
        plain = self.value(token)
        core = token.rstrip(EDGE + "$").lstrip(".,;:?\"'`´“”„«»[]{}<>…&%#~=/\\*|") if any(x.isalpha() for x in token) else ""
        if not core or core.isalpha() and not TWIN.search(core):
            return max(plain, self.lexicon.get(core, 0.0))
        return max(plain, self.value(self.restore(core)))

    def score(self, text: str | None) -> float:
        if not text or not self.lexicon:
            return 0.0
        text = text.lower()
        if not text.isascii():
            text = UNSEEN.sub("", unicodedata.normalize("NFKC", text).lower())
            if FOREIGN.search(text):
                text = MIXED.sub(lambda m: m.group().translate(ALIKE), text)
        total, memo = 0.0, self.memo
        tokens = text.split()
        kinds = Counter(tokens)
        for t, n in kinds.items():
            v = memo.get(t)
            if v is None:
                if len(memo) > KEPT_TOKENS:
                    memo.clear()
                v = memo[t] = self.token(t)
            if v:
                total += n * v
        for m in SPACED.finditer(text):
            if len(set(m.group())) > 2:  # a blank and two characters
                total += self._gain(m.group().replace("\t", " "))
        return total + self._pieces(tokens, kinds)

    def _gain(self, text: str) -> float:
        """What restoring a text of several tokens adds to its score."""
        if (v := self.memo.get(text)) is None:
            if len(self.memo) > KEPT_TOKENS:
                self.memo.clear()
            v = self.memo[text] = max(0.0, self.value(self.restore(text)) - self.value(text))
        return v

    def _pieces(self, tokens: list[str], kinds: Counter) -> float:
        """The score of lexicon words that blanks split into pieces, where the language model prefers the word."""
        first = {t: x for t in kinds if (x := t.lstrip(EDGE)) in self.starts}
        total, past = 0.0, 0
        for i, t in enumerate(tokens) if first else ():
            if i < past or t not in first:
                continue
            pieces = [first[t]]
            for j in range(i + 1, len(tokens)):
                pieces.append(tokens[j])
                word = "".join(pieces)
                core = word.rstrip(EDGE)
                if core in self.lexicon and any(len(x) > 1 for x in tokens[i : j + 1]):
                    pieces[-1] = tokens[j].rstrip(EDGE)
                    if v := self._gain("  ".join(pieces)):
                        total, past = total + v, j + 1
                        break
                if word not in self.starts:
                    break
        return total


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, dtype=np.int64)
    for whole in batches:
        for batch in slices(whole, 0):
            texts = [t for t in batch.column(0).to_pylist() if t]
            x = np.frombuffer(("  " + "  ".join(texts).lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
            x = np.where(x < len(_CODES), _CODES[np.minimum(x, len(_CODES) - 1)], 0)
            total += np.bincount(x[:-2] * (N * N) + x[1:-1] * N + x[2:], minlength=N**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        for text, lang, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            for w in set(words(text)):
                count.setdefault((lang, w), [0, 0])[toxic > 0] += 1
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.string()), pa.array([w for _, w in count], pa.string()), pa.array([v[0] for v in count.values()], pa.int64()), pa.array([v[1] for v in count.values()], pa.int64())], names=["lang", "word", "clean", "toxic"])


def _neighbours(candidates: dict[str | None, set[str]]):
    """(language, word, hash of its neighbours) of candidates in toxic documents; null stands for all languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = ["", *words(text), ""]
                for key in (lang, None):
                    of = candidates.get(key, ())
                    seen |= {(key, x, xxhash.xxh3_64_intdigest(w[k - 1] + " " + w[k + 1]) - 2**63) for k, x in enumerate(w) if x in of}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in seen], pa.string()), pa.array([x for _, x, _ in seen], pa.string()), pa.array([h for _, _, h in seen], pa.int64())], names=["lang", "word", "beside"])

    return run


def _choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def chance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """P that of toxic + clean documents drawn from all at least that many are toxic ones (Fisher's exact test)."""
    k = toxic + clean
    return sum(math.exp(_choose(n_toxic, j) + _choose(n_clean, k - j) - _choose(n_toxic + n_clean, k)) for j in range(toxic, min(k, n_toxic) + 1))


def tests(totals: dict[int, int], n_toxic: int, n_clean: int) -> tuple[int, int]:
    """Tarone's correction: the least number of documents in which a word can be significant, and how many words are in as many.

    totals: how many words are in that many documents. Words too rare to reach the level aren't tests and don't count.
    """
    for k in range(1, n_toxic + 1):
        many = sum(m for total, m in totals.items() if total >= k)
        if many * chance(k, 0, n_toxic, n_clean) <= ALPHA:
            return k, many
    return n_toxic + 1, 0


def significant(chances: dict[str, float], many: int) -> set[str]:
    """The words that stand out of so many tests, at most ALPHA of them by accident (Benjamini and Hochberg)."""
    order = sorted(chances, key=chances.get)
    last = max((k for k, w in enumerate(order, 1) if chances[w] <= ALPHA * k / many), default=0)
    return set(order[:last])


def cut_point(clean: np.ndarray, toxic: np.ndarray) -> float:
    """Midway in the gap between scores that misjudges the fewest documents; the widest of several such gaps.

    Documents without a lexicon word score 0 and are missed by every threshold, so they don't move it.
    """
    at = np.unique(np.r_[0.0, clean, toxic])
    if len(at) < 2 or not (toxic > 0).any():
        return math.inf
    low, high = at[:-1], at[1:]
    wrong = len(clean) - np.searchsorted(np.sort(clean), low, side="right") + np.searchsorted(np.sort(toxic), low, side="right")
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax((high - low)[best])]
    return float(low[k] + high[k]) / 2


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, lang, toxic) of at most sample_rows labelled documents: languages take turns, so that small ones come whole."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = docs.select("doc_id", "lang").join(own, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("of"), F.max("toxic").alias("toxic"))
    turn = F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("doc_id"), "doc_id"))
    turns = told.select("doc_id", "toxic", turn.alias("turn")).where(F.col("turn") <= sample_rows)
    chosen = turns.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", "toxic")
    return cut(docs.join(F.broadcast(chosen), "doc_id").select("text", "lang", "toxic"), "labelled")  # at most sample_rows rows of 16 bytes


def _lexicons(sample: DataFrame, n: dict[str | None, tuple[int, int]]) -> dict[str | None, dict[str, float]]:
    """The lexicon of each language with toxic documents in the sample, and under None that of all languages together."""
    by_lang = cut(sample.mapInArrow(_sample_words, "lang string, word string, clean long, toxic long").groupBy("lang", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "words")
    every = by_lang.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).select(F.lit(None).cast("string").alias("lang"), "word", "clean", "toxic")
    counts = by_lang.unionByName(every)
    totals: dict[str | None, dict[int, int]] = {k: {} for k in n}
    for r in counts.groupBy("lang", (F.col("clean") + F.col("toxic")).alias("total")).count().collect():
        totals[r.lang][r.total] = r["count"]
    tested = {k: tests(totals[k], t, c) for k, (t, c) in n.items() if t}
    told = sample.sparkSession.createDataFrame([(k, *n[k], least) for k, (least, _) in tested.items()], "of string, n_toxic long, n_clean long, least long")
    ratio = F.log((F.col("toxic") + 0.5) / (F.col("n_toxic") + 1) / ((F.col("clean") + 0.5) / (F.col("n_clean") + 1)))
    found = counts.join(F.broadcast(told), F.col("lang").eqNullSafe(F.col("of"))).where("toxic + clean >= least").select("lang", "word", "clean", "toxic", ratio.alias("w")).where(F.col("w") >= math.log(RATIO)).collect()
    candidates: dict[str | None, set[str]] = {}
    for r in found:
        candidates.setdefault(r.lang, set()).add(r.word)
    kinds = sample.where("toxic > 0").mapInArrow(_neighbours(candidates), "lang string, word string, beside long").distinct().groupBy("lang", "word").count()
    kinds = {(r.lang, r.word): r["count"] for r in kinds.collect()}
    chances: dict[str | None, dict[str, float]] = {k: {} for k in tested}
    for r in found:
        if (many := kinds[r.lang, r.word]) >= 0.5 * r.toxic:
            chances[r.lang][r.word] = chance(min(many, r.toxic), r.clean, *n[r.lang])
    chosen = {k: significant(of, tested[k][1]) for k, of in chances.items()}
    out = {k: {r.word: r.w for r in sorted(found, key=lambda r: r.word) if r.lang == k and r.word in chosen[k]} for k in tested}
    known = by_lang.where(F.col("word").isin(list(out[None]))).collect() if out[None] else []
    share = lambda r: (r.toxic + 0.5) / (n[r.lang][0] + 1) / ((r.clean + 0.5) / (n[r.lang][1] + 1))
    denied = {(r.lang, r.word) for r in known if r.clean and share(r) < RATIO}
    return {k: {**{w: v for w, v in out[None].items() if (k, w) not in denied}, **lexicon} for k, lexicon in out.items()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicons and thresholds by language from a bounded sample of labelled rows; the language model from every document.

    A word enters a language's lexicon if its share of that language's toxic documents is at least 20 times that of the
    others, if that is significant by Fisher's test (5 % of false words, over all words that could be), and if its neighbours
    there are of at least half as many kinds as those documents (words of one text copied often are not; the test, too,
    counts a document a kind); its weight is the log of the ratio. Words significant over all languages together
    belong to every lexicon but of a language whose clean documents use them. The threshold is that which misjudges the
    fewest sample documents of the language. A language without toxic labels takes lexicon and threshold of all languages
    together. Labels that are null or of no document don't count; of several labels of a document the largest holds.
    Without toxic labels no document is toxic.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    sample = _sample(docs, labels, sample_rows)
    model = Model()
    n: dict[str | None, tuple[int, int]] = {r.lang: (r.toxic, r.clean) for r in sample.groupBy("lang").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).collect()}
    n[None] = (sum(t for t, _ in n.values()), sum(c for _, c in n.values()))
    if n[None][0]:
        lexicons = _lexicons(sample, n)
        model.lexicon = lexicons.pop(None)
        model.own = {k: (lexicon, math.inf) for k, lexicon in lexicons.items()}
        grams = docs.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        model.grams[grams["gram"].to_numpy()] = grams["n"].to_numpy()
        scored = sample.mapInArrow(_scorer(sample, model, ["lang", "toxic"], True), "lang string, toxic int, score double, pooled double").toPandas()
        bad = scored.toxic > 0
        model.threshold = cut_point(scored.pooled[~bad].to_numpy(), scored.pooled[bad].to_numpy())
        for k, (lexicon, _) in model.own.items():
            of = scored.lang == k
            model.own[k] = lexicon, cut_point(scored.score[of & ~bad].to_numpy(), scored.score[of & bad].to_numpy())
            if model.own[k][1] == math.inf:  # none of its toxic documents has a lexicon word
                model.own[k] = lexicon, model.threshold
    return model


def _scorer(df: DataFrame, model: Model, keep: list[str] | None = None, pooled: bool = False):
    """A function for mapInArrow: keep + score of toxic rows (of all, with the score over all languages, if pooled), or whole rows that aren't toxic."""
    told = df.sparkSession.sparkContext.broadcast((model.lexicon, model.grams, model.threshold, model.own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = once(told, lambda fitted: Model(*fitted).prepare())
        for batch in (x for whole in batches for x in slices(whole, whole.schema.get_field_index("text"))):
            texts, langs = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("text", "lang"))
            scores = np.array([m.of(k).score(t) for t, k in zip(texts, langs)], dtype=float)
            over = pa.array(scores > np.array([m.of(k).threshold for k in langs], dtype=float), pa.bool_())
            if keep is None:
                yield batch.filter(pa.compute.invert(over))
                continue
            columns = [*(batch.column(batch.schema.get_field_index(k)) for k in keep), pa.array(scores)]
            if pooled:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m.score(t) for t in texts], pa.float64())], names=[*keep, "score", "pooled"])
            else:
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score"]).filter(over)

    return run


def toxic_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, toxic = true) of every document whose score exceeds the threshold of its language.

    A null or empty text scores 0; a null doc_id is carried along; repeated rows are scored each. Very long texts and tokens
    are read whole. Without rows or without toxic labels there is no row; further columns don't matter.
    """
    model = fit(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_scorer(docs, model, ["doc_id"]), "doc_id long, score double").withColumn("toxic", F.lit(True))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that score as in toxic_documents() above the threshold of their language.

    All columns stay as they are, whatever their names. Null and empty texts score 0 and stay, rows of null ids and repeated
    rows are judged like others, a score of just the threshold stays. Without toxic labels all rows stay; an empty table stays empty.
    """
    return docs.mapInArrow(_scorer(docs, fit(docs, labels, sample_rows)), docs.schema)
