"""Operator 4: masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every token is predicted from the tokens on both sides of it; a document's score is the sum of the logarithms of these
conditional probabilities. Words are counted over all documents. The network predicts the most frequent words themselves and
of the others the shape; a word's share in its shape's count, for which tokens are joined to the counts, completes the probability
of every word of the corpus.

Documents are encoded once, and gathered by hash in units of about UNIT tokens. Each round masks its share of every unit's
positions, so that all rounds mask each position once; a unit descends on their loss from the network of the last round, and the
units' networks are averaged, weighted by positions, in whole numbers: the result doesn't depend on partitions or their order.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, free, mix64, once, slices

#: Output classes and tokens of a class: a token's probability is that of its class times that within the class.
CLASSES, WIDTH = 64, 64
VOCABULARY = CLASSES * WIDTH
#: Tokens that stand for words outside the vocabulary, by length and last letters.
SHAPES = 512
#: Tokens on each side of the one that is predicted, and the sizes of the network's layers.
SIDE, EMBED, HIDDEN = 2, 32, 32
#: Rounds of training; each masks other positions, all rounds together every one.
ROUNDS = 4
#: Tokens of a unit of training, on average.
UNIT = 2_000_000
RATE, BATCH, CLIP = 0.1, 4096, 1.0
#: Positions that are scored at once, and the size up to which logits need no shift before exp().
BLOCK, HARMLESS = 16 * BATCH, 60.0
#: Up to so many rows of a token are summed for all tokens at once.
FEW = 4
EDGE = VOCABULARY  # the token outside of a text
KEPT_WORDS, COUNTED_WORDS = 300_000, 400_000
PIECES = 64
#: Weights are averaged as whole multiples of 2^-GRAIN; a unit counts by thousands of positions.
GRAIN = 20
#: Bits of a coded word that hold its token; the others hold the hash of a word outside the vocabulary.
SPLIT = 12

NAMES = ("embed", "place", "w", "b", "c", "cb", "o", "ob")


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of characters other than white space."""
    return text.lower().split() if text else []


def shape(word: str) -> int:
    """By length and last letters; 13 and more letters are one length."""
    return xxhash.xxh3_64_intdigest(f"{min(len(word), 13)} {word[-2:]}") % SHAPES


def tail_hash(word: str) -> int:
    """52 bits: what shiftrightunsigned(xxhash64(word), 12) is in columns."""
    return xxhash.xxh64_intdigest(word, 42) >> SPLIT


class Coder:
    """Words to token numbers, the most frequent words first, then the shapes; above SPLIT bits the hashes of words that have only a shape."""

    def __init__(self, vocabulary: list[str]):
        self.own = {w: k for k, w in enumerate(vocabulary)}
        self.shapes: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.place = defaultdict(count(len(self.own)).__next__, self.own)  # of a word in codes
        self.codes = np.arange(len(self.own), dtype=np.uint64)
        self.shapes.clear()

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) > KEPT_WORDS:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if new := list(islice(reversed(self.place), len(self.place) - len(self.codes)))[::-1]:
            forms = [f"{len(w)}{w[-2:]}" for w in new]
            for form, w in dict(zip(forms, new)).items():
                if form not in self.shapes:
                    self.shapes[form] = VOCABULARY - SHAPES + shape(w)
            code = np.fromiter(map(xxhash.xxh64_intdigest, new, repeat(42)), np.uint64, len(new)) >> np.uint64(SPLIT) << np.uint64(SPLIT)
            self.codes = np.r_[self.codes, code | np.fromiter(map(self.shapes.__getitem__, forms), np.uint64, len(new))]
        return self.codes[at]


def fresh() -> dict[str, np.ndarray]:
    r = np.random.default_rng(7)
    return {
        "embed": r.normal(0, 0.1, (VOCABULARY + 1, EMBED)), "place": np.ones((2 * SIDE, EMBED)), "w": r.normal(0, EMBED**-0.5, (EMBED, HIDDEN)), "b": np.zeros(HIDDEN),
        "c": r.normal(0, 0.1, (HIDDEN, CLASSES)), "cb": np.zeros(CLASSES), "o": r.normal(0, 0.1, (CLASSES, HIDDEN, WIDTH)), "ob": np.zeros((CLASSES, WIDTH)),
    }


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """A network whose predictions are the tokens' frequencies."""
    net = fresh()
    share = np.log((counts + 0.5) / (counts.sum() + 0.5 * VOCABULARY)).reshape(CLASSES, WIDTH)
    net["cb"] = np.log(np.exp(share).sum(axis=1))
    net["ob"] = share - net["cb"][:, None]
    return {k: v.astype(np.float32) for k, v in net.items()}


def contexts(ids: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each position `at` of texts put one after the other, the tokens on both sides."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(ids) + SIDE * (len(lengths) + 1), EDGE, dtype=ids.dtype)
    place = np.arange(len(ids)) + SIDE * (text + 1)
    padded[place] = ids
    return padded[place[at][:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])]


def _places(net: dict[str, np.ndarray]) -> np.ndarray:
    """What each token adds to the hidden layer's input from each place around the one that is predicted."""
    return net["embed"] * net["place"][:, None]


def _gathered(tables: np.ndarray, around: np.ndarray) -> np.ndarray:
    """The sum over the places of the tokens' rows."""
    x = tables[0].take(around[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        x += tables[k].take(around[:, k], axis=0)
    return x


def _with_one(h: np.ndarray) -> np.ndarray:
    """h and a column of ones, which stands for the bias."""
    out = np.ones((len(h), HIDDEN + 1), dtype=h.dtype)
    np.tanh(h, out=out[:, :HIDDEN])
    return out


def _outputs(net: dict[str, np.ndarray]) -> np.ndarray:
    """For each class the weights of all classes' logits, then those of the logits within it; the last row has the biases."""
    out = np.empty((CLASSES, HIDDEN + 1, CLASSES + WIDTH), dtype=net["o"].dtype)
    out[:, :HIDDEN, :CLASSES], out[:, HIDDEN, :CLASSES] = net["c"], net["cb"]
    out[:, :HIDDEN, CLASSES:], out[:, HIDDEN, CLASSES:] = net["o"], net["ob"]
    return out


def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of rows by class, and (class, begin, end) of those that occur."""
    order = np.argsort(of.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES))
    return order, [(c, int(e - n), int(e)) for c, (e, n) in enumerate(zip(ends, np.diff(ends, prepend=0))) if n]


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """Turns rows of logits into exponentials in place, less the rows' greatest where those could overflow or vanish; the sums, and what was taken off."""
    top = 0.0
    if not (-HARMLESS < x.min() and x.max() < HARMLESS):
        top = x.max(axis=1)
        x -= top[:, None]
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], dtype=x.dtype), top


def _sums(rows: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
    """The sums of the rows of each number below many."""
    order = np.argsort(of, kind="stable")
    of = of[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[first, len(of)])
    found = rows.take(order[first], axis=0)
    for k in range(1, FEW):
        more = np.flatnonzero(n > k)
        found[more] += rows.take(order[first[more] + k], axis=0)
    if len(more := np.flatnonzero(n > FEW)):
        rest = rows.take(order[np.repeat(n > FEW, n)], axis=0)
        pairs = rest.view(np.result_type(rest, np.complex64))  # two columns at once
        found[more] = np.add.reduceat(pairs, np.r_[0, np.cumsum(n[more])[:-1]], axis=0).view(rest.dtype)
    out = np.zeros((many, rows.shape[1]), dtype=rows.dtype)
    out[of[first]] = found
    return out


def log_probabilities(net: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | the tokens around it)."""
    out = np.empty(len(target), dtype=np.float64)
    tables, weights = _places(net) @ net["w"], _outputs(net)
    for k in range(0, len(target), BLOCK):
        t = target[k : k + BLOCK].astype(np.int64)
        order, parts = _by_class(t // WIDTH)
        t, own = t[order] % WIDTH, np.empty(len(t))
        near = around[k : k + BLOCK][order]
        for c, begin, end in parts:
            for a in range(begin, end, BATCH):
                b = min(a + BATCH, end)
                x = _with_one(_gathered(tables, near[a:b]) + net["b"]) @ weights[c]
                top = x[:, c] + x[np.arange(b - a), CLASSES + t[a:b]]
                total, less = _exponentials(x.reshape(-1, WIDTH))
                own[a:b] = top - (np.log(total) + less).reshape(-1, 2).sum(axis=1)
        out[k + order] = own
    return out


def gradients(net: dict[str, np.ndarray], around: np.ndarray, t: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss of a batch and its gradients."""
    n, t = len(t), t.astype(np.int64)
    order, parts = _by_class(t // WIDTH)
    around, t = around[order], t[order]
    x = _gathered(_places(net), around)
    h = _with_one(x @ net["w"] + net["b"])
    weights = _outputs(net)
    p = np.empty((n, CLASSES + WIDTH), dtype=h.dtype)
    for c, a, b in parts:
        np.matmul(h[a:b], weights[c], out=p[a:b])
    rows, halves = np.arange(n), p.reshape(-1, WIDTH)
    at = np.stack([t // WIDTH, t % WIDTH], axis=1).ravel()
    own = halves[np.arange(2 * n), at]
    total, less = _exponentials(halves)
    loss = float((np.log(total) + less - own).sum())
    halves *= (1 / total)[:, None]
    p[rows, t // WIDTH] -= 1
    p[rows, CLASSES + t % WIDTH] -= 1
    outer, dh = np.zeros_like(weights), np.empty((n, HIDDEN), dtype=h.dtype)
    for c, a, b in parts:
        np.matmul(h[a:b].T, p[a:b], out=outer[c])
        np.matmul(p[a:b], weights[c, :HIDDEN].T, out=dh[a:b])
    first = outer[:, :, :CLASSES].sum(axis=0)
    g = {"c": first[:HIDDEN], "cb": first[HIDDEN], "o": outer[:, :HIDDEN, CLASSES:], "ob": outer[:, HIDDEN, CLASSES:]}
    h = h[:, :HIDDEN]
    dh *= 1 - h * h
    g["w"], g["b"] = x.T @ dh, dh.sum(axis=0)
    dx = dh @ net["w"].T
    g["place"] = np.stack([np.einsum("ij,ij->j", dx, net["embed"].take(around[:, k], axis=0)) for k in range(2 * SIDE)])
    each = (dx * net["place"][:, None]).reshape(-1, EMBED)
    g["embed"] = _sums(each, around.T.astype(np.uint16).ravel(), VOCABULARY + 1)
    return loss / n, {k: np.divide(v, n, order="C") for k, v in g.items()}


class Trainer:
    """Adagrad on batches of masked positions."""

    def __init__(self, net: dict[str, np.ndarray]):
        self.net = {k: v.copy() for k, v in net.items()}
        self.seen = {k: np.full_like(v, 1e-4) for k, v in net.items()}

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        for k in range(0, len(target), BATCH):
            _, g = gradients(self.net, around[k : k + BATCH], target[k : k + BATCH])
            for name, v in g.items():
                norm = math.sqrt(float(np.vdot(v, v)))
                if norm > CLIP:
                    v *= v.dtype.type(CLIP / norm)
                seen = self.seen[name]
                seen += v * v
                v *= v.dtype.type(RATE)
                v /= np.sqrt(seen)
                self.net[name] -= v


def flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in NAMES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, like in fresh().items():
        out[k] = x[at : at + like.size].reshape(like.shape).astype(np.float32)
        at += like.size
    return out


@dataclass
class Fitted:
    """vocabulary: words by falling frequency, ties in order of the words; counts: of all tokens; words(word, n): of all words."""

    vocabulary: list[str]
    counts: np.ndarray
    words: DataFrame
    net: np.ndarray | None = None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times: Counter[str] = Counter()

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            times.update(tokens(text))
            if len(times) > COUNTED_WORDS:
                yield told()
                times.clear()
    yield told()


def _shape_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([shape(w) for w in batch.column(0).to_pylist()], pa.int32()), batch.column(1)], names=["shape", "n"])


def counted(docs: DataFrame) -> Fitted:
    """Words and tokens counted over all documents.

    A histogram of the logarithms of counts (some thousand cells) tells above which count the most frequent words lie, so that no
    more than those and the last cell's go through a sort.
    """
    text = docs.select(F.col("text").cast("string").alias("text"))
    words = cut(text.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    most = VOCABULARY - SHAPES
    cell = F.floor(F.log2("n") * 64)
    upto, least = 0, 0
    for r in sorted(words.groupBy(cell.alias("cell")).count().collect(), reverse=True):
        upto, least = upto + r["count"], r.cell
        if upto >= most:
            break
    top = words.where(cell >= least).repartition(16, "word").orderBy(F.desc("n"), "word").limit(most).collect()
    counts = np.zeros(VOCABULARY)
    for r in words.mapInArrow(_shape_words, "shape int, n long").groupBy("shape").agg(F.sum("n").alias("n")).collect():
        counts[VOCABULARY - SHAPES + r.shape] = r.n
    for k, r in enumerate(top):
        counts[k] = r.n
        counts[VOCABULARY - SHAPES + shape(r.word)] -= r.n
    return Fitted([r.word for r in top], counts, words)


def _encode(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once(told, Coder)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).to_pylist()
                every, ends = [], [0]
                for t in texts:
                    every += tokens(t)
                    ends.append(len(every))
                lengths = np.diff(ends)
                code = coder(every)
                ids = (code & np.uint64(2**SPLIT - 1)).astype(np.uint16)
                rare = ids >= VOCABULARY - SHAPES
                # one number for a text of the slice and a word
                both = np.sort((np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)[rare] << np.uint64(64 - SPLIT)) | (code[rare] >> np.uint64(SPLIT)))
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=np.int64)
                times = np.diff(np.r_[first, len(both)])
                at = np.searchsorted(both[first] >> np.uint64(64 - SPLIT), np.arange(len(texts) + 1, dtype=np.uint64)).astype(np.int32)
                tail = (both[first] & np.uint64(2 ** (64 - SPLIT) - 1)).astype(np.int64)
                begin = np.r_[0, np.cumsum(lengths)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([xxhash.xxh3_64_intdigest(t or "") - 2**63 for t in texts], pa.int64()), pa.array(lengths), pa.array([ids[a:b].tobytes() for a, b in zip(begin, begin[1:])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(tail)), pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "hash", "tokens", "ids", "tail", "times"],
                )

    return run


def encoded(docs: DataFrame, model: Fitted) -> DataFrame:
    """(row, doc_id, hash of the text, tokens, ids, hashes of the words outside the vocabulary, how often each occurs), written once."""
    told = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = rows.mapInArrow(_encode(told), "doc_id long, hash long, tokens long, ids binary, tail array<long>, times array<int>")
    return cut(coded.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one unit, which come one after the other, as one row; repeated rows count once."""
    unit, last = None, None
    held: list[tuple[int, bytes]] = []

    def told() -> pa.RecordBatch:
        values = [[unit], [np.array([h for h, _ in held], dtype=np.int64).tobytes()], [np.array([len(x) // 2 for _, x in held], dtype=np.int64).tobytes()], [b"".join(x for _, x in held)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 3])], names=["unit", "hashes", "lengths", "ids"])

    for batch in batches:
        for u, h, i, ids in zip(*(batch.column(c).to_pylist() for c in ("unit", "hash", "doc_id", "ids"))):
            if (u, h, i) == last:
                continue
            last = (u, h, i)
            if u != unit and held:
                yield told()
                held = []
            unit = u
            held.append((h, ids))
    if held:
        yield told()


def masked(hashes: np.ndarray, lengths: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The positions that a round masks, by hash of text and place: those of all rounds are all, none twice."""
    offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.flatnonzero(mix64(np.repeat(hashes, lengths) + offset.astype(np.uint64)) % np.uint64(rounds) == turn)


def _train(told, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unflat(told.value)
        total, weight = None, 0
        for batch in batches:
            for hashes, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("hashes", "lengths", "ids"))):
                hashes, lengths, ids = np.frombuffer(hashes, dtype=np.uint64), np.frombuffer(lengths, dtype=np.int64), np.frombuffer(ids, dtype=np.uint16)
                at = masked(hashes, lengths, turn, rounds)
                if not len(at):
                    continue
                trainer = Trainer(net)
                trainer.train(contexts(ids, lengths, at), ids[at])
                w = 1 + len(at) // 1000
                part = np.rint(flat(trainer.net).astype(np.float64) * 2**GRAIN).astype(np.int64) * w
                total, weight = part if total is None else total + part, weight + w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([weight] * PIECES), pa.array([p.tobytes() for p in np.array_split(total, PIECES)], pa.binary())], names=["piece", "weight", "net"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    weight: Counter[int] = Counter()
    for batch in batches:
        for piece, w, net in zip(*(batch.column(k).to_pylist() for k in range(3))):
            x = np.frombuffer(net, dtype=np.int64)
            total[piece] = total[piece] + x if piece in total else x
            weight[piece] += w
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([(x / weight[p] / 2**GRAIN).astype(np.float32).tobytes() for p, x in total.items()], pa.binary())], names=["piece", "net"])


def trained(coded: DataFrame, model: Fitted, rounds: int = ROUNDS) -> Fitted:
    """The model with a network trained on every position of the encoded documents once; documents of one id and text count once."""
    spark = coded.sparkSession
    model.net = flat(start(model.counts))
    many = max(1, round(float(model.counts.sum()) / UNIT))
    own = coded.where("tokens > 0").select(F.pmod(F.xxhash64("hash", "doc_id"), F.lit(many)).alias("unit"), "hash", "doc_id", "ids")
    units = own.repartition("unit").sortWithinPartitions("unit", "hash", "doc_id").mapInArrow(_units, "unit long, hashes binary, lengths binary, ids binary")
    units = cut(units, "units")
    for turn in range(rounds):
        told = spark.sparkContext.broadcast(model.net)
        found = units.mapInArrow(_train(told, turn, rounds), "piece int, weight long, net binary")
        pieces = {r.piece: r.net for r in found.repartition("piece").mapInArrow(_average, "piece int, net binary").collect()}  # the network, of fixed size
        if not pieces:
            break
        model.net = np.concatenate([np.frombuffer(pieces[k], dtype=np.float32) for k in range(PIECES)])
    free(units)
    return model


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Fitted:
    model = counted(docs)
    return trained(encoded(docs, model), model, rounds)


def _score(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, counts = told.value
        net, share = unflat(net), np.where(np.arange(VOCABULARY) < VOCABULARY - SHAPES, 0.0, -np.log(np.maximum(counts, 1)))
        for whole in batches:
            for batch in slices(whole, "ids", size=2_000_000):
                every = [np.frombuffer(x, dtype=np.uint16) for x in batch.column("ids").to_pylist()]
                lengths = np.array([len(x) for x in every], dtype=np.int64)
                ids = np.concatenate(every) if every else np.zeros(0, dtype=np.uint16)
                sums = np.zeros(len(every))
                owner = np.repeat(np.arange(len(every)), lengths)
                around = contexts(ids, lengths, np.arange(len(ids)))
                if len(ids):
                    sums += np.bincount(owner, log_probabilities(net, around, ids) + share[ids], len(every))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "tokens")), pa.array(sums)], names=["row", "doc_id", "tokens", "net"])

    return run


def scored(coded: DataFrame, model: Fitted) -> DataFrame:
    """The network's sums, and beside them those of the logarithms of the counts of words outside the vocabulary.

    The latter are summed as whole numbers, so in any order. Words that occur once, or that the model never saw, add nothing.
    """
    told = coded.sparkSession.sparkContext.broadcast((model.net, model.counts))
    net = coded.select("row", "doc_id", "tokens", "ids").mapInArrow(_score(told), "row long, doc_id long, tokens long, net double")
    known = model.words.where("n > 1").groupBy(F.shiftrightunsigned(F.xxhash64("word"), SPLIT).alias("word")).agg(F.round(F.log(F.sum("n")) * 2**GRAIN).cast("long").alias("log"))
    rare = coded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), "t.times")
    tail = rare.join(known, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("tail"))
    total = F.col("net") + F.coalesce(F.col("tail") / 2**GRAIN, F.lit(0.0))
    out = net.join(tail, "row", "left").select("doc_id", "tokens", total.alias("log_likelihood"))
    return out.withColumn("per_token", F.when(F.col("tokens") > 0, F.col("log_likelihood") / F.col("tokens")))


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    return scored(encoded(docs, model), model)


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, tokens, log_likelihood, per_token) for every row of docs.

    Each token is predicted from two tokens on either side, a mark standing for those outside the text. A null or empty text
    has no tokens: its log-likelihood is 0 and per_token is null. Null ids and repeated rows are scored like others; rows
    of one id and text train the network once. Very long texts are read whole. An empty table gives no rows; further columns
    don't matter. But for the rounding of single sums the result is the same however the rows are partitioned or ordered.
    """
    model = counted(docs)
    coded = encoded(docs, model)
    return scored(coded, trained(coded, model, rounds))
