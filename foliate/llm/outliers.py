"""Operator 1: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Each text gives a vector of six transformed statistics. For each language and source three deterministic starts are
improved by concentration steps (keep the share H of vectors nearest to the estimate, estimate anew); the one of least
determinant is concentrated until it stands, made consistent and reweighted once. Texts far from it in Mahalanobis
distance are rejected. A step is two aggregations over narrow rows; no task holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, free

D = 6
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
#: Share of the vectors that an estimate keeps.
H = 0.75
#: A language and source of fewer distinct vectors is judged with its whole language, a language of fewer with all.
LEAST = 100
#: A text is rejected if normal vectors are as far with less than this probability. It is low because clean texts' tails, above all
#: those of short texts, are longer than normal ones.
TAIL = 1e-16
REWEIGHT = 0.975
#: Added to each variance: statistics that hardly differ don't make an estimate singular.
RIDGE = 0.05**2
FIRST_STEPS, MOST_STEPS, STILL = 2, 12, 1e-3
#: Cells of log distance and of statistics, for exact quantiles from bounded counts.
GRID = 64

ESTIMATE = f"level int, lang string, source string, start int, n double, logdet double, {', '.join(f'm{i} double' for i in range(D))}, {', '.join(f'c{i}{j} double' for i, j in PAIRS)}"
KEYS = ["level", "lang", "source"]


def chi2_tail(x: float, d: int) -> float:
    """The probability of more than x, for an even number d of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


@lru_cache
def chi2_beyond(tail: float, d: int) -> float:
    """What is exceeded with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, d) > tail else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the nearest share of normal vectors is multiplied by to give that of all."""
    return share / (1 - chi2_tail(chi2_beyond(1 - share, D), D + 2))


def statistics(text: Column) -> list[Column]:
    """Log words, log distinct words, log mean word length, and the log shares of capitals, of signs and of lines; shares of short texts are shrunk."""
    chars = F.length(text)
    own = F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")
    words, distinct = F.size(own), F.size(F.array_distinct(own))
    spaces = F.regexp_count(text, F.lit(r"[ \t\r\n]"))
    log_share = lambda n, a, of, b: F.log((n + F.lit(a)) / (of + F.lit(b)))
    return [F.log(words), F.log(distinct), log_share(chars - spaces, 10.0, words, 2.0), log_share(F.regexp_count(text, F.lit(r"\p{Lu}")), 5.0, chars, 150.0), log_share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N} \t\r\n]")), 5.0, chars, 150.0), log_share(F.regexp_count(text, F.lit(r"\n")), 1.0, words, 100.0)]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, x0..x5): null where a text has no words. Null languages and sources are ''."""
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.when(text.rlike(r"[^ \t\r\n]"), text).alias("text"))
    return narrow.select("doc_id", "lang", "source", *(x.alias(f"x{k}") for k, x in enumerate(statistics(F.col("text")))))


def _pooled(vec: DataFrame) -> DataFrame:
    """Every distinct vector of a language and source once, there, in its language and among all."""
    xs = [f"x{k}" for k in range(D)]
    once = vec.where("x0 is not null").select("lang", "source", *xs).distinct()
    to = F.explode(F.array(F.struct(F.lit(0).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", F.lit("").alias("source")), F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source"))))
    return cut(once.select(to.alias("g"), *xs).select("g.*", *xs), "vectors")


def _estimates(make: Callable[[dict[str, np.ndarray]], list[tuple[int, np.ndarray, np.ndarray]]]):
    """For mapInArrow: rows of sums to rows of estimates; make gives (start, means, covariances) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c not in KEYS}
            for start, mean, cov in make(col):
                cov = cov + RIDGE * np.eye(D)
                inverse = np.linalg.inv(cov)
                starts = np.broadcast_to(np.asarray(start, dtype=np.int32), len(mean))
                values = [*(b.column(k) for k in KEYS), pa.array(starts), pa.array(col["n"].astype(float)), pa.array(np.linalg.slogdet(cov)[1]), *(pa.array(mean[:, i]) for i in range(D)), *(pa.array(inverse[:, i, j] * (1 if i == j else 2)) for i, j in PAIRS)]
                yield pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in ESTIMATE.split(", ")])

    return run


def _square(col: dict[str, np.ndarray], name: str) -> np.ndarray:
    out = np.zeros((len(col["n"]), D, D))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = col[f"{name}{i}{j}"]
    return out


def _starts(col: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    mid = np.stack([col[f"q{i}"] for i in range(D)], axis=1)
    scale = np.stack([col[f"s{i}"] for i in range(D)], axis=1)
    n = col["n"][:, None]
    t = np.stack([col[f"t{i}"] for i in range(D)], axis=1) / n
    tanh = _square(col, "tt") / n[:, :, None] - t[:, :, None] * t[:, None, :]
    sign = _square(col, "uu") / n[:, :, None] * D
    side = np.sqrt(np.maximum(np.einsum("kii->ki", tanh), 1e-9))
    both = scale[:, :, None] * scale[:, None, :]
    return [(0, mid, both * np.eye(D)), (1, mid, both * tanh / (side[:, :, None] * side[:, None, :])), (2, mid, both * sign)]


def _moved(factor: float):
    def make(col: dict[str, np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        n = col["k"][:, None]
        shift = np.stack([col[f"y{i}"] for i in range(D)], axis=1) / n
        mean = np.stack([col[f"o{i}"] for i in range(D)], axis=1) + shift
        return [(col["start"], mean, factor * (_square(col, "yy") / n[:, :, None] - shift[:, :, None] * shift[:, None, :]))]

    return make


def distance() -> Column:
    """The squared Mahalanobis distance of x0.. from the estimate beside it."""
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    return F.greatest(F.lit(0.0), reduce(Column.__add__, (F.col(f"c{i}{j}") * y[i] * y[j] for i, j in PAIRS)))


def _cell(d2: Column) -> Column:
    return F.floor(F.log(d2 + F.lit(1e-9)) * GRID)


def _estimate_from(near: DataFrame, factor: float) -> DataFrame:
    """The estimates from rows of vectors beside the estimates for which they count."""
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    sums = near.groupBy(*KEYS, "start").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"o{i}") for i in range(D)), *(F.sum(y[i]).alias(f"y{i}") for i in range(D)), *(F.sum(y[i] * y[j]).alias(f"yy{i}{j}") for i, j in PAIRS))
    return sums.mapInArrow(_estimates(_moved(factor)), ESTIMATE)


def _concentrate(pooled: DataFrame, now: DataFrame) -> DataFrame:
    """One step: keep the share H of least distance, all of the cell in which it ends."""
    beside = pooled.join(now, KEYS).withColumn("cell", _cell(distance()))
    ends = beside.groupBy(*KEYS, "start").agg(F.ceil(F.percentile("cell", F.lit(H))).alias("end"))
    return cut(_estimate_from(beside.join(ends, [*KEYS, "start"]).where("cell <= end"), 1.0), "estimates")


def estimates(pooled: DataFrame) -> DataFrame:
    """The reweighted estimate of each group that has LEAST vectors, and of all vectors."""
    quartiles = lambda i: F.percentile(F.round(F.col(f"x{i}") * GRID), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    mid = pooled.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *(quartiles(i).alias(f"p{i}") for i in range(D))).where((F.col("n") >= LEAST) | (F.col("level") == 2))
    mid = cut(mid.select(*KEYS, "n", *((F.col(f"p{i}")[1] / GRID).alias(f"q{i}") for i in range(D)), *(F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / (1.349 * GRID), F.lit(RIDGE**0.5)).alias(f"s{i}") for i in range(D))), "quartiles")
    z = pooled.join(mid, KEYS).select(*KEYS, *((F.col(f"x{i}") - F.col(f"q{i}")).alias(f"r{i}") / F.col(f"s{i}") for i in range(D))).toDF(*KEYS, *(f"z{i}" for i in range(D)))
    norm = F.greatest(F.sqrt(reduce(Column.__add__, (F.col(f"z{i}") ** 2 for i in range(D)))), F.lit(1e-9))
    z = z.select(*KEYS, *(F.tanh(f"z{i}").alias(f"t{i}") for i in range(D)), *((F.col(f"z{i}") / norm).alias(f"u{i}") for i in range(D)))
    sums = z.groupBy(*KEYS).agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(D)), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"tt{i}{j}") for i, j in PAIRS), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"uu{i}{j}") for i, j in PAIRS))
    now = cut(mid.join(sums, KEYS).mapInArrow(_estimates(_starts), ESTIMATE), "estimates")
    for _ in range(FIRST_STEPS):
        now = _concentrate(pooled, now)
    best = now.groupBy(*KEYS).agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now = cut(now.join(best, [*KEYS, "start"]).select(now.columns), "estimates")
    for _ in range(MOST_STEPS):
        before, now = now, _concentrate(pooled, now)
        moved = now.join(before.select(*KEYS, F.col("logdet").alias("was")), KEYS).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        free(before)
        if moved is None or moved < STILL:
            break
    c = consistency(H)
    near = pooled.join(now, KEYS).where(distance() <= chi2_beyond(1 - REWEIGHT, D) * c)
    return cut(_estimate_from(near, consistency(REWEIGHT)), "final")


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, level, distance, rejected) for every row of docs.

    level tells whose estimate judged it: 0 its language's and source's, 1 its language's, 2 that of all. A text that is null or
    has no words has no statistics: null level and distance, rejected. Null languages and sources are a group ''. Copies
    count once in estimates and are judged alike; null ids are carried along; an empty table gives no rows.
    """
    vec = cut(vectors(docs), "statistics")
    found = estimates(_pooled(vec)).drop("start", "n", "logdet")
    xs = [f"x{k}" for k in range(D)]
    at = lambda k: found.where(F.col("level") == k).withColumn("e", F.struct(*(c for c in found.columns if c not in KEYS)))
    own, whole, every = at(0).select("lang", "source", F.col("e").alias("e0")), at(1).select("lang", F.col("e").alias("e1")), at(2).select(F.col("e").alias("e2"))
    beside = vec.join(own, ["lang", "source"], "left").join(whole, "lang", "left").join(F.broadcast(every), how="left")  # one row
    level = F.when(F.col("e0").isNotNull(), 0).when(F.col("e1").isNotNull(), 1).otherwise(2)
    beside = beside.select("doc_id", "lang", "source", *xs, F.when(F.col("x0").isNotNull(), level).alias("level"), F.coalesce("e0", "e1", "e2").alias("e")).select("doc_id", "lang", "source", "level", *xs, "e.*")
    d = F.when(F.col("x0").isNotNull(), F.sqrt(distance()))
    return beside.select("doc_id", "lang", "source", "level", d.alias("distance")).withColumn("rejected", F.coalesce(F.col("distance") > chi2_beyond(TAIL, D) ** 0.5, F.lit(True)))


def keep(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, level, distance) of the rows of docs that aren't rejected."""
    return verdicts(docs).where("not rejected").drop("rejected")
