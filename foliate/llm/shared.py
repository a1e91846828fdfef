"""Helpers the corpus operators share: table access, cutting lineage, words, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of letters, digits and underscores, lower-cased.
WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def slices(batch: pa.RecordBatch, column: str | int, rows: int = 500, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most that many rows and bytes of the column; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for k, n in enumerate(lengths):
        if k > begin and (k - begin >= rows or held + n > size):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < len(lengths):
        yield batch.slice(begin)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


_made: dict[int, object] = {}


def once(told, make: Callable[[object], object]) -> object:
    """make(told.value), kept for the later tasks of the same worker process; only the latest few are kept."""
    key = getattr(told, "_jbroadcast", None)
    key = key.id() if key is not None else getattr(told, "_path", None) or id(told)
    if key not in _made:
        if len(_made) > 3:
            _made.clear()
        _made[key] = make(told.value)
    return _made[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach; unset in local mode (tests), a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='foliate-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and that no later plan reads."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays, in place: afterwards parent[x] is the least member of x's component."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), root being the least node of its component.

    Large-star and small-star steps alternate until the set of edges no longer changes; each round is one
    written table, so that plans stay short and a lost executor costs one round at most.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    many = now.count()
    while many:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = cut(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        before, many = many, new.count()
        still = many == before and new.join(now, ["a", "b"], "left_anti").isEmpty()  # both are sets
        free(now)
        now = new
        if still:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
