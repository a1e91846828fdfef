"""Translation as a dataflow around a pluggable scorer (L-series): items, prompts, replies, glossary, lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLOSSARY, CONTEXT = 60, 400


def items(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, sub, key, text): the texts of blocks, then their captions; blank ones are left out."""
    texts = F.concat(F.array(F.struct(F.lit(0).alias("sub"), F.col("ord").cast("string").alias("key"), F.col("text"))), F.transform(F.coalesce("captions", F.array().cast("array<string>")), lambda c, k: F.struct((k + 1).alias("sub"), F.concat(F.col("ord").cast("string"), F.lit(".cap"), k.cast("string")).alias("key"), c.alias("text"))))
    return blocks.select("doc_id", "ord", F.explode(texts).alias("i")).select("doc_id", "ord", "i.sub", "i.key", "i.text").where("trim(text) <> ''")


def prompts(batched: DataFrame) -> DataFrame:
    """(doc_id, batch, prompt): the texts of a batch, numbered, after the context of the batch before."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), b.text))
    return batched.groupBy("doc_id", "batch", "context").agg(F.array_join(lines, "\n").alias("body")).select("doc_id", "batch", F.concat(F.when(F.col("context") != "", F.concat(F.lit("Before: "), "context", F.lit("\n"))).otherwise(""), "body").alias("prompt"))


def glossary(terms: DataFrame, most: int = GLOSSARY) -> DataFrame:
    """(doc_id, terms): the first terms in order of the source, the latest target of each; a pass of its own, so the same for any timing."""
    one = terms.groupBy("doc_id", "source").agg(F.max_by("target", F.struct("batch", "target")).alias("target"))
    return one.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("source", "target"))), 1, most).alias("terms"))


def score(rows: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """L1, L2: a model behind mapInPandas. Tasks may run twice, so a scorer must be idempotent; replies are to be written before they are parsed."""
    return rows.mapInPandas(scorer, schema)


def translation_of(asked: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, key, translated): of the key, else of the key without what follows its first point."""
    a = asked.withColumn("base", F.substring_index("key", ".", 1))
    exact = done.select("doc_id", F.col("key"), F.col("text").alias("t1"))
    base = done.select("doc_id", F.col("key").alias("base"), F.col("text").alias("t2"))
    return a.join(exact, ["doc_id", "key"], "left").join(base, ["doc_id", "base"], "left").select("doc_id", "key", F.coalesce("t1", "t2").alias("translated"))
