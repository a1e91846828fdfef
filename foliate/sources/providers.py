"""Sources and sinks (S- and K-series): recorded layout results as JSON, a registry of readers, structure files, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = "type string, text string, text_level int, page_idx int, bbox array<double>, img_path string, table_body string, table_caption array<string>, image_caption array<string>, list_items array<string>"
_READERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, reader: Callable[..., DataFrame]) -> None:
    """A reader of (spark, path) under a name."""
    _READERS[name] = reader


def names() -> list[str]:
    return sorted(_READERS)


def read(name: str, spark: SparkSession, path: str) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"no reader {name!r}; there are {', '.join(names())}")
    return _READERS[name](spark, path)


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of files <document>/<engine>/content_list.json, each a JSON array: (document, engine, ord, page, block...)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*content_list*.json").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    rows = raw.select(F.element_at(parts, -3).alias("document"), F.element_at(parts, -2).alias("engine"), F.posexplode(F.from_json("value", f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>")).alias("ord", "b"))
    return rows.select("document", "engine", "ord", (F.col("b.page_idx") + 1).alias("page"), "b.*")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: results of one page a line, with images found by the corners in their names."""
    pages = spark.read.schema("document string, page_idx int, blocks array<struct<label:string,content:string,bbox:array<int>>>, images map<string,string>").json(path)
    rows = pages.select("document", (F.col("page_idx") + 1).alias("page"), "images", F.posexplode("blocks").alias("ord", "b"))
    corner = F.array_join(F.col("b.bbox").cast("array<string>"), "_")
    hit = F.filter(F.sort_array(F.map_entries("images")), lambda e: F.contains(e.key, corner))
    return rows.select("document", "page", "ord", "b.*", F.try_element_at(hit, F.lit(1)).value.alias("image"))


register("content_list", content_lists)
register("json_lines", json_lines)


def preferred_engine(blocks: DataFrame, engine: str | None = None) -> DataFrame:
    """Of several engines' results for a document those of the preferred one, else of the first by name."""
    rank = F.row_number().over(W.partitionBy("document").orderBy(F.when(F.col("engine") == F.lit(engine), 0).otherwise(1), "engine"))
    best = blocks.select("document", "engine").distinct().withColumn("k", rank).where("k = 1").drop("k")
    return blocks.join(best, ["document", "engine"])


def best_annotated(blocks: DataFrame, annotated: DataFrame) -> DataFrame:
    """(document, engine): whose blocks are missing least in the annotation."""
    left = blocks.join(annotated.select("document", "engine", "ord").distinct().withColumn("there", F.lit(True)), ["document", "engine", "ord"], "left")
    by = left.groupBy("document", "engine").agg(F.count_if(F.col("there").isNull()).alias("missing"))
    return by.groupBy("document").agg(F.min_by("engine", F.struct("missing", "engine")).alias("engine"))


def rebase(chunks: DataFrame, size: int = 200) -> DataFrame:
    """Blocks of page-range chunks with pages of the whole document."""
    return chunks.withColumn("page_idx", F.col("page_idx") + F.col("chunk_no") * size).drop("chunk_no")


def structures(documents: DataFrame, path: str) -> None:
    """K1 to K3: one JSON structure a document, partitioned by a hash of the document so that no folder grows without bound."""
    rows = documents.withColumn("part", F.pmod(F.xxhash64("document"), F.lit(256)).cast("int"))
    rows.write.mode("overwrite").partitionBy("part").json(path)


def metadata(blocks: DataFrame) -> DataFrame:
    """(document, blocks, characters, pages)."""
    return blocks.groupBy("document").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.max("page").alias("pages"))
