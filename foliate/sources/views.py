"""Block tables seen in the driver's tables, as DataFrames and as DuckDB common table expressions.

A document's lines are its blocks, eight to a page; its sentences are shorter blocks; every sixth sentence doubles as an
entry of its table of contents. Turns of a conversation are blocks of another kind; so are the elements of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PAGE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pieces(spark: SparkSession, sf_dir: str, pattern: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", pattern)).alias("ord", "text"))
    return rows.select("doc_id", "ord", (F.floor(F.col("ord") / PER_PAGE) + 1).cast("int").alias("page"), "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, page, text)."""
    return _pieces(spark, sf_dir, "\n")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, page, text)."""
    return _pieces(spark, sf_dir, r"[.!?][ \n]+|\n")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


HTML = r"<(h1|p|li|title)(?:\s[^>]*)?>([^<]*)"


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, tag, text)."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    tags, texts = (F.regexp_extract_all("html", F.lit(HTML), F.lit(k)) for k in (1, 2))
    return pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("ord", "b")).select("page_id", "ord", "b.tag", "b.text")


def _pieces_sql(split: str) -> str:
    return f"(select doc_id, cast(i - 1 as integer) as ord, cast((i - 1) // {PER_PAGE} + 1 as integer) as page, t[i] as text from (select doc_id, {split} as t from documents where text is not null) d, unnest(range(1, len(d.t) + 1)) as u(i))"


LINES_SQL = _pieces_sql("string_split(text, chr(10))")
SENTENCES_SQL = _pieces_sql(r"regexp_split_to_array(text, '[.!?][ \n]+|\n')")
HTML_SQL = f"(select page_id, cast(i - 1 as integer) as ord, tags[i] as tag, texts[i] as text from (select page_id, regexp_extract_all(html, '{HTML}', 1) as tags, regexp_extract_all(html, '{HTML}', 2) as texts from pages where html is not null) p, unnest(range(1, len(p.tags) + 1)) as u(i))"
