"""The quality report of a document's structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(stats: DataFrame) -> DataFrame:
    """(doc_id, red, yellow, verdict) from one row of counts a document.

    missing, missing_pages: blocks without annotation, and on how many pages; unanchored: entries without a title;
    duplicates: repeated titles; longest_gap: of uncovered pages; artefacts: remains of formula conversion; titles, entries.
    """
    c = F.col
    red = [(c("missing") > 10) & (c("missing_pages") > 3), c("unanchored") > 0, c("longest_gap") >= 10, c("artefacts") >= 100, c("titles") == 0]
    red_names = ["missing blocks", "entries unanchored", "pages uncovered", "formula artefacts", "no structure"]
    yellow = [(c("missing") > 0) & ~red[0], c("entries") == 0, c("duplicates") > 0, (c("longest_gap") >= 4) & ~red[2], (c("artefacts") >= 10) & ~red[3]]
    yellow_names = ["some blocks missing", "no table of contents", "duplicate titles", "short gaps", "some artefacts"]
    said = lambda tests, names: F.array_compact(F.array(*(F.when(t, n) for t, n in zip(tests, names))))
    out = stats.withColumn("red", said(red, red_names)).withColumn("yellow", said(yellow, yellow_names))
    return out.withColumn("verdict", verdict(F.col("red"), F.col("yellow"))).select("doc_id", "red", "yellow", "verdict")


def verdict(red: Column, yellow: Column) -> Column:
    return F.when(F.size(red) > 0, "RED").when(F.size(yellow) > 0, "YELLOW").otherwise("GREEN")


def summary(reports: DataFrame) -> DataFrame:
    """(verdict, documents, red_flags)."""
    return reports.groupBy("verdict").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("red")).alias("red_flags"))
