"""Operators over ordered, paged blocks: windows, islands, near-duplicate pages, offsets, packing.

Blocks are rows (doc_id, ord, page, text); every operator takes DataFrames and partitions by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window as W

from .grouped import by_rows

SHINGLE, ALIKE, LOOKAHEAD = 8, 0.8, 2


def _by(*keys: str):
    return W.partitionBy(*keys)


def first_of_page(blocks: DataFrame, key: Column) -> DataFrame:
    """Of the blocks of one key on a page the first; blocks of an empty key all stay."""
    rn = F.row_number().over(_by("doc_id", "page", "key").orderBy("ord"))
    return blocks.withColumn("key", key).withColumn("rn", rn).where("rn = 1 or key = ''").drop("rn")


def running_heads(titles: DataFrame, key: Column, top: Column, band: float = 0.10) -> DataFrame:
    """Demoted tells the titles in the top band whose key an earlier page had."""
    first = F.first("page").over(_by("doc_id", "key").orderBy("ord"))
    return titles.withColumn("key", key).withColumn("demoted", (F.col("key") != "") & (first < F.col("page")) & (top <= band))


def page_texts(blocks: DataFrame, most: int = 800) -> DataFrame:
    """A1: (doc_id, page, text): the blocks of a page that aren't empty, joined by line ends, cut to `most` characters."""
    some = blocks.where(F.trim("text") != "")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b.text)
    return some.groupBy("doc_id", "page").agg(F.substring(F.array_join(parts, "\n"), 1, most).alias("text"))


def sampled_pages(pages: DataFrame, front: int = 15, back: int = 5) -> DataFrame:
    """O2: the first and last pages of each document; no page twice."""
    last = F.max("page").over(_by("doc_id"))
    return pages.withColumn("last_page", last).where((F.col("page") <= front) | (F.col("page") > F.greatest(F.lit(front), F.col("last_page") - back))).drop("last_page")


def shingled(text: str, width: int = SHINGLE) -> set[str]:
    """The distinct runs of `width` characters; a shorter text is its only shingle."""
    return {text[k : k + width] for k in range(max(len(text) - width + 1, 1))}


def near_duplicate_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, dropped) of pages that have text. A page much like one of the next two drops the later one; dropped pages compare no more."""
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b.text), "")
    pages = blocks.groupBy("doc_id", "page").agg(F.regexp_replace(parts, r"(?U)\s+", "").alias("t")).where("t <> ''")
    return by_rows(pages, _dropped, StructType([*pages.schema.fields[:2], StructField("dropped", BooleanType())]), "doc_id", order=("page",))


def _dropped(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A task holds as many kept pages as are looked back to; a page is cut up once it has a neighbour to compare with."""
    document, back = object(), []
    for doc, page, text in rows:
        if doc != document:
            document, back = doc, []
        own, dropped = [text, None], False
        for other in reversed(back):
            if other and not dropped:
                for x in (own, other):
                    x[1] = shingled(x[0]) if x[1] is None else x[1]
                same = len(own[1] & other[1])
                dropped = same > ALIKE * (len(own[1]) + len(other[1]) - same)
        back = [*back[1 - LOOKAHEAD :], None if dropped else own]
        yield doc, page, dropped


def page_gaps(covered: DataFrame, last: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, first_page, last_page, pages) of runs of at least `least` uncovered pages.

    covered: (doc_id, page); last: (doc_id, last_page). Gaps lie between neighbours, so pages are never enumerated.
    """
    ends = last.select("doc_id", F.lit(0).alias("page")).unionByName(last.select("doc_id", (F.col("last_page") + 1).cast("int").alias("page")))
    pages = covered.select("doc_id", F.col("page").cast("int").alias("page")).unionByName(ends).distinct()
    rows = pages.withColumn("before", F.lag("page").over(_by("doc_id").orderBy("page")))
    return rows.where(F.col("page") - F.col("before") > least).select("doc_id", (F.col("before") + 1).alias("first_page"), (F.col("page") - 1).alias("last_page"), (F.col("page") - F.col("before") - 1).alias("pages"))


def offset_votes(votes: DataFrame, least: int = 3, around: int = 5) -> DataFrame:
    """A2: votes (doc_id, ord, printed, scan) near the commonest offset of their document, if there are enough of both.

    Of offsets as common as each other, that seen first is the commonest.
    """
    v = votes.withColumn("offset", F.col("scan") - F.col("printed"))
    modes = v.groupBy("doc_id", "offset").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("seen"))
    best = modes.groupBy("doc_id").agg(F.max_by(F.struct("offset", "n"), F.struct("n", -F.col("seen"))).alias("m"), F.sum("n").alias("all"))
    near = v.join(best.where(F.col("m.n") >= least).select("doc_id", F.col("m.offset").alias("mode")), "doc_id").where(F.abs(F.col("offset") - F.col("mode")) <= around)
    return near.withColumn("k", F.count(F.lit(1)).over(_by("doc_id"))).where(F.col("k") >= least).drop("k")


def nearest_offset(asked: DataFrame, votes: DataFrame) -> DataFrame:
    """asked(doc_id, printed) with the offset of the nearest vote; of votes as near, the smaller printed page, then scan page.

    An as-of join in two directions by windows over the union: linear in rows, whatever the number of votes.
    """
    one = votes.groupBy("doc_id", "printed").agg(F.min("scan").alias("scan"))
    both = asked.withColumn("scan", F.lit(None).cast("int")).withColumn("asked", F.lit(True)).unionByName(one.select("doc_id", "printed", "scan").withColumn("asked", F.lit(False)), allowMissingColumns=True)
    pair = F.when(~F.col("asked"), F.struct("printed", "scan"))
    order = _by("doc_id").orderBy("printed", "asked")
    below = F.last(pair, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.first(pair, True).over(order.rowsBetween(0, W.unboundedFollowing))
    found = both.withColumn("low", below).withColumn("high", above).where("asked")
    near = F.when(F.col("high").isNull() | (F.col("printed") - F.col("low.printed") <= F.col("high.printed") - F.col("printed")), F.col("low")).otherwise(F.col("high"))
    return found.withColumn("v", near).withColumn("offset", F.col("v.scan") - F.col("v.printed")).drop("low", "high", "v", "asked", "scan")


def parents(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, ord, level) with the ord of the nearest earlier node of a smaller level, or -1.

    Levels have no bound; those of 0 and less, and null ones, count as deeper than any and own nothing. A stack over rows in
    order of document and ord: a task holds the open ancestors of one document only, however long it is.
    """
    schema = StructType([*nodes.schema.fields, StructField("parent", nodes.schema["ord"].dataType)])
    return nodes.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(_owned, schema)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    document, open_ = object(), []
    for b in batches:
        out = []
        for doc, ord_, level in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ord", "level"))):
            if doc != document:
                document, open_ = doc, []
            inner = level is None or level <= 0
            while open_ and not inner and open_[-1][0] >= level:
                open_.pop()
            out.append(open_[-1][1] if open_ else -1)
            if not inner:
                open_.append((level, ord_))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, b.schema.field("ord").type)], names=[*b.schema.names, "parent"])


def sink_below_anchor(titles: DataFrame) -> DataFrame:
    """A plain title without anchor isn't less deep than one below the last anchored title."""
    last = F.last(F.when(F.col("anchored"), F.col("level")), True).over(_by("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    return titles.withColumn("new_level", F.when(~F.col("anchored") & last.isNotNull(), F.greatest("level", last + 1)).otherwise(F.col("level")))


def islands(blocks: DataFrame, starts: Column) -> DataFrame:
    """Numbers the runs of a document's blocks: a new one where `starts` holds. The base of W6, W7 and W10."""
    return blocks.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(_by("doc_id").orderBy("ord")))


def bind_captions(blocks: DataFrame) -> DataFrame:
    """Captions (doc_id, ord, kind image/figure_caption/...) with the ord of what they belong to, or null.

    A figure caption belongs to the last image of the run after it, else to the image right before it; a table caption to
    the next table of the page, else to the one before.
    """
    order = _by("doc_id", "page").orderBy("ord")
    kind = F.col("kind")
    run = F.sum(F.when(F.lag(kind).over(order).eqNullSafe(kind), 0).otherwise(1)).over(order)
    b = blocks.withColumn("run", run)
    ends = b.groupBy("doc_id", "page", "run").agg(F.first("kind").alias("next_kind"), F.max("ord").alias("next_end")).withColumn("run", F.col("run") - 1)
    b = b.join(ends, ["doc_id", "page", "run"], "left")
    is_last = F.lead("run").over(order) != F.col("run")
    after = F.when(is_last & (F.col("next_kind") == "image"), F.col("next_end"))
    before = F.when(F.lag(kind).over(order) == "image", F.lag("ord").over(order))
    table = F.when(kind == "table", F.col("ord"))
    next_table = F.first(table, True).over(order.rowsBetween(1, W.unboundedFollowing))
    last_table = F.last(table, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    to = F.when(kind == "figure_caption", F.coalesce(after, before)).when(kind == "table_caption", F.coalesce(next_table, last_table))
    return b.withColumn("bound_to", to).where(kind.isin("figure_caption", "table_caption")).drop("run", "next_kind", "next_end")


def batches(items: DataFrame, size: Column, most: int = 6000) -> DataFrame:
    """The number of the batch of each item: a batch closes once its size reaches `most`. A fold over narrow structs of a document."""
    rows = items.withColumn("__size", size).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "__size"))).alias("i"))
    step = lambda s, x: F.struct(F.when(s.full + x["__size"] >= most, 0).otherwise(s.full + x["__size"]).alias("full"), F.when(s.full + x["__size"] >= most, s.batch + 1).otherwise(s.batch).alias("batch"), F.concat(s.out, F.array(F.struct(x.ord.alias("ord"), s.batch.alias("batch")))).alias("out"))
    start = F.struct(F.lit(0).alias("full"), F.lit(0).alias("batch"), F.array().cast("array<struct<ord:int,batch:int>>").alias("out"))
    return rows.select("doc_id", F.explode(F.aggregate("i", start, step, lambda s: s.out)).alias("b")).select("doc_id", "b.ord", "b.batch")


def batch_contexts(batched: DataFrame, most: int = 400) -> DataFrame:
    """(doc_id, batch, context): the first characters of the last item of the batch before."""
    last = batched.groupBy("doc_id", "batch").agg(F.max_by("text", "ord").alias("t"))
    return last.select("doc_id", "batch", F.coalesce(F.substring(F.lag("t").over(_by("doc_id").orderBy("batch")), 1, most), F.lit("")).alias("context"))


def continuations(blocks: DataFrame, fits) -> DataFrame:
    """(doc_id, ord, next_ord): the nearest later text block that may go on with a text block, not across a title or equation.

    Not the next block but the next that fits, so pairs within a segment are compared.
    """
    b = islands(blocks, F.col("kind").isin("title", "equation")).where(F.col("kind") == "text")
    c = b.select("doc_id", "island", F.col("ord").alias("next_ord"), F.col("text").alias("next_text"))
    pairs = b.join(c, ["doc_id", "island"]).where((F.col("next_ord") > F.col("ord")) & fits(F.col("text"), F.col("next_text")))
    return pairs.groupBy("doc_id", "ord").agg(F.min("next_ord").alias("next_ord"))


def claim_footnotes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, note, ord, number): each note goes to the first block of its page that has its marker; numbered in reading order."""
    hits = notes.join(blocks, ["doc_id", "page"]).where(F.instr(F.col("text"), F.concat(F.lit("<sup>"), F.col("marker"), F.lit("</sup>"))) > 0)
    first = hits.groupBy("doc_id", "note").agg(F.min("ord").alias("ord"))
    return first.withColumn("number", F.row_number().over(_by("doc_id").orderBy("ord", "note")))


def empty_nodes(nodes: DataFrame) -> DataFrame:
    """Titles (level > 0) with no content of their own nor below. A node's descendants end before the next node of its level or less."""
    order = _by("doc_id").orderBy("ord")
    inner = nodes.withColumn("k", F.row_number().over(order))
    heads = inner.where("level > 0")
    later = heads.select("doc_id", F.col("k").alias("k2"), F.col("level").alias("level2"))
    ends = heads.join(later, "doc_id", "left").groupBy("doc_id", "ord", "k", "level").agg(F.min(F.when((F.col("k2") > F.col("k")) & (F.col("level2") <= F.col("level")), F.col("k2"))).alias("end"))
    full = inner.where("has_content").select("doc_id", F.col("k").alias("kc"))
    hit = (ends.doc_id == full.doc_id) & (full.kc >= ends.k) & (full.kc < F.coalesce(ends.end, F.lit(2**30)))
    return ends.join(full, hit, "left_anti").select("doc_id", "ord", "level")
