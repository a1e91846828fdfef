"""Queries of folds, tables, rendering and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import classify as C
from ..functions import text as T
from ..operators import levels as L
from ..operators import render as R
from ..operators import tables as TB
from ..operators import translate as TR
from ..sources import views as V
from .registry import query
from .text_queries import _NUMBERED

LINES, SENTENCES, HTML = V.LINES_SQL, V.SENTENCES_SQL, V.HTML_SQL


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sentences as titles, every third anchored."""
    headed = F.concat(F.expr(_NUMBERED), F.col("text"))
    s = V.sentences(spark, sf_dir)
    return s.select("doc_id", "ord", "page", C.title_shape(headed).alias("shape"), (1 + F.length("text") % 4).cast("int").alias("level"), (F.col("ord") % 3 == 0).alias("anchored"), (0.01 + F.length("text") % 5 / 50.0).alias("height"))


@query("shape_stack")
def shape_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.by_document(titles(spark, sf_dir), L.calibrate, "doc_id long, ord int, new_level int")


@query("cv_height_groups")
def cv_height_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = titles(spark, sf_dir)
    return L.deepened(t, L.by_document(t, L.height_ladder, "doc_id long, ord int, ladder_level int"))


@query("adaptive_chunks")
def adaptive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = V.sentences(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(F.length("text") > 20).alias("items"))
    return L.by_document(pages, L.chunks, "doc_id long, chunk int, first int, last int")


@query("chunk_vote_merge")
def chunk_vote_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir)
    first = (F.floor((F.col("page") - 1) / 12) * 12 + 1).cast("int")
    again = s.where(F.col("page") % 12 == 1).withColumn("first", (first - 12)).where("first > 0")
    votes = s.withColumn("first", first).unionByName(again).select("doc_id", F.col("ord").alias("id"), "first", (F.col("first") + 12).alias("last"), (1 + (F.length("text") + F.col("first")) % 4).cast("int").alias("level"))
    return L.by_document(votes, L.merge_votes, "doc_id long, id int, level int")


@query("orphan_series")
def orphan_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat((F.col("ord") % 9).cast("string"), F.lit(". "), F.col("text"))
    s = C.series(headed)
    rows = V.sentences(spark, sf_dir).select("doc_id", "ord", "page", F.when((F.col("ord") % 9 > 2) & (F.length("text") % 2 == 0), 2).otherwise(0).alias("level"), F.coalesce(s.family, F.lit("")).alias("family"), F.coalesce(s.n, F.lit(0)).alias("n"), F.length(headed).alias("size"), headed.rlike("[。.;；]$").alias("closed"))
    return L.by_document(rows, L.orphans, "doc_id long, ord int, new_level int")


@query("toc_row_repair")
def toc_row_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir)
    y = (F.col("ord") % 8 * 120 + F.length("text") % 30).cast("int")
    rows = s.select("doc_id", "page", "ord", y.alias("y"), F.when(F.col("ord") % 2 == 1, (F.length("text") % 200).cast("string")).otherwise(F.col("text")).alias("text"), (F.col("ord") % 2 == 1).alias("is_number")).withColumn("y", F.when(F.col("is_number"), F.col("y") - 120).otherwise(F.col("y")))
    return L.by_document(rows, L.row_matches, "doc_id long, page int, entry_ord int, number int", "doc_id", "page")


@query("rescue_by_page")
def rescue_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.sentences(spark, sf_dir).select("doc_id", "ord", "page", T.title_key(F.col("text")).alias("key"), F.lit(0).alias("level"), F.lit(None).cast("int").alias("toc_ord"), F.lit(False).alias("missing"))
    e = b.where("ord % 7 = 0 and length(key) > 4").select("doc_id", F.lit(-1).alias("ord"), "page", F.concat(F.left("key", F.length("key") - 1), F.lit("#")).alias("key"), (1 + F.col("ord") % 2).cast("int").alias("level"), F.col("ord").alias("toc_ord"), F.lit(True).alias("missing"))
    return L.by_document(b.unionByName(e), L.rescue, "doc_id long, toc_ord int, ord int, sub_ord int, level int, how string")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table a page of a document, of its lines; every line's words are the cells of a row."""
    row = F.concat(F.lit("<tr><td>"), F.array_join(F.transform(F.split(F.col("text"), " "), R.escape_attr), "</td><td>"), F.lit("</td></tr>"))
    lines = V.doc_lines(spark, sf_dir).withColumn("row", row)
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "row"))), lambda b: b.row), "")
    return lines.groupBy("doc_id", "page").agg(F.min("ord").alias("ord"), F.concat(F.lit('<table><tr><th colspan="2">a</th><th>b</th><th>c</th></tr>'), rows, F.lit("</table>")).alias("html"))


@query("table_chain_merge")
def table_chain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.merge_pages(html_tables(spark, sf_dir))


@query("table_measures")
def table_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables(spark, sf_dir).select("doc_id", "page", TB.measure(F.col("html")).alias("m")).select("doc_id", "page", "m.*")


_KINDS = "['title', 'text', 'list', 'image', 'equation', 'noise'][ord % 6 + 1]"
_BODY = T.latex_sup_sql("text || '$^{2}$'")


@query("block_rendering", f"""select doc_id, ord, case {_KINDS} when 'title' then '<h' || least(greatest(1 + ord % 7 + 1, 1), 6) || '>' || {_BODY} || '</h' || least(greatest(1 + ord % 7 + 1, 1), 6) || '>' when 'image' then '<img src="' || {T.escape_attr_sql("text || '$^{2}$'")} || '"/>' when 'equation' then '<p class="equation">' || {_BODY} || '</p>' when 'list' then '<ul><li>' || replace({_BODY}, chr(10), '</li><li>') || '</li></ul>' when 'noise' then '' else '<p>' || {_BODY} || '</p>' end as html from {LINES}""")
def block_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("title", "text", "list", "image", "equation", "noise"))), (F.col("ord") % 6 + 1).cast("int"))
    return V.doc_lines(spark, sf_dir).select("doc_id", "ord", R.block_html(kind, F.concat("text", F.lit("$^{2}$")), 1 + F.col("ord") % 7).alias("html"))


_UNITS = f"(select doc_id, ord as unit, text as title, case when ord % 7 = 3 then 'divider' else 'chapter' end as kind from {LINES})"


@query("unit_files", f"with f as (select *, case kind when 'divider' then 'part_' else 'chapter_' end || lpad(cast(row_number() over (partition by doc_id order by unit) - 1 as varchar), 3, '0') || '.xhtml' as file from {_UNITS}) select doc_id, unit, file, case when kind <> 'divider' then last_value(case when kind = 'divider' then file end ignore nulls) over (partition by doc_id order by unit rows between unbounded preceding and 1 preceding) end as under from f")
def unit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unit_files(units(spark, sf_dir)).select("doc_id", "unit", "file", "under")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_lines(spark, sf_dir).select("doc_id", F.col("ord").alias("unit"), F.col("text").alias("title"), F.when(F.col("ord") % 7 == 3, "divider").otherwise("chapter").alias("kind"))


@query("navigation", f"with u as {_UNITS}, w as (select *, last_value(case when kind = 'divider' then unit end ignore nulls) over (partition by doc_id order by unit rows between unbounded preceding and 1 preceding) as part from u) select doc_id, cast(count_if(kind = 'divider' or part is null) as integer) as entries, cast(count_if(kind <> 'divider' and part is not null) as integer) as nested from w group by doc_id")
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = R.navigation(R.unit_files(units(spark, sf_dir)))
    nested = F.aggregate("nav", F.lit(0), lambda s, e: s + F.size(e.children))
    return nav.select("doc_id", F.size("nav").alias("entries"), nested.alias("nested"))


@query("supplement_titles", f"select page_id as doc_id, ord, 'Page ' || page || ' - ' || tag || case when k > 0 then ' - ' || k else '' end as title from (select *, ord // 8 as page, row_number() over (partition by page_id, ord // 8, tag order by ord) - 1 as k from {HTML})")
def supplement_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.html_blocks(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "ord", F.floor(F.col("ord") / 8).cast("int").alias("page"), F.col("tag").alias("kind"))
    return R.supplements(b)


@query("math_rendering")
def math_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.html_blocks(spark, sf_dir).select("page_id", "ord", R.math_html(F.concat("text", F.lit(" $x_{1}^2 \\le 3$"))).alias("html"))


@query("epub_books")
def epub_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: a book of each document, a file for each page."""
    lines = V.doc_lines(spark, sf_dir).withColumn("html", R.block_html(F.lit("text"), F.col("text"), F.lit(1)))
    pages = R.pages_html(lines)
    files = F.transform(F.sort_array(F.collect_list(F.struct("page", "html"))), lambda p: F.struct(F.concat(F.lit("page_"), p.page.cast("string"), F.lit(".xhtml")).alias("file"), F.concat(F.lit("Page "), p.page.cast("string")).alias("title"), p.html.alias("html")))
    books = pages.groupBy("doc_id").agg(files.alias("files")).join(V.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language")), "doc_id").withColumn("title", F.col("doc_id").cast("string"))
    return R.epubs(books).select("doc_id", F.sha2("epub", 256).alias("sha256"), F.length("epub").alias("bytes"))


@query("translation_items", "select conv_id as doc_id, turn as ord, sub, case sub when 0 then turn || '' else turn || '.cap' || (sub - 1) end as key, case sub when 0 then text when 1 then role else '' end as text from conversations, (values (0), (1), (2)) as s(sub) where trim(case sub when 0 then text when 1 then role else '' end) <> ''")
def translation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text", F.array("role", F.lit("")).alias("captions"))
    return TR.items(b)


@query("translation_lookup", "with d as (select conv_id, turn || '' as key, role as text from conversations where turn % 2 = 0 union all select conv_id, turn || '.cap0', 'c' from conversations where turn % 3 = 0), a as (select conv_id, turn, turn || suffix as key from conversations, (values (''), ('.cap0'), ('.cap1')) as s(suffix)) select a.conv_id as doc_id, a.key, coalesce(x.text, y.text) as translated from a left join d x on x.conv_id = a.conv_id and x.key = a.key left join d y on y.conv_id = a.conv_id and y.key = a.turn || ''")
def translation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.turns(spark, sf_dir).withColumnRenamed("conv_id", "doc_id").withColumn("t", F.col("turn").cast("string"))
    done = t.where("turn % 2 = 0").select("doc_id", F.col("t").alias("key"), F.col("role").alias("text")).unionByName(t.where("turn % 3 = 0").select("doc_id", F.concat("t", F.lit(".cap0")).alias("key"), F.lit("c").alias("text")))
    asked = t.select("doc_id", F.explode(F.array("t", F.concat("t", F.lit(".cap0")), F.concat("t", F.lit(".cap1")))).alias("key"))
    return TR.translation_of(asked, done)


@query("glossary_terms", "with t as (select conv_id as doc_id, text as source, arg_max(role, turn) as target from conversations group by 1, 2), r as (select *, row_number() over (partition by doc_id order by source) as k from t) select doc_id, string_agg(source || '=' || target, '|' order by source) as terms from r where k <= 60 group by doc_id")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("text").alias("source"), F.col("role").alias("target"), F.col("turn").alias("batch"))
    return TR.glossary(t).select("doc_id", F.array_join(F.transform("terms", lambda x: F.concat(x.source, F.lit("="), x.target)), "|").alias("terms"))


@query("batch_prompts", "select conv_id as doc_id, 'Before: ' || min(role) || chr(10) || string_agg('[' || k || '] ' || text, chr(10) order by turn) as prompt from (select *, row_number() over (partition by conv_id order by turn) as k from conversations) group by conv_id")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text", F.lit(0).alias("batch"), F.min("role").over(W.partitionBy("conv_id")).alias("context"))
    return TR.prompts(b).select("doc_id", "prompt")
