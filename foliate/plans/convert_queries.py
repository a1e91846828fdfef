"""Queries of conversion, geometry, ranges and titles' clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import convert as K
from ..sources import views as V
from .registry import query

LINES, SENTENCES, HTML = V.LINES_SQL, V.SENTENCES_SQL, V.HTML_SQL
_LABELS = ("paragraph_title", "text", "Figure", "table", "header", "formula", "unheard-of", "footnote")
_LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "][ord % 8 + 1]"
_TYPE_SQL = "['title', 'text', 'image', 'table', 'noise', 'equation', 'text', 'page_footnote'][ord % 8 + 1]"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("ord") % 8 + 1).cast("int"))
    return V.doc_lines(spark, sf_dir).withColumn("kind", K.block_type(label))


@query("layout_blocks", f"""with t as (select doc_id, ord, {_TYPE_SQL} as kind, text, [text, ''] as captions, row_number() over (partition by doc_id, {_TYPE_SQL}, text order by ord) as rn from {LINES}),
s as (select doc_id, ord, case when kind = 'noise' then 'text' else kind end as kind, text, captions from t where kind <> 'noise' or (rn = 1 and trim(text) <> '')),
e as (select doc_id, ord, 0 as sub, kind, text from s union all select doc_id, ord, case kind when 'table' then -100 else 1 end, case kind when 'table' then 'table_caption' else 'figure_caption' end, captions[1] from s where kind in ('table', 'image')
  union all select doc_id, ord, case kind when 'table' then -99 else 2 end, case kind when 'table' then 'table_caption' else 'figure_caption' end, captions[2] from s where kind in ('table', 'image'))
select * from e where kind in ('image', 'table') or trim(text) <> ''""")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.emitted(typed(spark, sf_dir).withColumn("captions", F.array(F.col("text"), F.lit(""))))


_BOX = "(ord % 3) * 0.3 as x1, (ord * 5 % 8) / 8.0 as y1, (ord % 3) * 0.3 + 0.2 + length(text) % 10 / 50.0 as x2, (ord * 5 % 8) / 8.0 + 0.02 + length(text) % 7 / 50.0 as y2"
_BOXED = f"(select doc_id, ord, page, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x2 as double) as x2, cast(y2 as double) as y2, kind, text from (select doc_id, ord, page, text, {_TYPE_SQL} as kind, {_BOX} from {LINES}))"


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).selectExpr("*", *(f"cast({x} as double) as {name}" for x, name in (p.rsplit(" as ", 1) for p in _BOX.split(", "))))


@query("caption_geometry", f"with b as {_BOXED}, h as (select doc_id, page, median(y2 - y1) as height from b where y2 - y1 > 0.003 group by all) select t.doc_id, t.ord from b t join h on h.doc_id = t.doc_id and h.page = t.page and t.y2 - t.y1 <= 1.6 * height where t.kind in ('title', 'text') and exists (select 1 from b v where v.doc_id = t.doc_id and v.page = t.page and v.kind in ('image', 'table') and case v.kind when 'image' then t.y1 - v.y2 else v.y1 - t.y2 end between -0.005 and 0.03 and least(t.x2, v.x2) - greatest(t.x1, v.x1) >= 0.3 * (t.x2 - t.x1))")
def caption_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxed(spark, sf_dir)
    h = b.withColumn("h", F.col("y2") - F.col("y1")).where("h > 0.003").groupBy("doc_id", "page").agg(F.median("h").alias("height"))
    return K.caption_by_place(b.where("kind in ('title', 'text')"), b.where("kind in ('image', 'table')"), h)


@query("image_containment", f"with b as {_BOXED}, w as (select doc_id, ord, page, kind, 0.0 as x1, y1 - 0.3 as y1, 1.3 as x2, y2 + 0.3 as y2 from b) select a.doc_id, a.ord, min(v.ord) as \"into\" from b a join w v on v.doc_id = a.doc_id and v.page = a.page and a.x1 >= v.x1 * 0.95::double and a.y1 >= v.y1 * 0.95::double and a.x2 <= v.x2 * 1.05::double and a.y2 <= v.y2 * 1.05::double where a.kind = 'text' and v.kind in ('image', 'table') group by a.doc_id, a.ord")
def image_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxed(spark, sf_dir)
    wide = b.selectExpr("doc_id", "ord", "page", "kind", "0D as x1", "y1 - 0.3D as y1", "1.3D as x2", "y2 + 0.3D as y2")
    return K.within(b.where("kind = 'text'"), wide.where("kind in ('image', 'table')"))


@query("spine_levels", f"with e as (select doc_id, 1 + length(text) % 5 as level, ord % 11 = 0 as part, ord % 3 = 0 as chapter from {SENTENCES}), s as (select doc_id, min(level) filter (where part) as p, min(level) filter (where chapter) as c, list_sort(list_distinct(list(level))) as l from e group by doc_id) select doc_id, case when c is null or p < c then p end as part_level, c as chapter_level, coalesce(l[2], l[1]) as spine from s")
def spine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.sentences(spark, sf_dir).withColumn("level", 1 + F.length("text") % 5)
    return K.spine(e, F.col("ord") % 11 == 0, F.col("ord") % 3 == 0).join(K.spine_level(e), "doc_id")


@query("body_range", f"with l as (select doc_id, max(page) as last from {SENTENCES} group by doc_id), m as (select doc_id, max(page) filter (where ord % 5 = 0 and page <= 2) as f, min(page) filter (where ord % 7 = 0 and page > 4) as b from {SENTENCES} group by doc_id) select doc_id, coalesce(f + 1, 1) as first_page, greatest(coalesce(f + 1, 1), coalesce(b - 1, last)) as last_page from l join m using (doc_id)")
def body_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir)
    front = s.where("ord % 5 = 0 and page <= 2").select("doc_id", F.lit("front").alias("side"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    back = s.where("ord % 7 = 0 and page > 4").select("doc_id", F.lit("back").alias("side"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return K.body_range(front.unionByName(back), s.groupBy("doc_id").agg(F.max("page").alias("last_page")))


_TITLES = f"(select doc_id, ord, page, 1 + ord % 2 as level, text, {T.core_key_sql('text')} as core, {T.title_key_sql('text')} as key from {SENTENCES})"


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir)
    return s.select("doc_id", "ord", "page", (1 + F.col("ord") % 2).alias("level"), "text", T.core_key(F.col("text")).alias("core"), T.title_key(F.col("text")).alias("key"))


@query("abbreviated_titles", f"with t as {_TITLES} select a.doc_id, a.ord from t a where a.core <> '' and exists (select 1 from t b where b.doc_id = a.doc_id and b.page = a.page and b.level = a.level and b.ord <> a.ord and ((starts_with(b.core, a.core) and b.core <> a.core) or (a.core = b.core and (length(a.text) < length(b.text) or (length(a.text) = length(b.text) and a.ord > b.ord)))))")
def abbreviated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.abbreviations(titles(spark, sf_dir))


@query("repeated_titles", f"with t as {_TITLES} select a.doc_id, a.ord from t a where a.key <> '' and exists (select 1 from t b where b.doc_id = a.doc_id and b.key = a.key and b.level = a.level and a.page - b.page between 0 and 1 and (b.page < a.page or b.ord < a.ord))")
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repeated_titles(titles(spark, sf_dir))


@query("applied_levels", f"with t as (select doc_id, ord, 1 + length(text) % 4 as level, ord % 5 = 0 as anchored, ord % 3 = 0 as plain, case when ord % 2 = 0 then length(text) % 12 - 1 end as said from {SENTENCES}), f as (select *, 1 + last_value(case when anchored then level end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as floor from t) select doc_id, ord, case when anchored then level when plain then greatest(greatest(1, least(8, coalesce(said, level))), coalesce(floor, 1)) else greatest(1, least(8, coalesce(said, level))) end as new_level from f")
def applied_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = V.sentences(spark, sf_dir), F.length("text")
    t = s.select("doc_id", "ord", (1 + n % 4).alias("level"), (F.col("ord") % 5 == 0).alias("anchored"), (F.col("ord") % 3 == 0).alias("plain"))
    return K.applied_levels(t, s.where("ord % 2 = 0").select("doc_id", "ord", (n % 12 - 1).alias("level")))


@query("progress_spans", "with s as (select l_orderkey as run, l_linenumber as stage, cast(l_quantity as double) as seconds from lineitem), e as (select run, stage, 100 * sum(seconds) over (partition by run order by stage) / sum(seconds) over (partition by run) as e from s) select run, stage, coalesce(lag(e) over (partition by run order by stage), 0) as start, least(e, 100) as \"end\" from e")
def progress_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.spans(V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").cast("double").alias("seconds")))


@query("default_metadata", "select doc_id, coalesce(nullif(trim(case when doc_id % 3 = 0 then ' ' else text end), ''), cast(doc_id as varchar)) as title, coalesce(case when doc_id % 2 = 0 then lang end, 'zh') as language, case when doc_id % 5 = 0 then 1 else 0 end as authors from documents")
def default_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents")
    meta = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"), F.when(F.col("doc_id") % 5 == 0, F.array("source")).alias("authors"))
    return K.with_defaults(meta).withColumn("authors", F.size("authors"))


@query("math_tidying")
def math_tidying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only, callbacks and fixpoints."""
    x = F.concat("text", F.lit(" H₂O x¹.² $ \\mathrm{a b c}_{1 2} $ [1, [2]]"))
    h = V.html_blocks(spark, sf_dir).select("page_id", "ord", K.scalar(K.scripts_to_latex)(x).alias("t"))
    return h.select("page_id", "ord", K.scalar(K.tidy_math)(F.col("t")).alias("text"), K.scalar(K.last_coordinates)(F.col("t")).alias("coordinates"))
