"""Queries of anchors, levels, the quality report, and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import pages as P
from ..operators import qc
from ..sources import views as V
from .registry import query

_KEY = T.title_key_sql("text")
SENTENCES, LINES = V.SENTENCES_SQL, V.LINES_SQL

# every sixth sentence is an entry: whole, cut at either end, with a page number after it, or lengthened
_ENTRIES = f"(select doc_id, ord as toc_ord, case ord % 30 when 0 then text when 6 then substring(text, 6, 1000000) when 12 then 'Chapter: ' || text when 18 then text || ' …… ' || (page + 9) else left(text, greatest(8, length(text) - 9)) end as text, cast(1 + ord % 4 as integer) as level, page + 9 as page from {SENTENCES} where ord % 6 = 0)"
_ANCHORS = f"(select doc_id, toc_ord, form, key, level, display, page from (select *, {T.title_key_sql('text')} as full_key, {T.title_key_sql(T.strip_trailing_page_sql('text'))} as bare, text as display from {_ENTRIES}) e, (values (0), (1)) as f(form), lateral (select case form when 0 then full_key else bare end as key) where key <> '' and (form = 0 or bare <> full_key))"
_BLOCKS = f"(select doc_id, ord, page, text, {_KEY} as key from {SENTENCES})"
_MATCHES = f"""(select doc_id, ord, ['exact', 'prefix', 'suffix', 'reverse_prefix', 'substring'][rank + 1] as tier, akey, level, display, page, toc_ord from (
select *, row_number() over (partition by doc_id, ord order by rank, cost, toc_ord, form) as rn from (
select b.doc_id, b.ord, a.key as akey, a.level, a.display, a.page, a.toc_ord, a.form,
  case when a.key = b.key then 0 when starts_with(a.key, b.key) then 1 when length(b.key) >= 3 and suffix(a.key, b.key) then 2 when length(a.key) >= 6 and starts_with(b.key, a.key) then 3 when length(b.key) >= 8 and contains(a.key, b.key) then 4 end as rank,
  case when a.key = b.key then 0 when starts_with(a.key, b.key) then -length(a.key) when length(b.key) >= 3 and suffix(a.key, b.key) then length(a.key) when length(a.key) >= 6 and starts_with(b.key, a.key) then -length(a.key) else length(a.key) end as cost
from {_BLOCKS} b join {_ANCHORS} a on a.doc_id = b.doc_id where b.key <> '') where rank is not null) where rn = 1)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir).where("ord % 6 = 0")
    k, t = F.col("ord") % 30, F.col("text")
    text = F.when(k == 0, t).when(k == 6, F.substring(t, 6, 1000000)).when(k == 12, F.concat(F.lit("Chapter: "), t)).when(k == 18, F.concat(t, F.lit(" …… "), F.col("page") + 9)).otherwise(F.left(t, F.greatest(F.lit(8), F.length(t) - 9)))
    return s.select("doc_id", F.col("ord").alias("toc_ord"), text.alias("text"), (1 + F.col("ord") % 4).cast("int").alias("level"), (F.col("page") + 9).alias("page"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentences(spark, sf_dir).withColumn("key", T.title_key(F.col("text")))


@query("anchor_table", f"select doc_id, toc_ord, key, level, display, page from {_ANCHORS}")
def anchor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.anchor_table(entries(spark, sf_dir)).drop("anchor")


@query("anchor_tiers", f"select * from {_MATCHES}")
def anchor_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.match_anchors(blocks(spark, sf_dir), A.anchor_table(entries(spark, sf_dir)), fuzzy=False)


@query("anchor_fuzzy")
def anchor_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: DuckDB's edit distance counts bytes. Unit tests hold it against a loop."""
    return A.match_anchors(blocks(spark, sf_dir), A.anchor_table(entries(spark, sf_dir)))


@query("anchor_levels", f"with d as (select distinct doc_id, display, page, level from {_ANCHORS}), l as (select doc_id, level, count(*) as n from d group by all), t as (select doc_id, count(*) as k, arg_min(n, level) as up, arg_max(n, level) as low, max(level) as flat from l group by doc_id) select a.doc_id, a.toc_ord, a.key, case when k = 2 and up <= 2 and low >= 5 then flat else a.level end as level from {_ANCHORS} a join t using (doc_id)")
def anchor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.collapse_levels(A.anchor_table(entries(spark, sf_dir))).select("doc_id", "toc_ord", "key", "level")


@query("toc_page_votes", f"with h as (select b.doc_id, b.page, count(distinct b.ord) as hits, max(e.page) - min(e.page) as span from {_BLOCKS} b join (select distinct doc_id, key, toc_ord % 60 as page from {_ANCHORS}) e on e.doc_id = b.doc_id and e.key = b.key group by b.doc_id, b.page), s as (select doc_id, page, count(*) as lines from {_BLOCKS} where key <> '' group by all) select doc_id, page, cast(hits as bigint) as hits from h join s using (doc_id, page) where hits >= 3 and span > 5 and 2 * hits >= lines")
def toc_page_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.anchor_table(entries(spark, sf_dir)).withColumn("page", F.col("toc_ord") % 60)
    return A.toc_pages(blocks(spark, sf_dir), e)


@query("forged_index_guard", f"with f as (select m.doc_id, m.toc_ord, min(b.page) as scan, any_value(m.page) - 9 as page from {_MATCHES} m join {_BLOCKS} b on b.doc_id = m.doc_id and b.ord = m.ord group by all) select doc_id, count(*) as compared, cast(count_if(scan = page) as bigint) as equal, count(*) >= 5 and 5 * count_if(scan = page) >= 4 * count(*) as forged from f group by doc_id")
def forged_index_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    m = A.match_anchors(b, A.anchor_table(entries(spark, sf_dir)), fuzzy=False)
    return A.forged_contents(m.withColumn("page", F.col("page") - 9), b)


@query("anchored_levels", f"select b.doc_id, b.ord, case when m.ord is not null and b.page % 7 <> 3 and length(b.key) between 1 and 64 and m.akey <> b.key and contains(m.akey, b.key) then m.display else b.text end as text, case when b.page % 7 = 3 then -1 when m.ord is not null and length(b.key) between 1 and 64 then m.level else 0 end as level from {_BLOCKS} b left join {_MATCHES} m on m.doc_id = b.doc_id and m.ord = b.ord")
def anchored_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).withColumn("level", F.lit(0))
    m = A.match_anchors(b, A.anchor_table(entries(spark, sf_dir)), fuzzy=False)
    return A.promoted(b, m, b.where("page % 7 = 3")).select("doc_id", "ord", "text", "level")


@query("enriched_titles", f"with p as (select b.doc_id, b.ord, a.display, row_number() over (partition by b.doc_id, b.ord order by a.key = b.key desc, length(a.key) desc, a.key desc, a.display desc) as rn from {_BLOCKS} b join {_ANCHORS} a on a.doc_id = b.doc_id and starts_with(a.key, b.key) where b.key <> '') select b.doc_id, b.ord, coalesce(p.display, b.text) as \"full\" from {_BLOCKS} b left join p on p.doc_id = b.doc_id and p.ord = b.ord and p.rn = 1")
def enriched_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.enriched_titles(blocks(spark, sf_dir), A.anchor_table(entries(spark, sf_dir)))


_STATS = f"""(with l as (select doc_id, ord, page, text, {_KEY} as key from {LINES}),
m as (select doc_id, count(*) filter (where length(text) % 9 = 1) as missing, count(distinct case when length(text) % 9 = 1 then page end) as missing_pages, count(*) filter (where length(text) < 80) as titles, max(page) as last from l group by doc_id),
t as (select doc_id, count(*) - count(distinct key) as duplicates from l where length(text) < 80 group by doc_id),
c as (select distinct doc_id, page from l where length(text) % 3 = 0),
u as (select doc_id, p from m, unnest(range(1, m.last + 1)) as x(p) where not exists (select 1 from c where c.doc_id = m.doc_id and c.page = p)),
g as (select doc_id, max(n) as longest from (select doc_id, count(*) as n from (select doc_id, p - row_number() over (partition by doc_id order by p) as i from u) group by doc_id, i) group by doc_id),
a as (select doc_id, cast(sum(len(regexp_extract_all(text, '[$%&*#]{{3}}'))) as bigint) as artefacts from l group by doc_id)
select m.doc_id, m.missing, m.missing_pages, m.titles, coalesce(t.duplicates, 0) as duplicates, case when coalesce(g.longest, 0) >= 2 then g.longest else 0 end as longest_gap, a.artefacts, coalesce(e.unanchored, 0) as unanchored, coalesce(e.entries, 0) as entries
from m left join t using (doc_id) left join g using (doc_id) join a using (doc_id)
left join (select d.doc_id, count_if(l.quality = 0) as unanchored, count(*) as entries from documents d join labels l using (doc_id) group by d.doc_id) e using (doc_id))"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.doc_lines(spark, sf_dir).withColumn("key", T.title_key(F.col("text")))
    odd, short = F.length("text") % 9 == 1, F.length("text") < 80
    by = lines.groupBy("doc_id").agg(
        F.count_if(odd).alias("missing"), F.countDistinct(F.when(odd, F.col("page"))).alias("missing_pages"), F.count_if(short).alias("titles"), F.max("page").alias("last_page"),
        (F.count_if(short) - F.countDistinct(F.when(short, F.col("key")))).alias("duplicates"), F.sum(F.regexp_count("text", F.lit("[$%&*#]{3}"))).cast("long").alias("artefacts"),
    )
    gaps = P.page_gaps(lines.where(F.length("text") % 3 == 0), by.select("doc_id", "last_page"), 2).groupBy("doc_id").agg(F.max("pages").alias("longest_gap"))
    said = V.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count_if(F.col("quality") == 0).alias("unanchored"), F.count(F.lit(1)).alias("entries"))
    return by.join(gaps, "doc_id", "left").join(said, "doc_id", "left").na.fill(0, ["longest_gap", "unanchored", "entries"])


_REPORT = f"""(select doc_id, list_filter([case when missing > 10 and missing_pages > 3 then 'missing blocks' end, case when unanchored > 0 then 'entries unanchored' end, case when longest_gap >= 10 then 'pages uncovered' end, case when artefacts >= 100 then 'formula artefacts' end, case when titles = 0 then 'no structure' end], lambda x: x is not null) as red,
list_filter([case when missing > 0 and not (missing > 10 and missing_pages > 3) then 'some blocks missing' end, case when entries = 0 then 'no table of contents' end, case when duplicates > 0 then 'duplicate titles' end, case when longest_gap between 4 and 9 then 'short gaps' end, case when artefacts between 10 and 99 then 'some artefacts' end], lambda x: x is not null) as yellow from {_STATS})"""


@query("document_qc", f"select doc_id, array_to_string(red, ', ') as red, array_to_string(yellow, ', ') as yellow, case when len(red) > 0 then 'RED' when len(yellow) > 0 then 'YELLOW' else 'GREEN' end as verdict from {_REPORT}")
def document_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship."""
    r = qc.report(stats(spark, sf_dir))
    return r.select("doc_id", F.array_join("red", ", ").alias("red"), F.array_join("yellow", ", ").alias("yellow"), "verdict")


@query("qc_summary", f"select case when len(red) > 0 then 'RED' when len(yellow) > 0 then 'YELLOW' else 'GREEN' end as verdict, count(*) as documents, cast(sum(len(red)) as bigint) as red_flags from {_REPORT} group by 1")
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.summary(qc.report(stats(spark, sf_dir)))
