"""Queries of the operators over ordered, paged blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import pages as P
from ..sources import views as V
from .registry import query

_KEY = T.title_key_sql("text")
LINES, SENTENCES, HTML = V.LINES_SQL, V.SENTENCES_SQL, V.HTML_SQL


@query("dup_lines_same_page", f"select doc_id, ord, page, key from (select *, row_number() over (partition by doc_id, page, key order by ord) as rn from (select doc_id, ord, page, {_KEY} as key from {LINES})) where rn = 1 or key = ''")
def dup_lines_same_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_of_page(V.doc_lines(spark, sf_dir), T.title_key(F.col("text"))).select("doc_id", "ord", "page", "key")


@query("running_head_demote", f"with b as (select doc_id, ord, page, {_KEY} as key, ord % 8 / 8.0 as y from {SENTENCES}) select doc_id, ord, key <> '' and first_value(page) over (partition by doc_id, key order by ord) < page and y <= 0.1 as demoted from b")
def running_head_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir)
    return P.running_heads(s, T.title_key(F.col("text")), F.col("ord") % 8 / 8.0).select("doc_id", "ord", "demoted")


_PAGES = f"(select doc_id, page, left(string_agg(text, chr(10) order by ord), 800) as text from {LINES} where trim(text) <> '' group by doc_id, page)"


@query("page_text_sample", f"select doc_id, page, text from (select *, max(page) over (partition by doc_id) as last from {_PAGES}) where page <= 15 or page > greatest(15, last - 5)")
def page_text_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sampled_pages(P.page_texts(V.doc_lines(spark, sf_dir)))


@query("page_near_dups", f"""with recursive t as (select doc_id, page, {T.squeeze_sql("string_agg(text, '' order by ord)")} as t from {LINES} group by doc_id, page),
s as (select doc_id, page, row_number() over (partition by doc_id order by page) as k, list_distinct(list_transform(range(1, greatest(length(t) - 7, 1) + 1), lambda i: substring(t, i, 8))) as s from t where t <> ''),
l as (select *, lag(s, 1) over w as s1, lag(s, 2) over w as s2 from s window w as (partition by doc_id order by page)),
m as (select doc_id, page, k,
  coalesce(len(list_intersect(s, s1)) > 0.8 * (len(s) + len(s1) - len(list_intersect(s, s1))), false) as a1,
  coalesce(len(list_intersect(s, s2)) > 0.8 * (len(s) + len(s2) - len(list_intersect(s, s2))), false) as a2 from l),
r as (select doc_id, page, k, true as k0, false as k1 from m where k = 1
  union all select m.doc_id, m.page, m.k, not ((m.a1 and r.k0) or (m.a2 and r.k1)), r.k0 from r join m on m.doc_id = r.doc_id and m.k = r.k + 1)
select doc_id, page, not k0 as dropped from r""")
def page_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_duplicate_pages(V.doc_lines(spark, sf_dir))


_COVER = f"select distinct doc_id, page from {LINES} where length(text) % 3 = 0"


@query("page_gap_report", f"""with c as ({_COVER}), l as (select doc_id, max(page) as last from {LINES} group by doc_id),
u as (select l.doc_id, p from l, unnest(range(1, l.last + 1)) as t(p) where not exists (select 1 from c where c.doc_id = l.doc_id and c.page = p)),
g as (select doc_id, p, p - row_number() over (partition by doc_id order by p) as i from u)
select doc_id, cast(min(p) as integer) as first_page, cast(max(p) as integer) as last_page, cast(count(*) as integer) as pages from g group by doc_id, i having count(*) >= 4""")
def page_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.doc_lines(spark, sf_dir)
    last = lines.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return P.page_gaps(lines.where(F.length("text") % 3 == 0), last)


_VOTES = "(select l_suppkey as doc_id, l_orderkey * 8 + l_linenumber as ord, cast(l_partkey % 400 as integer) as printed, cast(l_partkey % 400 + 10 + case when l_quantity > 15 then 3 else l_quantity % 9 end as integer) as scan from lineitem)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = (F.col("l_partkey") % 400).cast("int")
    extra = F.when(F.col("l_quantity") > 15, F.lit(3)).otherwise((F.col("l_quantity") % 9).cast("int"))
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), printed.alias("printed"), (printed + 10 + extra).alias("scan"))


_NEAR = f"""v as (select *, scan - printed as offs from {_VOTES}), m as (select doc_id, offs, count(*) as n, min(ord) as seen from v group by doc_id, offs),
b as (select doc_id, offs as mode from (select *, row_number() over (partition by doc_id order by n desc, seen) as rn from m) where rn = 1 and n >= 3),
n as (select v.*, count(*) over (partition by v.doc_id) as k from v join b on b.doc_id = v.doc_id and abs(v.offs - b.mode) <= 5)"""


@query("offset_mode_vote", f"with {_NEAR} select doc_id, ord, printed, scan from n where k >= 3")
def offset_mode_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.offset_votes(_votes(spark, sf_dir)).select("doc_id", "ord", "printed", "scan")


@query("local_offset_asof", f"""with {_NEAR}, o as (select doc_id, printed, min(scan) as scan from n where k >= 3 group by all), a as (select ps as doc_id, printed from (select distinct l_suppkey as ps from lineitem), unnest(range(0, 420, 7)) as t(printed)),
low as (select a.doc_id, a.printed, o.printed as lp, o.scan as ls from a asof left join o on a.doc_id = o.doc_id and a.printed >= o.printed),
high as (select a.doc_id, a.printed, o.printed as hp, o.scan as hs from a asof left join o on a.doc_id = o.doc_id and a.printed <= o.printed)
select doc_id, cast(printed as integer) as printed, case when hp is null or printed - lp <= hp - printed then ls - lp else hs - hp end as "offset" from low join high using (doc_id, printed)""")
def local_offset_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = P.offset_votes(_votes(spark, sf_dir))
    asked = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(413), F.lit(7))).alias("printed"))
    return P.nearest_offset(asked, votes)


@query("median_line_height", f"select doc_id, page, median(length(text) / 1000.0::double) as height from {LINES} where length(text) / 1000.0::double > 0.003 group by doc_id, page")
def median_line_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 (and A3, the same over another key)."""
    h = F.length("text") / F.lit(1000.0)
    return V.doc_lines(spark, sf_dir).where(h > 0.003).groupBy("doc_id", "page").agg(F.median(h).alias("height"))


@query("title_density_pages", f"select doc_id, page, cast(count_if(length(text) < 60) as bigint) as titles from {SENTENCES} s join (select doc_id as d, max(page) as last from {SENTENCES} group by doc_id) on d = doc_id group by doc_id, page, last having count_if(length(text) < 60) >= 6 and page <= greatest(20, last // 4)")
def title_density_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of six titles and more among the first."""
    s = V.sentences(spark, sf_dir)
    last = s.groupBy("doc_id").agg(F.max("page").alias("last"))
    by = s.groupBy("doc_id", "page").agg(F.count_if(F.length("text") < 60).alias("titles")).where("titles >= 6")
    return by.join(last, "doc_id").where(F.col("page") <= F.greatest(F.lit(20), F.floor(F.col("last") / 4))).select("doc_id", "page", "titles")


_LEVEL = "case role when 'system' then 1 when 'user' then 2 else 3 end + turn % 3 - 1"
_NODES = f"(select conv_id as doc_id, turn as ord, {_LEVEL} as level, text from conversations)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3) + F.col("turn") % 3 - 1
    return V.turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), level.cast("int").alias("level"), "text")


@query("level_parent_tree", f"with n as (select doc_id, ord, level from {_NODES}) select a.doc_id, a.ord, a.level, coalesce(max(b.ord), -1) as parent from n a left join n b on b.doc_id = a.doc_id and b.ord < a.ord and b.level > 0 and (a.level <= 0 or b.level < a.level) group by a.doc_id, a.ord, a.level")
def level_parent_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parents(_nodes(spark, sf_dir).select("doc_id", "ord", "level"))


@query("unanchored_sink", f"with n as (select *, length(text) % 3 = 0 as anchored from {_NODES}), w as (select *, last_value(case when anchored then level end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding) as last from n) select doc_id, ord, case when not anchored and last is not null then greatest(level, last + 1) else level end as new_level from w")
def unanchored_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sink_below_anchor(_nodes(spark, sf_dir).withColumn("anchored", F.length("text") % 3 == 0)).select("doc_id", "ord", "new_level")


@query("unit_segments", f"with s as (select doc_id, ord, text, ord = 0 or {_KEY} = '' or length(text) % 11 = 0 as starts, 2 + length(text) % 5 as level from {LINES}), i as (select *, sum(case when starts then 1 else 0 end) over (partition by doc_id order by ord) as island from s) select doc_id, cast(island as bigint) as unit, cast(count(*) as bigint) as blocks, 'h' || least(max(case when starts then level end) - 2 + 2, 6) as heading from i group by doc_id, island")
def unit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units begin at titles; a heading's tag follows from its level and the spine's."""
    starts = (F.col("ord") == 0) | (T.title_key(F.col("text")) == "") | (F.length("text") % 11 == 0)
    i = P.islands(V.doc_lines(spark, sf_dir).withColumn("starts", starts), F.col("starts"))
    level = F.max(F.when(F.col("starts"), 2 + F.length("text") % 5))
    return i.groupBy("doc_id", F.col("island").alias("unit")).agg(F.count(F.lit(1)).alias("blocks"), F.concat(F.lit("h"), F.least(level, F.lit(6))).alias("heading"))


@query("contd_paragraphs", f"""with recursive b as (select doc_id, ord, text, row_number() over (partition by doc_id order by ord) as k, ord = 0 or length(text) % 4 = 0 as starts from {LINES} where text <> ''),
i as (select *, sum(case when starts then 1 else 0 end) over (partition by doc_id order by ord) as island from b),
j as (select *, row_number() over (partition by doc_id, island order by ord) as p from i),
r as (select doc_id, island, p, text from j where p = 1 union all select j.doc_id, j.island, j.p, {T.join_dehyphened_sql('r.text', 'j.text')} from r join j on j.doc_id = r.doc_id and j.island = r.island and j.p = r.p + 1)
select doc_id, cast(island as bigint) as island, arg_max(text, p) as text from r group by doc_id, island""")
def contd_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs put together from the blocks of an island."""
    lines = V.doc_lines(spark, sf_dir).where("text <> ''")
    i = P.islands(lines, (F.col("ord") == 0) | (F.length("text") % 4 == 0))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b.text)
    rows = i.groupBy("doc_id", "island").agg(parts.alias("p"))
    joined = F.aggregate(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0], T.join_dehyphened)
    return rows.select("doc_id", "island", joined.alias("text"))


@query("batch_pack_6000", f"""with recursive b as (select doc_id, ord, length(text) as n, row_number() over (partition by doc_id order by ord) as k from {LINES}),
r as (select doc_id, ord, k, 0 as batch, case when n >= 6000 then 0 else n end as full, case when n >= 6000 then 1 else 0 end as next from b where k = 1
  union all select b.doc_id, b.ord, b.k, r.next, case when r.full + b.n >= 6000 then 0 else r.full + b.n end, case when r.full + b.n >= 6000 then r.next + 1 else r.next end from r join b on b.doc_id = r.doc_id and b.k = r.k + 1),
t as (select r.doc_id, r.batch, r.ord, l.text from r join {LINES} l on l.doc_id = r.doc_id and l.ord = r.ord),
g as (select doc_id, batch, cast(count(*) as bigint) as items, arg_max(text, ord) as last from t group by doc_id, batch)
select doc_id, batch, items, coalesce(left(lag(last) over (partition by doc_id order by batch), 400), '') as context from g""")
def batch_pack_6000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, W13, L8."""
    lines = V.doc_lines(spark, sf_dir)
    numbered = P.batches(lines, F.length("text")).join(lines, ["doc_id", "ord"])
    counts = numbered.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("items"))
    return counts.join(P.batch_contexts(numbered), ["doc_id", "batch"])


@query("contd_candidates", f"""with b as (select doc_id, ord, text, case when length(text) % 6 = 0 then 'title' else 'text' end as kind from {SENTENCES}),
i as (select *, sum(case when kind = 'title' then 1 else 0 end) over (partition by doc_id order by ord) as island from b)
select a.doc_id, a.ord, min(c.ord) as next_ord from i a join i c on c.doc_id = a.doc_id and c.island = a.island and c.ord > a.ord where a.kind = 'text' and c.kind = 'text' and {C.may_continue_sql('a.text', 'c.text')} group by a.doc_id, a.ord""")
def contd_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.sentences(spark, sf_dir).select("doc_id", "ord", "text", F.when(F.length("text") % 6 == 0, "title").otherwise("text").alias("kind"))
    return P.continuations(b, C.may_continue)


_KIND = "case tag when 'li' then 'image' when 'h1' then 'figure_caption' when 'title' then 'figure_caption' else case length(text) % 5 when 0 then 'table' when 1 then 'table_caption' when 2 then 'figure_caption' when 3 then 'image' else 'text' end end"


@query("caption_bind_runs", f"""with b as (select page_id as doc_id, ord, cast(ord // 8 as integer) as page, {_KIND} as kind from {HTML}),
n as (select *, row_number() over w as k, lag(kind) over w as prev, lag(ord) over w as prev_ord,
  first_value(case when kind = 'table' then ord end ignore nulls) over (partition by doc_id, page order by ord rows between 1 following and unbounded following) as nt,
  last_value(case when kind = 'table' then ord end ignore nulls) over (partition by doc_id, page order by ord rows between unbounded preceding and 1 preceding) as lt
  from b window w as (partition by doc_id, page order by ord)),
r as (select *, sum(case when prev is not distinct from kind then 0 else 1 end) over (partition by doc_id, page order by ord) as run from n),
e as (select doc_id, page, run, any_value(kind) as kind, max(ord) as last from r group by all)
select r.doc_id, r.ord, r.kind, case when r.kind = 'table_caption' then coalesce(nt, lt) else coalesce(case when r.ord = own.last and e.kind = 'image' then e.last end, case when prev = 'image' then prev_ord end) end as bound_to
from r join e own on own.doc_id = r.doc_id and own.page = r.page and own.run = r.run left join e on e.doc_id = r.doc_id and e.page = r.page and e.run = r.run + 1 where r.kind in ('figure_caption', 'table_caption')""")
def caption_bind_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.html_blocks(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "ord", F.floor(F.col("ord") / 8).cast("int").alias("page"), F.expr(_KIND).alias("kind"))
    return P.bind_captions(b).select("doc_id", "ord", "kind", "bound_to")


_NOTED = f"(select doc_id, ord, page, text || case when ord % 3 = 0 then '<sup>' || ord % 4 || '</sup>' else '' end as text from {LINES})"
_NOTES = f"(select doc_id, ord as note, page, cast(ord % 4 as varchar) as marker from {LINES} where length(text) % 2 = 0)"


@query("footnote_claim", f"with h as (select n.doc_id, n.note, min(b.ord) as ord from {_NOTES} n join {_NOTED} b on b.doc_id = n.doc_id and b.page = n.page and contains(b.text, '<sup>' || n.marker || '</sup>') group by n.doc_id, n.note) select doc_id, note, ord, cast(row_number() over (partition by doc_id order by ord, note) as integer) as number from h")
def footnote_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.doc_lines(spark, sf_dir)
    sup = F.concat(F.lit("<sup>"), (F.col("ord") % 4).cast("string"), F.lit("</sup>"))
    blocks = lines.withColumn("text", F.concat("text", F.when(F.col("ord") % 3 == 0, sup).otherwise("")))
    notes = lines.where(F.length("text") % 2 == 0).select("doc_id", F.col("ord").alias("note"), "page", (F.col("ord") % 4).cast("string").alias("marker"))
    return P.claim_footnotes(blocks, notes).select("doc_id", "note", "ord", "number")


@query("empty_chapters", f"""with n as (select doc_id, ord, case when ord % 4 = 0 then 1 + ord % 3 else 0 end as level, length(text) % 5 = 0 as has_content from {SENTENCES})
select a.doc_id, a.ord, a.level from n a where a.level > 0 and not exists (select 1 from n c where c.doc_id = a.doc_id and c.has_content and c.ord >= a.ord and c.ord < coalesce((select min(e.ord) from n e where e.doc_id = a.doc_id and e.ord > a.ord and e.level > 0 and e.level <= a.level), 2147483647))""")
def empty_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.sentences(spark, sf_dir).select("doc_id", "ord", F.when(F.col("ord") % 4 == 0, 1 + F.col("ord") % 3).otherwise(0).cast("int").alias("level"), (F.length("text") % 5 == 0).alias("has_content"))
    return P.empty_nodes(s)


@query("resume_antijoin", "select doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which nothing is done yet."""
    return V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id", "n_chars")


@query("chunk_overlap_join", f"with p as (select distinct doc_id, page from {SENTENCES}), c as (select doc_id, s as first, least(s + 11, last) as last from (select doc_id, max(page) as last from p group by doc_id) m, unnest(range(1, m.last + 1, 12)) as t(s)) select p.doc_id, p.page, cast(c.first as integer) as chunk from p join c on c.doc_id = p.doc_id and p.page between c.first - 1 and c.last + 1")
def chunk_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 12 pages that share a page with each neighbour. Pages compute their chunks, so nothing is joined by range."""
    pages = V.sentences(spark, sf_dir).select("doc_id", "page").distinct()
    own = F.floor((F.col("page") - 1) / 12) * 12 + 1
    last = F.col("last")
    chunks = F.array_compact(F.array(F.when((F.col("page") == own) & (own > 1), own - 12), own, F.when((F.col("page") == own + 11) & (own + 12 <= last), own + 12)))
    return pages.withColumn("last", F.max("page").over(P._by("doc_id"))).select("doc_id", "page", F.explode(chunks.cast("array<int>")).alias("chunk"))
