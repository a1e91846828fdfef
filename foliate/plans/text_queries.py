"""Queries of the scalar functions and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..sources import views as V
from .registry import query


@query("doc_line_blocks", f"select doc_id, ord, page, text, {T.squeeze_sql('text')} as squeezed from {V.LINES_SQL}")
def doc_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_lines(spark, sf_dir).withColumn("squeezed", T.squeeze(F.col("text")))


@query("norm_title_keys", f"select doc_id, ord, {T.title_key_sql('text')} as key, {T.core_key_sql('text')} as core from {V.SENTENCES_SQL}")
def norm_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sentences(spark, sf_dir).select("doc_id", "ord", T.title_key(F.col("text")).alias("key"), T.core_key(F.col("text")).alias("core"))


@query("strip_trailing_page", f"select doc_id, ord, {T.strip_trailing_page_sql("text || ' … ' || page")} as bare, {T.strip_trailing_page_sql('text')} as own from {V.LINES_SQL}")
def strip_trailing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = F.concat(F.col("text"), F.lit(" … "), F.col("page"))
    return V.doc_lines(spark, sf_dir).select("doc_id", "ord", T.strip_trailing_page(led).alias("bare"), T.strip_trailing_page(F.col("text")).alias("own"))


#: A numbering before each line, of every shape in turn.
_HEADS = ("第三编 ", "Part two: ", "第十二章 ", "Chapter 4. ", "第2节 ", "Section 9 ", "四、", "（五）", "7. ", "(8) ", "XIV. ", "b. ", "")
_NUMBERED = "element_at(array(" + ", ".join(f"'{h}'" for h in _HEADS) + f"), cast(ord % {len(_HEADS)} as int) + 1)"
_NUMBERED_SQL = "[" + ", ".join(f"'{h}'" for h in _HEADS) + f"][ord % {len(_HEADS)} + 1] || text"


@query("title_shape_counts", f"select {C.title_shape_sql(_NUMBERED_SQL)} as shape, {C.title_shape_sql('text')} as own, cast(count(*) as bigint) as n from {V.SENTENCES_SQL} group by all")
def title_shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat(F.expr(_NUMBERED), F.col("text"))
    return V.sentences(spark, sf_dir).groupBy(C.title_shape(headed).alias("shape"), C.title_shape(F.col("text")).alias("own")).agg(F.count(F.lit(1)).alias("n"))


_R = "repeat('M', cast(o_orderkey // 1000 % 4 as int)) || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][cast(o_orderkey // 100 % 10 as int) + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][cast(o_orderkey // 10 % 10 as int) + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][cast(o_orderkey % 10 as int) + 1]"


@query("roman_numbers", f"with r as (select o_orderkey, {_R} as numeral from orders) select o_orderkey, numeral, cast({C.roman_sql('numeral')} as integer) as n from r")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = lambda of, words: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("o_orderkey") / of) % 10).cast("int") + 1)
    numeral = F.concat(
        F.element_at(F.array(*map(F.lit, ("", "M", "MM", "MMM"))), (F.floor(F.col("o_orderkey") / 1000) % 4).cast("int") + 1),
        digit(100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), digit(10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), digit(1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")),
    )
    return V.table(spark, sf_dir, "orders").select("o_orderkey", numeral.alias("numeral")).withColumn("n", C.roman(F.col("numeral")))


@query("series_numbers")
def series_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.concat(F.expr(_NUMBERED), F.col("text"))
    return V.sentences(spark, sf_dir).select("doc_id", "ord", C.series(headed).alias("s")).where("s is not null").select("doc_id", "ord", "s.family", "s.n")


@query("head_tail_sentence", f"select conv_id, turn, {T.snippet_sql('text')} as snippet from conversations")
def head_tail_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.turns(spark, sf_dir).select("conv_id", "turn", T.snippet(F.col("text")).alias("snippet"))


@query("list_item_flag", f"select doc_id, ord, {C.is_list_item_sql(_NUMBERED_SQL)} as numbered, {C.is_list_item_sql('text')} as own from {V.LINES_SQL}")
def list_item_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.doc_lines(spark, sf_dir).select("doc_id", "ord", C.is_list_item(F.concat(F.expr(_NUMBERED), F.col("text"))).alias("numbered"), C.is_list_item(F.col("text")).alias("own"))


_SUP = "text || '$^{' || page_id % 12 || '}$' || '<sup>②</sup> 3. next'"


@query("latex_sup", f"select page_id, ord, {T.latex_sup_sql(_SUP)} as marked from {V.HTML_SQL}")
def latex_sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit("$^{"), (F.col("page_id") % 12).cast("string"), F.lit("}$<sup>②</sup> 3. next"))
    return V.html_blocks(spark, sf_dir).select("page_id", "ord", T.latex_sup(marked).alias("marked"))


@query("clean_blocks", f"select page_id, {T.clean_sql("html || ' $ x + y $ \\n'")} as cleaned, {T.escape_attr_sql('url')} as url, {T.file_name_sql('url')} as file from pages")
def clean_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.col("html"), F.lit(r" $ x + y $ \n"))
    return V.table(spark, sf_dir, "pages").select("page_id", T.clean(padded).alias("cleaned"), T.escape_attr(F.col("url")).alias("url"), T.file_name(F.col("url")).alias("file"))


@query("cjk_punctuation")
def cjk_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: RE2 has no lookaround."""
    x = F.concat(F.lit("译文"), F.col("text"), F.lit(" $a,b$ 3.5, end."))
    return V.html_blocks(spark, sf_dir).select("page_id", "ord", T.full_punctuation(x).alias("full"), T.full_punctuation(F.col("text")).alias("own"))


_MARK = "['$^{3}$ ', '④ ', '12. ', '[7] ', 'c) ', ''][ord % 6 + 1] || text"


@query("footnote_markers", f"select doc_id, ord, {T.footnote_marker_sql(_MARK)} as marker from {V.LINES_SQL}")
def footnote_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.element_at(F.array(*map(F.lit, ("$^{3}$ ", "④ ", "12. ", "[7] ", "c) ", ""))), (F.col("ord") % 6 + 1).cast("int"))
    return V.doc_lines(spark, sf_dir).select("doc_id", "ord", T.footnote_marker(F.concat(heads, F.col("text"))).alias("marker"))


@query("model_reply_json", f"""with r as (select conv_id, turn, case turn % 3 when 0 then 'Sure: ```json' || chr(10) || '{{"turn": ' || turn || ', "role": "' || role || '"}}' || chr(10) || '``` done' when 1 then 'so {{"turn": ' || turn || '}} it is' else text end as reply from conversations)
select conv_id, turn, {T.first_json_sql('reply')} as found, try_cast(json_extract_string(try_cast({T.first_json_sql('reply')} as json), '$.turn') as integer) as said from r""")
def model_reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's replies hold as JSON, read with a schema."""
    t = F.col("turn").cast("string")
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sure: ```json\n{"turn": '), t, F.lit(', "role": "'), F.col("role"), F.lit('"}\n``` done'))).when(F.col("turn") % 3 == 1, F.concat(F.lit('so {"turn": '), t, F.lit("} it is"))).otherwise(F.col("text"))
    found = T.first_json(reply)
    return V.turns(spark, sf_dir).select("conv_id", "turn", found.alias("found"), F.from_json(found, "turn int").turn.alias("said"))


@query("toc_reply_rows", """with r as (select doc_id, ord, page, text from (select doc_id, ord, page, text from LINES) where text <> '')
select doc_id, ord, text as entry, cast(ord % 4 + 1 as integer) as level, page from r where ord % 4 <> 3""".replace("LINES", V.LINES_SQL))
def toc_reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: rows [text, level, page] of a reply; rows with an unusable level or without text are skipped."""
    level = F.when(F.col("ord") % 4 == 3, F.lit("none")).otherwise((F.col("ord") % 4 + 1).cast("string"))
    said = V.doc_lines(spark, sf_dir).select("doc_id", "ord", F.to_json(F.array(F.array(F.col("text"), level, F.col("page").cast("string")))).alias("reply"))
    rows = said.select("doc_id", "ord", F.explode(F.from_json("reply", "array<array<string>>")).alias("r"))
    got = rows.select("doc_id", "ord", F.col("r")[0].alias("entry"), F.expr("try_cast(r[1] as int)").alias("level"), F.expr("try_cast(r[2] as int)").alias("page"))
    return got.where("entry <> '' and level > 0")


@query("label_lines", "select conv_id, turn as id, length(text) % 7 as level from conversations where length(text) % 7 - 1 >= -1 and length(text) % 5 <> 0")
def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line protocol <|id|>a<|level|>n; malformed lines and negative levels are skipped."""
    size = F.length("text")
    line = F.when(size % 5 == 0, F.lit("<|id|>oops")).otherwise(F.concat(F.lit("<|id|>"), F.col("turn"), F.lit("<|level|>"), size % 7))
    raw = V.turns(spark, sf_dir).select("conv_id", F.concat(line, F.lit("\n<|id|>9<|level|>-1\n")).alias("raw"))
    lines = raw.select("conv_id", F.explode(F.split("raw", "\n")).alias("s"))
    p = r"^<\|id\|>([0-9]+)<\|level\|>(-?[0-9]+)$"
    return lines.where(F.col("s").rlike(p)).select("conv_id", F.regexp_extract("s", p, 1).cast("int").alias("id"), F.regexp_extract("s", p, 2).cast("int").alias("level")).where("level >= 0")


_X = "o_orderkey * 37 % 900"


@query("norm_boxes", """with b as (select o_orderkey, o_orderkey * 37 % 900 as x1, o_orderkey * 53 % 1200 as y1, o_orderkey * 37 % 900 + o_orderkey % 13 as x2, o_orderkey * 53 % 1200 + o_orderkey % 301 as y2 from orders),
n as (select o_orderkey, least(1000, cast(round_even(x1 * 1000 / 850.0::double, 0) as integer)) as a, least(1000, cast(round_even(y1 * 1000 / 1100.0::double, 0) as integer)) as b, least(1000, cast(round_even(x2 * 1000 / 850.0::double, 0) as integer)) as c, least(1000, cast(round_even(y2 * 1000 / 1100.0::double, 0) as integer)) as d from b)
select o_orderkey, case when c > a and d > b then a || ',' || b || ',' || c || ',' || d end as box from n""")
def norm_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = F.array(*(x.cast("double") for x in (k * 37 % 900, k * 53 % 1200, k * 37 % 900 + k % 13, k * 53 % 1200 + k % 301)))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.norm_box(box, F.lit(850.0), F.lit(1100.0)).cast("array<string>"), ",").alias("box"))


@query("chunk_sizes", "select doc_id, cast(greatest(1, least(1000, floor(47185920 / greatest(n_chars * 5000 / greatest(len(string_split(text, chr(10))), 1), 1)))) as integer) as pages from documents")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", C.chunk_pages(F.col("n_chars") * 5000, F.size(F.split("text", "\n"))).alias("pages"))


@query("captions", """with c as (select doc_id, ord, ['Table ' || ord || '.2 ', 'see Fig. ' || ord || '-a ', '表 ' || ord || ' ', 'Tab. IV ', ''][ord % 5 + 1] || text || ['', ' (Continued)', ''][ord % 3 + 1] as t from LINES)
select doc_id, ord, case when ord % 5 in (0, 2, 3) then 'table' when ord % 5 = 1 then 'figure' end as kind, case ord % 5 when 0 then ord || '.2' when 1 then cast(ord as varchar) when 2 then cast(ord as varchar) when 3 then 'IV' end as number, ord % 3 = 1 as continued from c""".replace("LINES", V.LINES_SQL))
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("ord").cast("string")
    heads = F.element_at(F.array(F.concat(F.lit("Table "), o, F.lit(".2 ")), F.concat(F.lit("see Fig. "), o, F.lit("-a ")), F.concat(F.lit("表 "), o, F.lit(" ")), F.lit("Tab. IV "), F.lit("")), (F.col("ord") % 5 + 1).cast("int"))
    tails = F.element_at(F.array(F.lit(""), F.lit(" (Continued)"), F.lit("")), (F.col("ord") % 3 + 1).cast("int"))
    t = F.concat(heads, F.col("text"), tails)
    return V.doc_lines(spark, sf_dir).select("doc_id", "ord", C.caption_number(t).alias("c"), C.says_continued(t).alias("continued")).select("doc_id", "ord", "c.kind", "c.number", "continued")


@query("half_width")
def half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.turns(spark, sf_dir).select("conv_id", "turn", T.half_width(F.col("text")).alias("text"))
