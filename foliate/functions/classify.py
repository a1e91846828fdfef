"""Classifiers of single blocks (C-series) and their DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CN = "[0-9〇零百十九八七六五四三二一]+"
_TEN = "[十九八七六五四三二一]"
#: Numbering shapes from the most to the least outer one; the first that fits names a title's shape.
SHAPES = (
    ("part_cn", f"^第{_CN}[编篇卷部]"), ("part_en", r"(?i)^(?:part|volume|book|teil|partie|tome)\b"), ("chap_cn", f"^第{_CN}章"),
    ("chap_en", r"(?i)^(?:chapter|kapitel|chapitre)\b"), ("sec_cn", f"^第{_CN}节"), ("sec_en", r"(?i)^(?:§|section\b)"),
    ("num_cn", f"^{_TEN}+、"), ("num_cn_paren", f"^[(（]?{_TEN}+[)）]"), ("num_dot", r"^[0-9]+\.\s*\S"),
    ("num_paren", "^[（(]?[0-9]+[）)]"), ("roman", r"^[CDILMVX]+[、.]\s"), ("alpha", r"^[A-Za-z][、.]\s"),
)
_LIST = r"(?i)^\s*(?:[-*•·▪◦‣]\s|[0-9]{1,3}[.)、]|[（(][0-9a-z]{1,3}[）)]|[a-z][.)]\s|[ivx]{1,5}[.)]\s|[①-⑳]|[(（]?[十九八七六五四三二一]{1,3}[、)）])"
_END = r"[.!?。！？…]$|[.!?。！？…][\"'”’）)\]]$"
_NUMERALS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def title_shape(x: Column) -> Column:
    """C1."""
    t = F.trim(F.coalesce(x, F.lit("")))
    return reduce(lambda c, s: c.when(t.rlike(s[1]), s[0]), SHAPES[1:], F.when(t.rlike(SHAPES[0][1]), SHAPES[0][0])).otherwise("plain")


def title_shape_sql(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches(trim(coalesce({x}, '')), '{p}') then '{name}'" for name, p in SHAPES) + " else 'plain' end"


def roman(x: Column) -> Column:
    """The number a Roman numeral stands for; null if it is none."""
    value = lambda c: reduce(lambda e, kv: e.when(c == kv[0], kv[1]), _NUMERALS.items(), F.when(F.lit(False), 0))
    # from the right: a smaller numeral before a larger one counts against it
    state = F.aggregate(F.reverse(F.split(F.upper(x), "(?!^)(?!$)")), F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), lambda s, c: F.struct((s.total + F.when(value(c) < s["last"], -value(c)).otherwise(value(c))).alias("total"), F.greatest(s["last"], value(c)).alias("last")))
    return F.when(F.upper(x).rlike("^[IVXLCDM]+$"), state.total)


def roman_sql(x: str) -> str:
    case = "case c " + " ".join(f"when '{k}' then {v}" for k, v in _NUMERALS.items()) + " end"
    values = f"list_transform(string_split(upper({x}), ''), lambda c: {case})"
    return f"case when regexp_matches(upper({x}), '^[IVXLCDM]+$') then list_sum(list_transform({values}, lambda v, i: case when v < coalesce(list_max({values}[i + 1:]), 0) then -v else v end)) end"


def cn_number(x: Column) -> Column:
    """One to ten in Chinese numerals, else null."""
    return reduce(lambda e, kv: e.when(x == kv[1], kv[0] + 1), list(enumerate("二三四五六七八九十", 1)), F.when(x == "一", 1))


def series(x: Column) -> Column:
    """(family, n) of a numbered title; null if it has no number of at least 1."""
    got = lambda p: F.nullif(F.regexp_extract(F.trim(x), p, 1), F.lit(""))
    families = [
        ("num_dot", got(r"^([0-9]{1,9})\.\s*\S").cast("int")), ("num_cn", cn_number(got(f"^({_TEN})、"))), ("num_cn_paren", cn_number(got(f"^[(（]?({_TEN})[)）]"))),
        ("roman", roman(got(r"^([CDILMVX]+)[、.]\s"))), ("alpha", F.ascii(F.lower(got(r"^([A-Za-z])[、.]\s"))) - 96),
    ]
    return F.coalesce(*(F.when(n > 0, F.struct(F.lit(name).alias("family"), n.cast("int").alias("n"))) for name, n in families))


def is_list_item(x: Column) -> Column:
    """C4."""
    return x.rlike(_LIST)


def is_list_item_sql(x: str) -> str:
    return f"regexp_matches({x}, '{_LIST}')"


def may_continue(a: Column, b: Column) -> Column:
    """Whether block b may go on with the paragraph that a begins."""
    return ~(a.rlike(_END.replace("'", "\\x27")) | (F.length(a) < 10) | is_list_item(b) | a.contains("\t") | b.contains("\t") | (a.rlike("^[0-9]") & b.rlike("^[0-9]")))


def may_continue_sql(a: str, b: str) -> str:
    end = _END.replace("'", "\\x27")
    return f"not (regexp_matches({a}, '{end}') or length({a}) < 10 or {is_list_item_sql(b)} or contains({a}, chr(9)) or contains({b}, chr(9)) or (regexp_matches({a}, '^[0-9]') and regexp_matches({b}, '^[0-9]')))"


CAPTION_NUMBERS = (
    ("table", r"(?i)\btab(?:le|\.)\s*([A-Z]?-?[0-9]+(?:[.-][0-9]+)*)"), ("table", r"表\s*([A-Z]?[0-9]+(?:[.-][0-9]+)*)"), ("figure", r"(?i)\bfig(?:ure|\.)\s*([0-9]+(?:[.-][0-9]+)*)"),
    ("figure", r"图\s*([0-9]+(?:[.-][0-9]+)*)"), ("table", r"(?i)\btab(?:le|\.)\s*([IVXLC]+)\b"),
)


def caption_number(x: Column) -> Column:
    """(kind, number) that a caption names first in the order of CAPTION_NUMBERS."""
    return F.coalesce(*(F.when(x.rlike(p), F.struct(F.lit(k).alias("kind"), F.upper(F.regexp_replace(F.regexp_extract(x, p, 1), r"[\s-]", "")).alias("number"))) for k, p in CAPTION_NUMBERS))


CONTINUED = ("续表", "(续)", "（续）", "continued", "(cont'd)", "(continued)", "(cont.)")


def says_continued(x: Column) -> Column:
    """C13."""
    t = F.lower(F.trim(x))
    return reduce(Column.__or__, (t.endswith(m) for m in CONTINUED)) | t.startswith("续表")


def chunk_pages(size: Column, pages: Column, most_bytes: int = 45 << 20, most_pages: int = 1000) -> Column:
    """Pages of a file that one request may hold."""
    return F.greatest(F.lit(1), F.least(F.lit(most_pages), F.floor(F.lit(most_bytes) / F.greatest(size / F.greatest(pages, F.lit(1)), F.lit(1))).cast("int")))


def norm_box(box: Column, width: Column, height: Column) -> Column:
    """Pixel corners to whole thousandths of the page, ordered and clamped; null for a box without area. Halves go to the even."""
    scale = lambda v, of: F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * 1000 / of).cast("int")))
    out = F.array(scale(box[0], width), scale(box[1], height), scale(box[2], width), scale(box[3], height))
    return F.when((width > 0) & (height > 0) & (F.size(box) == 4) & (out[2] > out[0]) & (out[3] > out[1]), out)


def box_problem(box: Column) -> Column:
    """What is wrong with a box of unit coordinates, or null."""
    bad = F.exists(box, lambda v: v.isNull() | F.isnan(v) | (v < -1e-6) | (v > 1 + 1e-6))
    return F.when(box.isNull() | (F.size(box) != 4), "not four numbers").when(bad, "outside of the page").when((box[0] > box[2]) | (box[1] > box[3]), "corners out of order")


def merge_refusal(x: dict[str, Column]) -> Column:
    """C17: the first reason against merging two tables, or null: text between, captions, markers, footnotes, width, columns."""
    return F.coalesce(
        F.when(x["text_between"], "[text] text lies between the tables"),
        F.when(x["caption2"].isNotNull() & (x["caption1"].isNull() | ~x["captions_agree"]), "[caption] captions differ"),
        F.when(x["caption2"].isNotNull() & ~says_continued(x["caption2"]), "[continuation] no mark of continuation"),
        F.when(x["footnotes"] > F.when(x["caption2"].isNotNull(), 1).otherwise(0), "[footnote] footnotes end the first table"),
        F.when((x["width1"] > 0) & (x["width2"] > 0) & (F.abs(x["width1"] - x["width2"]) / F.least(x["width1"], x["width2"]) >= 0.1), "[width] widths differ"),
        F.when(~x["columns_agree"], "[columns] columns differ"),
    )
