"""Scalar text functions over columns (P-series) and their DuckDB twins (names ending in _sql).

The twins take and give SQL text. Java classes need (?U) to be Unicode; RE2 gets explicit classes instead.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_SQL = r"[\s\p{Z}]"
#: A chapter (or part, section, volume) by number.
ORDINAL = "^第[0-9〇零百十九八七六五四三二一]+[部卷篇编节章]"
CJK = r"[\x{4e00}-\x{9fff}]"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sub_sql(x: str, pattern: str, by: str = "", options: str = "g") -> str:
    return f"regexp_replace({x}, {_lit(pattern)}, {_lit(by)}, '{options}')"


def squeeze(x: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def squeeze_sql(x: str) -> str:
    return _sub_sql(x, SPACE_SQL + "+")


def fold(x: Column) -> Column:
    """Case folding as far as built-ins go: lower case, and ß as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


QUOTES = (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'))


def title_key(x: Column) -> Column:
    """The form in which titles and table-of-contents entries are compared. Most texts have nothing but white space and case to change."""
    text = x = F.coalesce(x, F.lit(""))
    x = F.regexp_replace(x, r"\$\^\{[^}]*\}\$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?i)^[–—-]\s*[CDILMVX]+\.?\s*[–—-]\s*", "")
    for old in ("$", r"\left", r"\right"):
        x = F.replace(x, F.lit(old), F.lit(""))
    for old, new in QUOTES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.when(text.rlike(r"[$\\’‘“”]|^(?U:\s*)[–—-]"), fold(squeeze(x))).otherwise(fold(squeeze(text)))


def title_key_sql(x: str) -> str:
    x = _sub_sql(f"coalesce({x}, '')", r"\$\^\{[^}]*\}\$")
    x = _sub_sql(_sub_sql(x, rf"^{SPACE_SQL}+|{SPACE_SQL}+$"), r"^[–—-]\s*[CDILMVX]+\.?\s*[–—-]\s*", "", "i")
    for old in ("$", r"\left", r"\right"):
        x = f"replace({x}, '{old}', '')"
    for old, new in QUOTES:
        x = f"replace({x}, '{old}', {_lit(new)})"
    return fold_sql(squeeze_sql(x))


def strip_trailing_page(x: Column) -> Column:
    """Without the page number that dots, dashes or spaces lead to at the end."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s_·./…–—]+[0-9]+\s*$", ""))


def strip_trailing_page_sql(x: str) -> str:
    return f"trim({_sub_sql(x, r'[\s\p{Z}_·./…–—]+[0-9]+[\s\p{Z}]*$', '', '')})"


def core_key(x: Column) -> Column:
    """The title key without numbering and punctuation."""
    x = F.regexp_replace(title_key(x), r"^[0-9]+[.、|]?", "")
    return F.regexp_replace(F.regexp_replace(x, ORDINAL, ""), r"(?U)[^\w]", "")


def core_key_sql(x: str) -> str:
    x = _sub_sql(title_key_sql(x), r"^[0-9]+[.、|]?", "", "")
    return _sub_sql(_sub_sql(x, ORDINAL, "", ""), r"[^\p{L}\p{M}\p{N}\p{Pc}]")


def clean(x: Column) -> Column:
    """P5: without div tags, padding inside of inline formulas and escaped line ends."""
    x = F.regexp_replace(x, r"</?div[^>]*>", "")
    return F.trim(F.replace(F.regexp_replace(x, r"\$ ([^$]*?) \$", r"\$$1\$"), F.lit(r"\n"), F.lit(" ")))


def clean_sql(x: str) -> str:
    x = _sub_sql(x, r"</?div[^>]*>")
    return f"trim(replace({_sub_sql(x, r'\$ ([^$]*?) \$', r'$\1$')}, '\\n', ' '))"


def latex_sup(x: Column) -> Column:
    """Superscripts as markup; a numbered note after a circled marker begins a paragraph."""
    x = F.regexp_replace(x, r"\$\^\{([^}]*)\}\$", "<sup>$1</sup>")
    return F.regexp_replace(x, r"(<sup>[①-⑩]</sup>)\s*([0-9]+\.)", "$1</p>\n<p>$2")


def latex_sup_sql(x: str) -> str:
    x = _sub_sql(x, r"\$\^\{([^}]*)\}\$", r"<sup>\1</sup>")
    return f"regexp_replace({x}, '(<sup>[①-⑩]</sup>)\\s*([0-9]+\\.)', '\\1</p>' || chr(10) || '<p>\\2', 'g')"


def escape_attr(x: Column) -> Column:
    """P13."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_attr_sql(x: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def file_name(x: Column) -> Column:
    """P18."""
    return F.trim(F.regexp_replace(x, r'[*?|/\\:"<>]', "_"))


def file_name_sql(x: str) -> str:
    return f"trim({_sub_sql(x, r'[*?|/\\:\"<>]', '_')})"


def full_punctuation(x: Column) -> Column:
    """Full-width punctuation in texts with Chinese characters, outside of formulas; points next to digits stay."""
    plain = lambda s: F.translate(F.regexp_replace(s, r"(?<![0-9])\.(?![0-9])", "。"), ",:;!?()", "，：；！？（）")
    outside, inside = F.split(x, r"\$[^$]*\$"), F.regexp_extract_all(x, F.lit(r"\$[^$]*\$"), F.lit(0))
    joined = F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(plain(a), F.coalesce(b, F.lit("")))), "")
    return F.when(x.rlike(CJK), joined).otherwise(x)


def footnote_marker(x: Column) -> Column:
    """The marker at the head of a footnote, or ''."""
    got = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    return F.coalesce(got(r"^\s*\$\^\{([^}]*)\}\$"), got(r"^\s*([①-⑩])"), got(r"^\s*([0-9]{1,3})[.、]"), got(r"^\s*\[([0-9]{1,3})\]"), got(r"^\s*([a-z])[.)]\s"), F.lit(""))


def footnote_marker_sql(x: str) -> str:
    got = lambda p: f"nullif(regexp_extract({x}, {_lit(p)}, 1), '')"
    return f"coalesce({got(r'^\s*\$\^\{([^}]*)\}\$')}, {got(r'^\s*([①-⑩])')}, {got(r'^\s*([0-9]{1,3})[.、]')}, {got(r'^\s*\[([0-9]{1,3})\]')}, {got(r'^\s*([a-z])[.)]\s')}, '')"


ENDS = ".!?。！？；;"


def tail_sentence(x: Column) -> Column:
    """P20: the last part between sentence ends that isn't blank, or ''."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(x, f"[{ENDS}]"), lambda s: F.trim(s)), lambda s: s != ""), F.lit(-1)), F.lit(""))


def head_sentence(x: Column) -> Column:
    """P20: up to the first sentence end, or all."""
    first = F.regexp_extract(x, f"(?s)^(.*?[{ENDS}])", 1)
    return F.trim(F.when(first == "", x).otherwise(first))


def snippet(x: Column) -> Column:
    """First and last sentence, at most 103 characters."""
    both = F.when(head_sentence(x) == tail_sentence(x), head_sentence(x)).otherwise(F.concat(head_sentence(x), F.lit(" ... "), tail_sentence(x)))
    return F.when(F.length(both) > 103, F.concat(F.substring(both, 1, 50), F.lit("..."), F.right(both, F.lit(50)))).otherwise(both)


def snippet_sql(x: str) -> str:
    tail = f"coalesce(list_filter(list_transform(regexp_split_to_array({x}, '[{ENDS}]'), lambda s: trim(s)), lambda s: s <> '')[-1], '')"
    head = f"trim(coalesce(nullif(regexp_extract({x}, '^((?s:.*?)[{ENDS}])', 1), ''), {x}))"
    both = f"case when {head} = {tail} then {head} else {head} || ' ... ' || {tail} end"
    return f"case when length({both}) > 103 then left({both}, 50) || '...' || right({both}, 50) else {both} end"


def join_dehyphened(left: Column, right: Column) -> Column:
    """Two pieces of one paragraph, a hyphen at the break dropped, a space put between letters or digits."""
    return (
        F.when(left.endswith("-") & right.rlike("^[A-Za-z]"), F.concat(F.expr("''"), F.substring(left, F.lit(1), F.length(left) - 1), right))
        .when(left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]"), F.concat(left, F.lit(" "), right))
        .otherwise(F.concat(left, right))
    )


def join_dehyphened_sql(left: str, right: str) -> str:
    return f"case when {left} like '%-' and regexp_matches({right}, '^[A-Za-z]') then left({left}, length({left}) - 1) || {right} when regexp_matches({left}, '[A-Za-z0-9]$') and regexp_matches({right}, '^[A-Za-z0-9]') then {left} || ' ' || {right} else {left} || {right} end"


def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def half_width(x: Column) -> Column:
    """NFKC, for which Spark has no built-in."""
    return F.pandas_udf(nfkc, "string")(x)


def first_json(x: Column, kind: str = "{}") -> Column:
    """The object (or array) in a model's reply: of a fenced block, else the outermost."""
    a, b = kind
    fenced = F.nullif(F.regexp_extract(x, r"(?s)```(?:json)?\s*(\%s.*?\%s)\s*```" % (a, b), 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(x, r"(?s)(\%s.*\%s)" % (a, b), 1), F.lit("")))


def first_json_sql(x: str, kind: str = "{}") -> str:
    a, b = kind
    return f"coalesce(nullif(regexp_extract({x}, '(?s)```(?:json)?\\s*(\\{a}.*?\\{b})\\s*```', 1), ''), nullif(regexp_extract({x}, '(?s)(\\{a}.*\\{b})', 1), ''))"


def newer(a: Column, b: Column) -> Column:
    """Whether version a comes after b; missing parts are 0."""
    parts = lambda v: F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda s: s.cast("int"))
    width = F.greatest(F.size(parts(a)), F.size(parts(b)))
    padded = lambda v: F.concat(parts(v), F.array_repeat(F.lit(0), width - F.size(parts(v))))
    return padded(a) > padded(b)
