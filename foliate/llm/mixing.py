"""Operator 3: mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, unused

#: Budgets as shares of all tokens; the samples are nested.
BUDGETS = (0.1, 0.25, 0.5)
#: A source's target weight is its token count to this power, before all weights are scaled to a sum of 1.
TEMPERATURE = 0.7
#: Bits of the hash that a round of histograms resolves, and of the hash in all.
STEP, BITS = 12, 60


def hashed(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5: uniform, keyed by nothing but the id, the same in any engine."""
    return F.conv(F.substring(F.md5(doc_id.cast("long").cast("string")), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), hashed(F.col("doc_id")).alias("h"), tokens(F.col("text")).alias("tokens"))


def budgets(narrow: DataFrame, shares: tuple[float, ...], temperature: float) -> DataFrame:
    """(source, level, budget): the tokens each source may give to each of the nested samples, level 1 being the smallest."""
    total = narrow.groupBy("source").agg(F.sum("tokens").alias("n")).where("n > 0")
    weighed = total.crossJoin(total.agg(F.sum("n").alias("all"), F.sum(F.pow("n", F.lit(temperature))).alias("scale")))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(float(s)).alias("share")) for k, s in enumerate(sorted(shares), 1))))
    return weighed.select("source", "n", "all", "scale", levels.alias("x")).select("source", F.col("x.level").alias("level"), F.floor(F.col("x.share") * F.col("all") * F.pow("n", F.lit(temperature)) / F.col("scale")).cast("long").alias("budget"))


def thresholds(narrow: DataFrame, shares: tuple[float, ...] = BUDGETS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, level, threshold): the largest hash of the source that a sample takes; null where it takes all.

    Tokens are summed by source and bucket of the hash's first 12 bits; the bucket in which the running sum reaches a budget
    is the boundary bucket. Only its rows are counted again, by the next 12 bits, and so on: 5 rounds fix all 60 bits.
    Each round aggregates; nothing is sorted but at most 4096 buckets of a source and level.
    """
    # the boundary bucket of a source and level: its leading bits, and the tokens still to be taken from it
    open_ = budgets(narrow, shares, temperature).select("source", "level", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"))
    for done in range(0, BITS, STEP):
        bucket = F.shiftright("h", BITS - done - STEP)
        sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens").alias("n")) if not done else (
            narrow.withColumn("prefix", F.shiftright("h", BITS - done)).join(open_.select("source", "prefix").distinct(), ["source", "prefix"]).groupBy("source", "prefix", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))
        )
        seen = sums if done else sums.withColumn("prefix", F.lit(0).cast("long"))
        upto = Window.partitionBy("source", "prefix").orderBy("bucket")
        running = seen.withColumn("upto", F.sum("n").over(upto))
        reached = open_.join(running, ["source", "prefix"]).where(F.col("upto") >= F.col("rest"))
        low = reached.groupBy("source", "level").agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("x"))
        open_ = cut(low.select("source", "level", F.col("x.bucket").alias("prefix"), F.col("x.rest").alias("rest")), "boundary")
    every = budgets(narrow, shares, temperature).select("source", "level")
    return every.join(open_.select("source", "level", F.col("prefix").alias("threshold")), ["source", "level"], "left")


def levels(docs: DataFrame, shares: tuple[float, ...] = BUDGETS, temperature: float = TEMPERATURE) -> DataFrame:
    """(doc_id, source, tokens, level): the documents of the largest sample; level is the smallest sample that has them.

    A sample takes a source's documents in the order of their ids' hashes until their tokens reach its budget; the document
    that reaches it is the last, with those of the same id. So budgets are kept to within a document, and samples are
    nested. A source that has less than its budget gives all. A null source is the source ''. Null ids are never taken,
    null texts have no tokens; tables without tokens give nothing.
    """
    narrow = cut(counted(docs), "counted")
    least = cut(thresholds(narrow, shares, temperature), "thresholds").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "threshold"))).alias("t"))
    taken = F.filter("t", lambda t: t.threshold.isNull() | (F.col("h") <= t.threshold))
    return narrow.join(least, "source").select("doc_id", "source", "tokens", F.try_element_at(taken, F.lit(1)).level.alias("level")).where("level is not null")


def mix(docs: DataFrame, shares: tuple[float, ...] = BUDGETS, temperature: float = TEMPERATURE) -> DataFrame:
    """docs that are in the largest sample; all columns stay as they are, whatever their names.

    Rows of null ids are left out and those that repeat an id share its fate; otherwise as in levels(). An empty table stays empty.
    """
    source, most = unused(docs, "told_source", "most")
    cuts = cut(thresholds(cut(counted(docs), "counted"), shares, temperature).where(F.col("level") == len(shares)), "thresholds")
    cuts = cuts.select(F.col("source").alias(source), F.col("threshold").alias(most))
    kept = docs.where("doc_id is not null").join(cuts, F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(source))
    return kept.where(F.col(most).isNull() | (hashed(F.col("doc_id")) <= F.col(most))).select(*docs.columns)


ORACLE = rf"""
with c as (
  select doc_id, coalesce(source, '') as source, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h,
    coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) as tokens
  from documents where doc_id is not null),
n as (select source, sum(tokens) as n from c group by source having sum(tokens) > 0),
b as (
  select source, level, cast(floor(share * (select cast(sum(n) as bigint) from n) * pow(cast(n as double), {TEMPERATURE}) / (select sum(pow(cast(n as double), {TEMPERATURE})) from n)) as bigint) as budget
  from n, (values {", ".join(f"({k}, {s}::double)" for k, s in enumerate(BUDGETS, 1))}) as v(level, share)),
r as (select *, coalesce(sum(tokens) over (partition by source order by h range between unbounded preceding and 1 preceding), 0) as before from c)
select r.doc_id, r.source, cast(r.tokens as bigint) as tokens, cast(min(b.level) as integer) as level
from (select *, row_number() over () as k from r) r join b on r.source = b.source and r.before < b.budget
group by r.k, r.doc_id, r.source, r.tokens
"""
