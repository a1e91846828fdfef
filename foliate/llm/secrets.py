"""Operator 9: secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger holds the pairs of blob and rule version that
were scanned, and what was found. A commit scans only pairs that are new, each blob once however many paths and versions
hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import cut


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression; anchor: a literal that each match contains."""

    id: str
    version: int
    anchor: str
    pattern: str


RULES_BEFORE = (
    Rule("aws_access_key", 1, "AKIA", r"AKIA[0-9A-Z]{16}"),
    Rule("password", 1, "password", r"password=[0-9a-f]+"),
    Rule("private_key", 1, "-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github_token", 1, "ghp_", r"ghp_[0-9A-Za-z]{36}"),
)
RULES = (
    RULES_BEFORE[0],
    Rule("password", 2, "password", r"password[ \t]*[=:][ \t]*[^ \t\r\n\"']{6,}"),
    *RULES_BEFORE[2:],
    Rule("hex_secret", 1, '"', r"\"[0-9a-f]{40}\""),
    Rule("slack_token", 1, "xox", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("json_web_token", 1, "eyJ", r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
)

SCANNED = "blob binary, rule_id string, rule_version int"
FINDINGS = f"{SCANNED}, secret_sha256 string, occurrences long"


class Ledger:
    """Two append-only Parquet tables in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], StructType.fromDDL(schema))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def findings(self) -> DataFrame:
        """A commit that was lost after it wrote findings writes them again; so each counts once."""
        return self._read("findings", FINDINGS).distinct()

    def commit(self, versions: DataFrame, rules: tuple[Rule, ...]) -> int:
        """Scan the pairs of versions(path, text) and rules that the ledger lacks; returns their number.

        Texts reach the shuffle only if they contain the anchor of a rule still to be scanned.
        """
        blobs = versions.where("text is not null").select(F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("blob"), F.col("text").cast("string").alias("text"))
        listed = self.spark.createDataFrame([(r.id, r.version) for r in rules], "rule_id string, rule_version int")
        pairs = cut(blobs.select("blob").distinct().crossJoin(F.broadcast(listed)).join(self.scanned(), ["blob", "rule_id", "rule_version"], "left_anti"), "pairs")
        open_ = {(r.rule_id, r.rule_version) for r in pairs.select("rule_id", "rule_version").distinct().collect()}
        left = [r for r in rules if (r.id, r.version) in open_]
        if left:
            some = F.array_compact(F.array(*(F.when(F.col("text").contains(r.anchor), F.lit(r.id)) for r in left)))
            texts = blobs.select("blob", "text", some.alias("rules")).where(F.size("rules") > 0).dropDuplicates(["blob"])
            due = texts.select("blob", "text", F.explode("rules").alias("rule_id")).join(pairs, ["blob", "rule_id"])
            match = F.coalesce(*(F.when(F.col("rule_id") == r.id, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for r in left))
            found = due.select("blob", "rule_id", "rule_version", F.explode(match).alias("secret")).groupBy("blob", "rule_id", "rule_version", F.sha2("secret", 256).alias("secret_sha256")).agg(F.count(F.lit(1)).alias("occurrences"))
            found.write.mode("append").parquet(f"{self.folder}/findings")
            pairs.write.mode("append").parquet(f"{self.folder}/scanned")
        return pairs.count()

    def by_path(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(path, rule_id, rule_version, secret_sha256, occurrences) for every path of versions and finding of the rules in its content.

        A path whose versions or repeated rows hold the same blob reports it once; null texts are no blobs, null paths a path
        of their own. Secrets are told by their hash only.
        """
        listed = self.spark.createDataFrame([(r.id, r.version) for r in rules], "rule_id string, rule_version int")
        held = versions.where("text is not null").select("path", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("blob")).distinct()
        now = self.findings().join(F.broadcast(listed), ["rule_id", "rule_version"])
        return held.join(now, "blob").groupBy("path", "rule_id", "rule_version", "secret_sha256").agg(F.max("occurrences").alias("occurrences"))


def scan(docs: DataFrame, folder: str, history: tuple[tuple[Rule, ...], ...] = (RULES_BEFORE, RULES)) -> DataFrame:
    """(doc_id, rule_id, rule_version, secret_sha256, occurrences): docs committed under each rule set in turn, and the last one's findings.

    Only blob and rule-version pairs that an earlier commit didn't scan are scanned by a later one. Empty tables, null and
    empty texts find nothing; repeated rows report once; further columns don't matter.
    """
    versions = docs.select(F.col("doc_id").cast("long").alias("path"), F.col("text").alias("text"))
    ledger = Ledger(docs.sparkSession, folder)
    for rules in history:
        ledger.commit(versions, rules)
    return ledger.by_path(versions, history[-1]).withColumnRenamed("path", "doc_id")


ORACLE = "\nunion all\n".join(
    rf"""select doc_id, '{r.id}' as rule_id, {r.version} as rule_version, sha256(secret) as secret_sha256, max(n) as occurrences from (
  select doc_id, text, secret, count(*) as n
  from (select distinct doc_id, text from documents where contains(text, '{r.anchor}')) as d, unnest(regexp_extract_all(text, '{r.pattern.replace("'", "''")}')) as u(secret)
  group by doc_id, text, secret) group by doc_id, secret"""
    for r in RULES
)
