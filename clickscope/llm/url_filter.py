"""URL filter: rules first, gradient-boosted trees for the rest.

The URLs that a rule fits are the labelled ones.  Lexical features of theirs (lengths,
depth, digit ratio, entropy, parameter counts, and how common the host's suffixes are in
the table) train Spark ML's gradient-boosted trees; the trees judge the URLs without a
rule.  Training takes a bounded sample of labelled URLs; suffix statistics count all
rows.  Only DataFrame functions and Spark ML are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscope.llm.common import broadcast_checked, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""

    block: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[UrlRule, ...] = (
        UrlRule(True, "net", "/"), UrlRule(False, "example.net", "/en/"),
        UrlRule(True, "example.com", "/de/"), UrlRule(False, "org", "/fr/"))
    train_rows: int = 20_000  # labelled URLs, the least by hash
    trees: int = 10
    depth: int = 4
    seed: int = 42


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """``struct(rule, block)`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,block:boolean>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.block).alias("block"))).otherwise(out)
    return out


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    long = lambda s: F.length(s).cast("double")
    digits = long(F.regexp_replace(u, "[^0-9]", ""))
    return {
        "url_length": long(u), "host_length": long(host), "path_length": long(path), "query_length": long(query),
        "host_depth": count(host, "."), "path_depth": count(path, "/"), "hyphens": count(u, "-"),
        "digit_ratio": F.when(F.length(u) > 0, digits / F.length(u)).otherwise(0.0), "host_digits": long(F.regexp_replace(host, "[^0-9]", "")),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0),
        "fragment": F.contains(u, F.lit("#")).cast("double"), "extension": F.rlike(path, F.lit(r"\.[A-Za-z0-9]+\z")).cast("double"),
        "secure": F.startswith(u, F.lit("https:")).cast("double"), "entropy": entropy(u), "host_entropy": entropy(host),
    }


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", params: UrlParams = UrlParams()) -> DataFrame:
    """``(id, host, path, rule, verdict, score)`` for each row of ``pages``; ``score`` is the
    trees' probability of block, null where a rule decides.

    A null or malformed URL has an empty host and path, fits no rule, and is judged by the
    trees like any other; repeated rows stay; extra columns are not read.  If the labelled
    URLs are of one kind only, the rest is judged that kind; without any it is allowed."""
    u = F.col("url")
    host, path = host_and_path(u)
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    lex = lexical(u, F.col("host"), F.col("path"))
    known = materialize(parts.select(
        "id", "url", "host", "path", matching_rule(F.col("host"), F.col("path"), params.rules).alias("found"),
        _suffix(F.col("host"), 1).alias("s1"), _suffix(F.col("host"), 2).alias("s2"),
        *[c.alias(f"f_{k}") for k, c in lex.items()]), "urls")
    for s in ("s1", "s2"):  # suffix statistics, over all rows
        stats = known.groupBy(s).agg(F.log1p(F.count(F.lit(1))).alias(f"f_{s}_rows"), F.log1p(F.approx_count_distinct("host")).alias(f"f_{s}_hosts"))
        known = known.join(broadcast_checked(materialize(stats, s)), s)
    names = [c for c in known.columns if c.startswith("f_")]
    featured = VectorAssembler(inputCols=names, outputCol="features").transform(known)
    labelled = featured.where("found IS NOT NULL").select(F.col("found.block").cast("double").alias("label"), "features", "url")
    sample = materialize(labelled.orderBy(F.xxhash64("url"), "url").limit(params.train_rows).select("label", "features"), "labelled")
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]  # two rows at most
    if len(kinds) == 2:
        model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=params.seed, cacheNodeIds=False).fit(sample)
        judged = model.transform(featured).withColumn("score", vector_to_array("probability")[1])
    else:
        judged = featured.withColumn("score", F.lit(kinds[0] if kinds else 0.0))
    ruled = F.col("found").isNotNull()
    block = F.when(ruled, F.col("found.block")).otherwise(F.col("score") >= 0.5)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.when(block, "block").otherwise("allow").alias("verdict"), F.when(~ruled, F.col("score")).alias("score"))
